"""Alignment of ground-truth regions with predictions, and the metrics of its matches.

regions: task_id, gt_index, region_id, gt_raw (and what else); predictions: task_id, model, text. A page (a
task of a model) is one row while it is solved, so pages are solved side by side wherever they lie; texts are
joined, normalised and scored by built-in expressions before and after.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quire.functions import metrics as M
from quire.functions.normalize import TextConfig, artifacts, normalize, strip
from quire.functions.segment import segments
from quire.operators import order
from quire.operators.parallel import bounded, spread
from quire.operators.solvers import SOLVERS, distances, relative

PAGE_BREAK = "\n\n--- Page Break ---\n\n"
BREAK_MARK = "--- Page Break ---"
DEFAULT = TextConfig()
#: Modes whose solvers begin with the distances of all pairs of a page.
COSTED = ("simple", "quick")


def solve(gt: Column, pred: Column, mode: str) -> Column:
    """array<array<int>>: the prediction indices of each ground-truth text. gt, pred: array<string>."""
    solver = SOLVERS[mode]

    @F.pandas_udf("array<array<int>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([solver(["" if x is None else x for x in g], ["" if x is None else x for x in p]) for g, p in zip(a, b, strict=True)], dtype=object)

    return run(gt, pred)


def _solved(cut: DataFrame, mode: str) -> DataFrame:
    """task_id, model, gt, pred (what stands on either side, in order) and pairs, from a row for each text of a page. Modes
    that go by all distances of a page get them from units of work of bounded size, a page's over many tasks."""
    key = ("task_id", "model")
    bounded(cut.sparkSession)
    if mode not in COSTED:
        item = F.struct("pos", "i", "id", "raw", "norm")
        solved = cut.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("i") >= 0, item))).alias("gt"), F.array_sort(F.collect_list(F.when(F.col("i") < 0, item))).alias("pred"))
        return spread(solved, *key).withColumn("pairs", solve(F.col("gt.norm"), F.col("pred.norm"), mode))
    item = F.struct("pos", "i", "id", "raw")
    texts = cut.groupBy(*key, F.col("norm").alias("text")).agg(F.collect_list(F.when(F.col("i") >= 0, item)).alias("gts"), F.collect_list(F.when(F.col("i") < 0, item)).alias("preds"))
    met = compared_blocks(texts, *key).select(*key, F.when(F.expr("quire_p = quire_q"), F.col("p")).alias("own"), F.struct("quire_p", "quire_q", "d").alias("met"))
    whole = spread(met.groupBy(*key).agg(F.flatten(F.collect_list("own")).alias("own"), F.collect_list("met").alias("met")), *key)

    def side(name: str) -> Column:
        one = lambda t: F.transform(t[name], lambda e: F.struct(e["pos"].alias("pos"), e["i"].alias("i"), e["id"].alias("id"), e["raw"].alias("raw"), t["text"].alias("norm"), t["at"].alias("at")))
        return F.array_sort(F.flatten(F.transform("own", one))).alias("gt" if name == "gts" else "pred")

    solved = whole.select(*key, side("gts"), side("preds"), "met")
    args = (F.col(c) for c in ("gt.norm", "gt.at", "pred.norm", "pred.at", "met.quire_p", "met.quire_q", "met.d"))
    return solved.withColumn("pairs", _solve_costed(mode)(*args)).drop("met")


def _solve_costed(mode: str):
    solver = SOLVERS[mode]

    def page(gt, g_at, pred, p_at, ps, qs, ds) -> list[list[int]]:
        gt, pred, g_at, p_at = list(gt), list(pred), np.asarray(g_at, int) - 1, np.asarray(p_at, int) - 1
        n = 1 + int(max(g_at.max(initial=0), p_at.max(initial=0)))
        found = np.zeros((n, n), np.int32)
        for p, q, d in zip(ps, qs, ds, strict=True):
            a, b = slice(p * BLOCK, min((p + 1) * BLOCK, n)), slice(q * BLOCK, min((q + 1) * BLOCK, n))
            part = np.asarray(d, np.int32).reshape(a.stop - a.start, b.stop - b.start)
            found[a, b], found[b, a] = part, part.T
        return solver(gt, pred, relative(found[np.ix_(g_at, p_at)], gt, pred))

    @F.pandas_udf("array<array<int>>")
    def run(gt: pd.Series, g_at: pd.Series, pred: pd.Series, p_at: pd.Series, ps: pd.Series, qs: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([page(*row) for row in zip(gt, g_at, pred, p_at, ps, qs, ds, strict=True)], dtype=object)

    return run


def pages(regions: DataFrame) -> DataFrame:
    """One row a task: regions, array<struct<gt_index, region_id, gt_raw>> in order."""
    one = F.struct(F.col("gt_index").cast("int").alias("gt_index"), F.col("region_id").cast("string").alias("region_id"), F.coalesce("gt_raw", F.lit("")).alias("gt_raw"))
    return regions.groupBy(F.col("task_id").cast("string").alias("task_id")).agg(F.array_sort(F.collect_list(one)).alias("regions"))


def align(regions: DataFrame, predictions: DataFrame, config: TextConfig = DEFAULT, mode: str | None = None) -> DataFrame:
    """A row for each region of each predicted page: what was matched to it, and how well.

    task_id, model, gt_index, region_id, gt_raw, pred_raw, gt_norm, pred_norm, ned, similarity, pred_indices,
    pred_segment_start, pred_segment_end (end exclusive; both 0 without a match)."""
    mode = mode or config.match_mode
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(BREAK_MARK), F.lit(""))
    text = artifacts(text) if config.strip_artifacts else text
    own = predictions.select(F.col("task_id").cast("string").alias("task_id"), F.col("model").cast("string").alias("model"), segments(text, config.markdown_segments).alias("segments"))
    page = pages(regions).join(own, "task_id")
    # texts are normalised as rows, once each: expressions of Python do not work inside arrays
    cut = page.select("task_id", "model", F.col("segments").alias("all"), F.posexplode(F.concat(F.transform("regions", lambda r: F.struct(r["gt_index"].alias("i"), r["region_id"].alias("id"), r["gt_raw"].alias("t"))), F.transform("segments", lambda s: F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("id"), s.alias("t"))))))
    cut = cut.select("task_id", "model", "pos", F.col("col.i").alias("i"), F.col("col.id").alias("id"), F.col("col.t").alias("raw"), normalize(F.col("col.t"), config).alias("norm"))
    solved = _solved(cut, mode)
    rows = solved.select("task_id", "model", F.col("pred.raw").alias("raws"), F.col("pred.norm").alias("norms"), F.inline(F.arrays_zip("gt", "pairs")))
    joined = F.array_join(F.transform("pairs", lambda k: F.get("raws", k)), "")
    out = rows.select("task_id", "model", F.col("gt.i").alias("gt_index"), F.col("gt.id").alias("region_id"), F.col("gt.raw").alias("gt_raw"), joined.alias("pred_raw"), F.col("gt.norm").alias("gt_norm"), F.when(F.size("pairs") == 1, F.get("norms", F.get("pairs", F.lit(0)))).alias("one"), F.col("pairs").alias("pred_indices"))
    # a single segment has been normalised already; merged ones are normalised as one text
    merged = normalize(F.when(F.size("pred_indices") > 1, F.col("pred_raw")), config)
    return scored(out.withColumn("pred_norm", F.coalesce("one", F.when(F.size("pred_indices") > 1, merged), F.lit(""))).drop("one"))


def scored(matches: DataFrame) -> DataFrame:
    """matches with ned, similarity and the envelope of pred_indices."""
    n = M.ned(F.col("gt_norm"), F.col("pred_norm"))
    some = F.size("pred_indices") > 0
    return matches.withColumns({
        "ned": n, "similarity": 1 - n,
        "pred_segment_start": F.when(some, F.array_min("pred_indices")).otherwise(0),
        "pred_segment_end": F.when(some, F.array_max("pred_indices") + 1).otherwise(0),
    })


def micro(ned: str = "ned", gt: str = "gt_norm", pred: str = "pred_norm") -> Column:
    """NED weighted by the longer length."""
    w = M.weight(F.col(gt), F.col(pred))
    return F.sum(F.col(ned) * w) / F.sum(w)


def task_metrics(matches: DataFrame, regions: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Mean and micro NED of each page. With regions and predictions of pages without regions unknown here, those have
    no row; compat: null metrics become 0."""
    out = matches.groupBy("task_id", "model").agg(F.count("*").alias("n"), F.avg("ned").alias("mean_ned"), F.avg("similarity").alias("mean_similarity"), micro().alias("micro_ned"), F.count_if(F.size("pred_indices") == 0).alias("n_unmatched"))
    if regions is not None:
        out = regions.select(F.col("task_id").cast("string").alias("task_id")).distinct().join(out, "task_id", "left")
    return out.na.fill(0.0, ["mean_ned", "mean_similarity", "micro_ned"]) if compat else out


def unmatched_segments(matches: DataFrame, predictions: DataFrame, config: TextConfig = DEFAULT) -> DataFrame:
    """Prediction segments that no region took: an anti join on the position."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(BREAK_MARK), F.lit(""))
    text = artifacts(text) if config.strip_artifacts else text
    cut = predictions.select(F.col("task_id").cast("string").alias("task_id"), F.col("model").cast("string").alias("model"), F.posexplode(segments(text, config.markdown_segments)).alias("seg_index", "segment"))
    used = matches.select("task_id", "model", F.explode("pred_indices").alias("seg_index"))
    return cut.join(used, ["task_id", "model", "seg_index"], "left_anti")


def document_metrics(regions: DataFrame, predictions: DataFrame, config: TextConfig = DEFAULT) -> DataFrame:
    """NED, CER and WER of whole pages: normalised regions in reading order (without boxes: in their own), a blank line
    between those that are not empty, against the whole normalised prediction."""
    placed = order.reading(regions) if "bbox" in regions.columns else regions.withColumn("place", F.col("gt_index"))
    parts = placed.select(F.col("task_id").cast("string").alias("task_id"), "place", "gt_index", normalize(strip(F.coalesce("gt_raw", F.lit(""))), config).alias("t"))
    gt = parts.groupBy("task_id").agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("place", "gt_index", "t")))).alias("p")).select("task_id", F.array_join(F.col("p.t"), "\n\n").alias("gt"))
    pred = normalize(artifacts(F.coalesce("text", F.lit(""))), config)
    both = gt.join(predictions.select(F.col("task_id").cast("string").alias("task_id"), "model", pred.alias("pred")), "task_id")
    a, b = F.col("gt"), F.col("pred")
    bounded(both.sparkSession)
    rows = spread(both, "task_id", "model").select("task_id", "model", M.long_distance(a, b).alias("d"), M.long_distance(M.tokens(a), M.tokens(b), words=True).alias("wd"), F.size(M.tokens(a)).alias("wn"), F.size(M.tokens(b)).alias("hn"), F.length(a).alias("document_gt_char_len"), F.length(b).alias("document_pred_char_len"))
    d, n, m = F.col("d"), F.col("document_gt_char_len"), F.col("document_pred_char_len")
    cer = F.when(n > 0, d / n).otherwise((m > 0).cast("double"))
    wer = F.when(F.col("wn") > 0, F.col("wd") / F.col("wn")).otherwise((F.col("hn") > 0).cast("double"))
    return rows.select("task_id", "model", (d / F.greatest(n, m, F.lit(1))).alias("document_ned"), cer.alias("document_cer"), wer.alias("document_wer"), "document_gt_char_len", "document_pred_char_len")


def notes(matches: DataFrame, predictions: DataFrame, regions: DataFrame, config: TextConfig = DEFAULT) -> DataFrame:
    """(task_id, model, notes): what a page's scores do not show. no_gt_regions: the page has no regions;
    unmatched_predictions=n: segments that no region took."""
    pages_ = predictions.select(F.col("task_id").cast("string").alias("task_id"), F.col("model").cast("string").alias("model")).distinct()
    known = regions.select(F.col("task_id").cast("string").alias("task_id"), F.lit(True).alias("quire_known")).distinct()
    left = unmatched_segments(matches, predictions, config).groupBy("task_id", "model").agg(F.count("*").alias("quire_left"))
    rows = pages_.join(known, "task_id", "left").join(left, ["task_id", "model"], "left")
    said = F.when(F.col("quire_known").isNull(), F.array(F.lit("no_gt_regions"))).otherwise(F.array_compact(F.array(F.concat(F.lit("unmatched_predictions="), F.col("quire_left").cast("string")))))
    return rows.select("task_id", "model", said.alias("notes"))


def corpus_rates(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", *by: str) -> DataFrame:
    """Mean and micro CER and WER of all pairs (by columns)."""
    r, h = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(hyp), F.lit(""))
    rw, hw = M.tokens(r), M.tokens(h)
    rows = pairs.select(*by, M.cer(r, h).alias("cer"), M.distance(r, h).alias("cd"), F.length(r).alias("cn"), M.token_distance(rw, hw).alias("wd"), F.size(rw).alias("wn"), F.size(hw).alias("hn"))
    rows = rows.withColumn("wer", F.when(F.col("wn") > 0, F.col("wd") / F.col("wn")).otherwise((F.col("hn") > 0).cast("double")))
    rate = lambda d, n: F.coalesce(F.sum(d) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), zero(F.avg("cer")).alias("mean_cer"), rate("cd", "cn").alias("micro_cer"), zero(F.avg("wer")).alias("mean_wer"), rate("wd", "wn").alias("micro_wer"))


#: Different texts of a page in one block: a unit of work compares the texts of two blocks.
BLOCK = 64


def compared_blocks(texts: DataFrame, *key: str) -> DataFrame:
    """key, quire_p, quire_q, p, q, d: two blocks of texts of a page and their distances (d: a row of q for each of p; -1
    where no ground truth meets a prediction). texts: key, text, gts and preds (arrays of what stands for it on either
    side), a text once a page; at: its place among them. A page of many texts becomes many units of work, each of bounded
    size; a distance serves both directions."""
    page = Window.partitionBy(*key)
    placed = texts.select(*key, F.length("text").alias("n"), "text", "gts", "preds", F.row_number().over(page.orderBy("text")).alias("at"), F.count("*").over(page).alias("quire_of"))
    block = F.floor((F.col("at") - 1) / BLOCK).cast("int")
    item = F.struct("at", "text", "n", "gts", "preds")
    blocks = placed.groupBy(*key, block.alias("quire_block")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("quire_of").alias("quire_of"))
    others = F.explode(F.sequence(F.lit(0), F.floor((F.col("quire_of") - 1) / BLOCK).cast("int"))).alias("quire_other")
    met = blocks.select(*key, "quire_block", "items", others).select(*key, F.least("quire_block", "quire_other").alias("quire_p"), F.greatest("quire_block", "quire_other").alias("quire_q"), "quire_block", "items")
    both = spread(met.groupBy(*key, "quire_p", "quire_q").agg(F.array_sort(F.collect_list(F.struct("quire_block", "items"))).alias("b")), *key, "quire_p", "quire_q")
    p, q = F.get("b", F.lit(0))["items"], F.get("b", F.size("b") - 1)["items"]
    bounded(texts.sparkSession)
    sides = [side for x in (p, q) for side in (x["text"], F.transform(x, lambda t: F.size(t["gts"]) > 0), F.transform(x, lambda t: F.size(t["preds"]) > 0))]
    return both.select(*key, "quire_p", "quire_q", p.alias("p"), q.alias("q"), _block_distances(*sides).alias("d"))


@F.pandas_udf(ArrayType(IntegerType()))
def _block_distances(p: pd.Series, p_gt: pd.Series, p_pred: pd.Series, q: pd.Series, q_gt: pd.Series, q_pred: pd.Series) -> pd.Series:
    names: dict[str, int] = {}
    code = lambda texts: np.array([names.setdefault(t, len(names)) for t in texts], np.int64)
    wanted, left, right = [], [], []
    for a, ag, ap, b, bg, bp in zip(p, p_gt, p_pred, q, q_gt, q_pred, strict=True):
        flag = lambda x: np.asarray(x, bool)
        need = flag(ag)[:, None] & flag(bp) | flag(ap)[:, None] & flag(bg)
        i, j = np.nonzero(need)
        wanted.append(need)
        left.append(code(a)[i])
        right.append(code(b)[j])
    if not wanted:
        return pd.Series([], dtype=object)
    found = np.split(distances(list(names), np.concatenate(left), np.concatenate(right)), np.cumsum([len(x) for x in left])[:-1])
    out = []
    for need, d in zip(wanted, found, strict=True):
        whole = np.full(need.shape, -1, np.int32)
        whole[need] = d
        out.append(whole.ravel())
    return pd.Series(out, dtype=object)


def cost_matrix(regions: DataFrame, segs: DataFrame) -> DataFrame:
    """(task_id, gt_index, seg_index, ned) of all pairs on a page, worked out block by block for texts that differ."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = regions.select("task_id", whole("gt_norm").alias("text"), F.struct(F.col("gt_index").alias("i")).alias("g"), F.lit(None).alias("s"))
    b = segs.select("task_id", whole("pred_norm").alias("text"), F.lit(None).alias("g"), F.struct(F.col("seg_index").alias("i")).alias("s"))
    texts = a.union(b).filter("task_id is not null").groupBy("task_id", "text").agg(F.collect_list("g").alias("gts"), F.collect_list("s").alias("preds"))
    bare = lambda c: F.transform(c, lambda t: F.struct(t["n"].alias("n"), t["gts"].alias("gts"), t["preds"].alias("preds"))).alias(c)
    met = compared_blocks(texts, "task_id").select("task_id", F.expr("quire_p = quire_q").alias("same"), bare("p"), bare("q"), "d")
    met = met.select("task_id", "same", "p", "q", F.posexplode("d").alias("at", "d")).filter("d >= 0")
    wide = F.size("q")
    x, y = F.get("p", F.floor(F.col("at") / wide).cast("int")), F.get("q", F.col("at") % wide)
    rows = met.select("task_id", (F.col("d") / F.greatest(x["n"], y["n"], F.lit(1))).alias("ned"), F.explode(F.array(F.struct(x["gts"].alias("g"), y["preds"].alias("s"), F.lit(False).alias("turned")), F.struct(y["gts"].alias("g"), x["preds"].alias("s"), F.lit(True).alias("turned")))).alias("w"), "same")
    rows = rows.filter("not (same and w.turned)").select("task_id", "ned", F.explode("w.g").alias("g"), F.col("w.s").alias("s")).select("task_id", "ned", "g", F.explode("s").alias("s"))
    return rows.select("task_id", F.col("g.i").alias("gt_index"), F.col("s.i").alias("seg_index"), "ned")


def ned_breakdown(a: Column, b: Column) -> Column:
    """What a NED is made of."""
    return F.struct(M.distance(a, b).alias("distance"), F.length(a).alias("gt_len"), F.length(b).alias("pred_len"), M.weight(a, b).alias("weight"), M.ned(a, b).alias("ned"))
