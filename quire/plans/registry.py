"""Queries over the engine's own operators on the driver's tables, and their SQL.

Roles of the tables: conversations are pages (a turn is a region, the next one its prediction), documents are
texts with annotations in labels, pages hold mark-up, events are timings, lineitem keys make boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import jsontext as J
from quire.functions import metrics as M
from quire.functions import models, normalize as N
from quire.functions import segment as S
from quire.operators import align as A
from quire.operators import layout, order, runs, strata
from quire.operators.parallel import spread, stored
from quire.sources import predictions as P
from quire.streaming import follow

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NED = "levenshtein({0}, {1}) / cast(greatest(length({0}), length({1}), 1) as double)"
#: The other engine measures distances in bytes: the characters of a pair become the bytes 1, 2, ... (a pair here has under
#: 127 different ones), which changes no length and no distance in code points.
LETTERS = "list_distinct(regexp_extract_all({0} || {1}, '(?s).'))"
CODED = "array_to_string(list_transform(regexp_extract_all({0}, '(?s).'), lambda ch: chr(cast(list_position(cs, ch) as int))), '')"


def r6(c: Column) -> Column:
    return F.round(c, 6)


# metrics


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, ref, hyp: each whole turn with the one after it (empty after the last)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations")
    whole = lambda c: F.coalesce(c, F.lit(""))
    return spread(rows.select("conv_id", "turn", "role", whole(F.col("text")).alias("ref"), whole(F.lead("text").over(w)).alias("hyp")), "conv_id", "turn")


PAIRS = f"""raw as (select conv_id, turn, role, coalesce(text, '') as r, coalesce(lead(text) over (partition by conv_id order by turn), '') as h from conversations),
spelled as (select *, {LETTERS.format('r', 'h')} as cs from raw),
pairs as (select conv_id, turn, role, {CODED.format('r')} as ref, {CODED.format('h')} as hyp from spelled)"""


@query(f"with {PAIRS} select conv_id, turn, levenshtein(ref, hyp) as distance, round({NED.format('ref', 'hyp')}, 6) as ned, round(1 - {NED.format('ref', 'hyp')}, 6) as similarity, cast(greatest(length(ref), length(hyp), 1) as bigint) as weight from pairs")
def ned_pairs(spark, sf_dir):
    a, b = F.col("ref"), F.col("hyp")
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", M.distance(a, b).cast("long").alias("distance"), r6(M.ned(a, b)).alias("ned"), r6(M.similarity(a, b)).alias("similarity"), M.weight(a, b).cast("long").alias("weight"))


@query(f"with {PAIRS} select conv_id, turn, round(case when length(ref) > 0 then levenshtein(ref, hyp) / cast(length(ref) as double) when length(hyp) > 0 then 1.0 else 0.0 end, 6) as cer from pairs")
def cer_pairs(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", r6(M.cer(F.col("ref"), F.col("hyp"))).alias("cer"))


@query()
def wer_pairs(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", r6(M.wer(F.col("ref"), F.col("hyp"))).alias("wer"))


@query(f"""with {PAIRS}, d as (select role, levenshtein(ref, hyp) as d, length(ref) as n, length(hyp) as m from pairs)
select role, count(*) as n, round(avg(case when n > 0 then d / cast(n as double) when m > 0 then 1.0 else 0.0 end), 6) as mean_cer, round(coalesce(sum(d) / cast(nullif(sum(n), 0) as double), 0), 6) as micro_cer from d group by role""")
def corpus_cer(spark, sf_dir):
    found = A.corpus_rates(turn_pairs(spark, sf_dir), "ref", "hyp", "role")
    return found.select("role", "n", r6(F.col("mean_cer")).alias("mean_cer"), r6(F.col("micro_cer")).alias("micro_cer"))


@query()
def corpus_wer(spark, sf_dir):
    found = A.corpus_rates(turn_pairs(spark, sf_dir), "ref", "hyp", "role")
    return found.select("role", "n", r6(F.col("mean_wer")).alias("mean_wer"), r6(F.col("micro_wer")).alias("micro_wer"))


def turn_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("ref"), F.col("hyp")
    return turn_pairs(spark, sf_dir).select(F.col("conv_id").cast("string").alias("task_id"), F.lit("next").alias("model"), F.col("turn").alias("gt_index"), a.alias("gt_norm"), b.alias("pred_norm"), M.ned(a, b).alias("ned"), M.similarity(a, b).alias("similarity"), F.when(b != "", F.array(F.col("turn"))).otherwise(F.array()).alias("pred_indices"))


MICRO = "sum(ned * w) / sum(w)"
SCORED = f"{PAIRS}, scored as (select *, {NED.format('ref', 'hyp')} as ned, greatest(length(ref), length(hyp), 1) as w from pairs)"


@query(f"with {SCORED} select cast(conv_id as varchar) as task_id, count(*) as n, round(avg(ned), 6) as mean_ned, round({MICRO}, 6) as micro_ned, count(*) filter (hyp = '') as n_unmatched from scored group by conv_id")
def task_metrics(spark, sf_dir):
    found = A.task_metrics(turn_matches(spark, sf_dir))
    return found.select("task_id", "n", r6(F.col("mean_ned")).alias("mean_ned"), r6(F.col("micro_ned")).alias("micro_ned"), "n_unmatched")


@query(f"""with x as (select a.conv_id, a.turn as gt_index, b.turn as seg_index, coalesce(a.text, '') as r, coalesce(b.text, '') as h from conversations a join conversations b using (conv_id)),
spelled as (select *, {LETTERS.format('r', 'h')} as cs from x), y as (select conv_id, gt_index, seg_index, {CODED.format('r')} as g, {CODED.format('h')} as p from spelled)
select cast(conv_id as varchar) as task_id, gt_index, seg_index, round({NED.format('g', 'p')}, 6) as ned from y""")
def cost_matrix(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).select(F.col("conv_id").cast("string").alias("task_id"), "turn", "ref")
    found = A.cost_matrix(rows.select("task_id", F.col("turn").alias("gt_index"), F.col("ref").alias("gt_norm")), rows.select("task_id", F.col("turn").alias("seg_index"), F.col("ref").alias("pred_norm")))
    return found.withColumn("ned", r6(F.col("ned")))


# strata


def marked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows: the matches of whole turns with their role, turn, and a mark that every third turn lacks."""
    rows = turn_pairs(spark, sf_dir).withColumnsRenamed({"ref": "gt_norm", "hyp": "pred_norm"}).withColumn("ned", M.ned(F.col("gt_norm"), F.col("pred_norm")))
    mark = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("m"), (F.col("conv_id") % 5).cast("string")))
    return rows.select("role", F.col("turn").cast("string").alias("turn"), F.coalesce(mark, F.lit(strata.MISSING)).alias("mark"), "gt_norm", "pred_norm", "ned")


MARKED = f"""{PAIRS}, marked as (select role, cast(turn as varchar) as turn, case when turn % 3 <> 0 then 'm' || (conv_id % 5) else '__missing__' end as mark, {NED.format('ref', 'hyp')} as ned, greatest(length(ref), length(hyp), 1) as w from pairs)"""
STRATUM = "select '{0}' as dimension, {0} as stratum, count(*) as n, round(avg(ned), 6) as mean_ned, round(sum(ned * w) / sum(w), 6) as micro_ned from marked group by {0}"


@query(f"with {MARKED} " + " union all ".join(map(STRATUM.format, ("role", "turn", "mark"))) + " union all select '__all__', '', count(*), round(avg(ned), 6), round(sum(ned * w) / sum(w), 6) from marked")
def strata_grouping_sets(spark, sf_dir):
    found = strata.strata(marked_matches(spark, sf_dir), ["role", "turn", "mark"])
    return found.select("dimension", "stratum", "n", r6(F.col("mean_ned")).alias("mean_ned"), r6(F.col("micro_ned")).alias("micro_ned"))


@query(f"with {MARKED}, s as (select turn as stratum, count(*) as n from marked group by turn) select 'turn' as dimension, stratum, n, row_number() over (order by n desc, stratum) as place from s")
def strata_ranked(spark, sf_dir):
    return strata.ranked(strata.strata(marked_matches(spark, sf_dir), ["turn"]).filter("dimension = 'turn'")).select("dimension", "stratum", "n", F.col("place").cast("long").alias("place"))


def annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """labels as tasks and as regions: toxic rows have no region at index 0."""
    labels = read(spark, sf_dir, "labels")
    tasks = labels.select(F.col("doc_id").cast("string").alias("task_id"), F.create_map(F.lit("toxic"), F.col("toxic").cast("string")).alias("data"))
    kind = F.create_map(F.lit("quality"), F.array(F.lit(" "), F.col("quality").cast("string")))
    return tasks, labels.select(F.col("doc_id").cast("string").alias("task_id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("gt_index"), kind.alias("choices"))


@query("""select j as _join, q as quality, t as toxic, count(*) as n from (select case when l.doc_id is null then 'no_task' when toxic > 0 then 'bad_gt_index' else 'ok' end as j,
case when l.doc_id is null then '__no_task__' when toxic > 0 then '__bad_index__' else coalesce(cast(quality as varchar), '__missing__') end as q,
case when l.doc_id is null then '__no_task__' when toxic > 0 then '__bad_index__' else coalesce(cast(toxic as varchar), '') end as t from documents d left join labels l using (doc_id)) group by all""")
def strata_join_sentinels(spark, sf_dir):
    tasks, regions = annotated(spark, sf_dir)
    matches = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.lit(0).alias("gt_index"))
    rows = strata.joined(matches, tasks, regions, ["quality"], ["toxic"])
    return rows.groupBy("_join", "quality", F.col("`task_data.toxic`").alias("toxic")).agg(F.count("*").alias("n"))


@query("select count(*) as n, count(distinct d.source) as files, count(*) filter (l.doc_id is null or toxic > 0) as skipped from documents d left join labels l using (doc_id)")
def strata_summary(spark, sf_dir):
    tasks, regions = annotated(spark, sf_dir)
    matches = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.lit(0).alias("gt_index"), F.col("source").alias("source_file"))
    return strata.summary(strata.joined(matches, tasks, regions, []))


@query("select distinct unnest(json_keys(props)) as choice_key from events")
def choice_keys(spark, sf_dir):
    return strata.choice_keys(read(spark, sf_dir, "events").select(F.from_json("props", "map<string,string>").alias("choices")))


# recognizer runs


@query("""select event_type, count(value) as pages, round(sum(value), 4) as total, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as std, min(value) as least, max(value) as greatest,
case when count(value) >= 4 then list_sort(list(value))[cast(floor(count(value) * 0.25) as bigint) + 1] else min(value) end as p25,
case when count(value) >= 4 then list_sort(list(value))[cast(floor(count(value) * 0.75) as bigint) + 1] else max(value) end as p75 from events group by event_type""")
def timing_stats(spark, sf_dir):
    found = runs.timings(read(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", "pages", F.round("total", 4).alias("total"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "least", "greatest", "p25", "p75")


@query("select 'echo' as model, 'ok' as status, count(*) as pages, cast(sum(length(text)) + 22 * (count(*) - 1) as bigint) as total_chars, 0 as failed from conversations")
def recognizer_run(spark, sf_dir):
    pages = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).cast("int").alias("page_index"), F.col("text").cast("binary").alias("content"))
    return runs.results(stored(runs.run(pages, ["echo", "unknown"]), "runs")).select("model", "status", "pages", "total_chars", F.col("failed").cast("int").alias("failed"))


@query("select conv_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) order by turn)) as digest, cast(sum(length(coalesce(text, ''))) + 22 * (count(*) - 1) as bigint) as total_chars from conversations group by conv_id")
def page_concat(spark, sf_dir):
    found = runs.combined(read(spark, sf_dir, "conversations"), "conv_id", order="turn")
    return found.select("conv_id", F.md5("text").alias("digest"), F.col("total_chars").cast("long").alias("total_chars"))


@query("select date_trunc('hour', ts) as start, event_type as model, count(*) as n from events group by all")
def window_rates(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("ts").alias("arrived"), F.col("event_type").alias("model"))
    return follow.rates(rows, width="1 hour")


# orders


@query("""select user_id as task_id, event_type as region_id, cast(row_number() over (partition by user_id order by p) - 1 as bigint) as place from
(select user_id, event_type, min(event_id) as p from events where value > 10 group by all)""")
def first_seen_order(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("id"), F.when(F.col("value") > 10, "rectangle").otherwise("choices").alias("type"))
    found = order.first_seen(rows)
    return found.select("task_id", "region_id", F.col("place").cast("long").alias("place"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each line item, on the page of its order; boxes from its keys, in percent."""
    whole = lambda c, m: (F.col(c) % m).cast("double")
    box = F.struct(whole("l_partkey", 80).alias("x"), whole("l_suppkey", 90).alias("y"), (F.col("l_quantity") / 4 + 4).alias("width"), F.lit(8.6).alias("height"), F.lit(0.0).alias("rotation"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = read(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w))
    return rows.select(F.col("l_orderkey").alias("task_id"), F.col("i").alias("gt_index"), F.concat(F.lit("r"), F.col("i").cast("string")).alias("region_id"), box.alias("bbox"), F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("gt_raw"), F.col("i").alias("first_pos"))


BOXES = """boxes as (select l_orderkey as t, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) as int) as i, cast(l_partkey % 80 as double) as x, cast(l_suppkey % 90 as double) as y, l_quantity / 4 + 4 as w, cast(8.6 as double) as h, l_returnflag || ' ' || l_linestatus as txt from lineitem)"""


@query(f"with {BOXES} select t as task_id, i as gt_index, cast(row_number() over (partition by t order by y + h / 2, x + w / 2, i) - 1 as bigint) as place from boxes")
def geometric_order(spark, sf_dir):
    return order.geometric(boxes(spark, sf_dir)).select("task_id", "gt_index", F.col("place").cast("long").alias("place"))


@query(f"with {BOXES} select t as task_id, i as gt_index, cast(row_number() over (partition by t order by floor((y + h / 2) / 10 + 0.5), x, i) - 1 as bigint) as place from boxes")
def reading_order(spark, sf_dir):
    return order.reading(boxes(spark, sf_dir)).select("task_id", "gt_index", F.col("place").cast("long").alias("place"))


# layout


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans for each line item, moved a little against its region."""
    b = G.from_percent(F.col("bbox"))
    moved = G.box(b["x0"] + 0.013, b["y0"] + 0.021, b["x1"] + 0.013, b["y1"] + 0.021)
    return boxes(spark, sf_dir).select("task_id", F.col("gt_index").alias("span_index"), F.col("gt_raw").alias("text"), moved.alias("box"))


MET = f"""{BOXES}, a as (select t, i, x / 100 as x0, y / 100 as y0, (x + w) / 100 as x1, (y + h) / 100 as y1, txt from boxes),
s as (select t, i as j, x0 + 0.013 as p0, y0 + 0.021 as q0, x1 + 0.013 as p1, y1 + 0.021 as q1, txt as part from a),
pair as (select *, greatest(least(x1, p1) - greatest(x0, p0), 0) * greatest(least(y1, q1) - greatest(y0, q0), 0) as o, (x1 - x0) * (y1 - y0) + (p1 - p0) * (q1 - q0) as u from a join s using (t)),
met as (select *, o / (u - o) as iou from pair where o / (u - o) >= 0.05 or ((p0 + p1) / 2 between x0 and x1 and (q0 + q1) / 2 between y0 and y1))"""


@query(f"with {MET} select t as task_id, i as gt_index, j as span_index, round(iou, 6) as iou from met")
def box_iou_join(spark, sf_dir):
    return layout.overlaps(boxes(spark, sf_dir), spans_of(spark, sf_dir)).select("task_id", "gt_index", "span_index", r6(F.col("iou")).alias("iou"))


@query(f"""with {MET}, m as (select t, i, string_agg(part, ' ' order by floor((q0 + q1) / 2 * 10 + 0.5), p0, j) as pred from met group by t, i),
z as (select a.t, a.i, a.txt, coalesce(pred, '') as pred from a left join m using (t, i))
select t as task_id, i as gt_index, pred as pred_raw, round({NED.format('txt', 'pred')}, 6) as ned from z""")
def layout_merge_text(spark, sf_dir):
    found = layout.align_layout(boxes(spark, sf_dir), spans_of(spark, sf_dir))
    return found.select("task_id", "gt_index", "pred_raw", r6(F.col("ned")).alias("ned"))


@query(f"""with {BOXES}, page as (select t, max(x + w) as pw, max(y + h) as ph from boxes group by t), up as (select *, ph - y as top, ph - (y + h) as bottom from boxes join page using (t))
select t as task_id, cast(row_number() over (partition by t order by i) - 1 as int) as span_index, txt as text, round(x / pw, 6) as x0, round((ph - top) / ph, 6) as y0, round((x + w) / pw, 6) as x1, round((ph - bottom) / ph, 6) as y1 from up""")
def recognizer_lines_as_layout(spark, sf_dir):
    """Lines with pixel boxes, written as a layout document and read back as spans."""
    b = F.col("bbox")
    line = F.struct("gt_index", F.col("gt_raw").alias("t"), F.array(b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]).alias("b"))
    pages = boxes(spark, sf_dir).groupBy("task_id").agg(F.array_sort(F.collect_list(line)).alias("l")).select("task_id", F.col("l.t").alias("rec_texts"), F.col("l.b").alias("rec_boxes"))
    spans = P.layout_spans(P.lines_as_layout(pages))
    return spans.select("task_id", "span_index", "text", *(r6(F.col("box")[k]).alias(k) for k in ("x0", "y0", "x1", "y1")))


# text functions


@query(f"""with {PAIRS}, w as (select conv_id, turn, case when length(ref) <= length(hyp) then ref else hyp end as n, case when length(ref) <= length(hyp) then hyp else ref end as h from pairs where ref <> '' and hyp <> '')
select conv_id, turn, round(list_min(list_transform(generate_series(0, length(h) - length(n)), lambda i: levenshtein(substr(h, cast(i + 1 as bigint), length(n)), n))) / cast(length(n) as double), 6) as d from w""")
def window_fuzzy(spark, sf_dir):
    """The shorter of two whole turns in the longer."""
    a, b = F.col("ref"), F.col("hyp")
    first = F.length(a) <= F.length(b)
    rows = turn_pairs(spark, sf_dir).filter("ref <> '' and hyp <> ''").select("conv_id", "turn", F.when(first, a).otherwise(b).alias("n"), F.when(first, b).otherwise(a).alias("h"))
    return rows.select("conv_id", "turn", r6(M.best_window(F.col("n"), F.col("h"))["d"]).alias("d"))


def digest(c: Column) -> tuple[Column, Column]:
    return F.length(c).cast("long").alias("n"), F.md5(c).alias("digest")


TRIM = "regexp_replace({}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"


@query("select doc_id, length(t) as n, md5(t) as digest from (select doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) as t from documents)")
def norm_whitespace(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *digest(N.whitespace(F.coalesce("text", F.lit("")))))


@query("select doc_id, length(t) as n, md5(t) as digest from (select doc_id, regexp_replace(regexp_replace(text, '_{5,}', '____', 'g'), ' {5,}', '    ', 'g') as t from documents)")
def norm_repeat_caps(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *digest(N.long_runs(F.col("text"))))


@query("select doc_id, length(t) as n, md5(t) as digest from (select doc_id, translate(text, '" + N.WIDE + "', '" + N.NARROW.replace("'", "''") + "') as t from documents)")
def norm_fullwidth(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *digest(N.half_width(F.col("text"))))


@query("select page_id, length(t) as n, md5(t) as digest from (select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as t from pages)")
def strip_html_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", *digest(N.sub(F.col("html"), "<[^>]+>", " ")))


@query("select page_id, length(t) as n, md5(t) as digest from (select page_id, regexp_replace(html, '<!--.*?-->', ' ', 'gs') as t from pages)")
def strip_html_comments(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", *digest(N.comments(F.col("html"))))


@query("select page_id, length(t) as n, md5(t) as digest from (select page_id, regexp_replace('see [' || url || '](' || url || ') and ![p](' || url || ').', '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g') as t from pages)")
def strip_images(spark, sf_dir):
    url = F.col("url")
    marked = F.concat(F.lit("see ["), url, F.lit("]("), url, F.lit(") and ![p]("), url, F.lit(")."))
    return read(spark, sf_dir, "pages").select("page_id", *digest(N.images(marked)))


@query()
def normalize_text(spark, sf_dir):
    """The whole chain over whole documents."""
    return read(spark, sf_dir, "documents").select("doc_id", N.normalize(F.col("text")).alias("t")).select("doc_id", *digest(F.col("t")))


@query()
def strip_markup(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", N.markup(F.col("html")).alias("t")).select("page_id", *digest(F.col("t")))


@query("select doc_id, cast(i as int) as seg_index, length(x) as n, md5(x) as digest from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i from documents)")
def segments_lines(spark, sf_dir):
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\\n", -1)
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("seg_index", "x")).select("doc_id", "seg_index", *digest(F.col("x")))


@query()
def markdown_segments(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.markdown_segments(F.col("text"))).alias("seg_index", "s"))
    return rows.select("doc_id", "seg_index", "s.kind", *digest(F.col("s.text")))


@query("select event_type, cast(sum(cast(props ->> '$.k' as bigint)) as bigint) as total, count(distinct props ->> '$.k') as keys from events group by event_type")
def json_key_path(spark, sf_dir):
    k = J.at_path(F.col("props"), "k")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k.cast("long")).alias("total"), F.count_distinct(k).alias("keys"))


@query("select conv_id, turn, md5(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32))) as guessed from conversations")
def json_guess_text(spark, sf_dir):
    body = F.to_json(F.struct(F.lit(1).alias("pages"), F.struct(F.array(F.struct(F.col("text").alias("transcription"))).alias("output")).alias("result")))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", J.text_of(body).alias("t"))
    return rows.select("conv_id", "turn", F.md5("t").alias("guessed"))


@query("""select page_id, md5(trim(regexp_replace(list_aggregate(list_filter(list_transform(regexp_extract_all(html, '>([^<]+)<', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 'string_agg', ' '), '$', ''))) as digest from pages""")
def model_tagged_values(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(models.tagged_values(F.col("html"))).alias("digest"))


# sets and joins


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.coalesce(F.col("text"), F.lit("")), "\\n", -1))).alias("line"))


LINES = "lines as (select distinct doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)"


@query(f"with {LINES}, c as (select distinct unnest(string_split(coalesce(text, ''), chr(10))) as line from conversations) select doc_id, count(*) as n from lines where line not in (select line from c) group by doc_id")
def unmatched_anti(spark, sf_dir):
    """Lines of documents that no conversation has; the wide texts are told apart by their hash, then compared."""
    other = read(spark, sf_dir, "conversations").select(F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\\n", -1)).alias("line")).distinct()
    return doc_lines(spark, sf_dir).join(other, "line", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"with {LINES}, f as (select line, min(doc_id) as first_doc, count(*) as docs from lines group by line having count(*) > 1) select l.doc_id, count(*) as n, cast(sum(docs) as bigint) as docs, min(first_doc) as first_doc from lines l join f using (line) group by l.doc_id")
def exact_match_join(spark, sf_dir):
    """Lines that stand in more than one document: equal texts are found by an equality join on their hash."""
    lines = doc_lines(spark, sf_dir).select("doc_id", F.xxhash64("line").alias("h"), F.md5("line").alias("m"))
    first = lines.groupBy("h", "m").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("docs")).filter("docs > 1")
    return lines.join(first, ["h", "m"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc"))


# alignment


def conversation_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as regions; the conversation as a page of markdown, turns in reverse order, is the prediction."""
    rows = read(spark, sf_dir, "conversations")
    regions = rows.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("gt_index"), F.concat_ws("-", "role", "turn").alias("region_id"), F.col("text").alias("gt_raw"))
    part = F.struct((-F.col("turn")).alias("o"), F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.regexp_replace("text", "\\n", " ")).alias("t"))
    texts = rows.groupBy(F.col("conv_id").alias("task_id")).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return regions, texts.select("task_id", F.lit("reversed").alias("model"), F.array_join(F.col("p.t"), "\n\n").alias("text"))


def _matched(mode: str):
    def run(spark, sf_dir):
        found = A.align(*conversation_pages(spark, sf_dir), mode=mode)
        return found.select("task_id", "gt_index", "region_id", r6(F.col("ned")).alias("ned"), F.array_join("pred_indices", ",").alias("pred"), "pred_segment_start", "pred_segment_end")

    run.__name__ = f"{mode}_match"
    return query()(run)


for _mode in ("simple", "quick", "full"):
    _matched(_mode)


@query()
def document_level_metrics(spark, sf_dir):
    found = A.document_metrics(*conversation_pages(spark, sf_dir))
    return found.select("task_id", *(r6(F.col(c)).alias(c) for c in ("document_ned", "document_cer", "document_wer")), "document_gt_char_len", "document_pred_char_len")


@query()
def unmatched_segments(spark, sf_dir):
    regions, predictions = conversation_pages(spark, sf_dir)
    return A.unmatched_segments(A.align(regions, predictions, mode="simple"), predictions).groupBy("task_id").agg(F.count("*").alias("n"))
