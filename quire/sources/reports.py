"""Reports out and in: alignments as JSON, CSV of long rows, HTML pages, text tables, run results."""

from __future__ import annotations

import difflib
import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.strata import summary

MATCH = "array<struct<gt_index:int,region_id:string,gt_raw:string,pred_raw_merged:string,gt_norm:string,pred_norm:string,ned:double,similarity:double,pred_segment_start:int,pred_segment_end:int>>"
REPORT = f"task_id string, model_name string, match_mode string, alignment string, mean_ned double, micro_ned double, mean_similarity double, pred_segment_count int, matches {MATCH}"
FIELDS = ("gt_index", "region_id", "gt_raw", "pred_raw", "gt_norm", "pred_norm", "ned", "similarity", "pred_segment_start", "pred_segment_end")


def alignment_reports(matches: DataFrame, metrics: DataFrame, mode: str, alignment: str = "text", segments: DataFrame | None = None, notes: DataFrame | None = None, documents: DataFrame | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """One row a page in the form that is written and read again.

    segments (task_id, model, pred_segments), notes (task_id, model, notes), documents (as document_metrics) and tasks
    (task_id, inner_id, region_count) add their columns; without segments their number is that of the last matched one."""
    one = F.struct(*(F.col(c).alias("pred_raw_merged" if c == "pred_raw" else c) for c in FIELDS))
    held = matches.groupBy("task_id", "model").agg(F.array_sort(F.collect_list(one)).alias("matches"))
    rows = metrics.join(held, ["task_id", "model"])
    for more in (segments, notes, documents):
        rows = rows if more is None else rows.join(more, ["task_id", "model"], "left")
    if tasks is not None:
        own = tasks.select(F.col("task_id").cast("string").alias("task_id"), F.struct("task_id", "inner_id", "region_count").alias("manifest_task"))
        rows = rows.join(own, "task_id", "left")
    count = F.size("pred_segments") if segments is not None else F.coalesce(F.array_max(F.transform("matches", lambda m: m["pred_segment_end"])), F.lit(0))
    extra = [c for c in ("notes", "pred_segments", *(f"document_{k}" for k in ("ned", "cer", "wer", "gt_char_len", "pred_char_len")), "manifest_task") if c in rows.columns]
    return rows.select("task_id", F.col("model").alias("model_name"), F.lit(mode).alias("match_mode"), F.lit(alignment).alias("alignment"), "mean_ned", "micro_ned", "mean_similarity", count.alias("pred_segment_count"), "matches", *extra)


def write_alignments(reports: DataFrame, path: str) -> None:
    """One report a line."""
    reports.write.mode("overwrite").json(path)


def read_alignments(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Long rows of alignment files; what cannot be read, and reports without a task, are passed over.

    A file is one report (indented or not), a list of them, or one report a line; lines: all files are of the last kind
    and may be of any size, where otherwise each is one row."""
    raw = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("source_file"), "value")
    filled = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    each_line = (F.size(filled) > 1) & F.forall(filled, lambda x: x.startswith("{") & x.endswith("}"))
    many = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    docs = F.when(each_line, filled).when(many.isNotNull(), F.transform(many, lambda v: F.to_json(v))).otherwise(F.array("value"))
    rows = raw.select("source_file", F.explode(docs).alias("doc")).select("source_file", F.from_json("doc", REPORT).alias("r")).filter("r.task_id is not null")
    each = rows.select("source_file", "r.*").select("task_id", "model_name", "alignment", "match_mode", "source_file", F.explode("matches").alias("m"))
    return each.filter("m is not null").select(
        F.trim("task_id").alias("task_id"), F.coalesce("m.gt_index", F.lit(-1)).alias("gt_index"), "m.region_id", F.coalesce("m.ned", F.lit(0.0)).alias("ned"),
        F.coalesce("m.gt_norm", F.lit("")).alias("gt_norm"), F.coalesce("m.pred_norm", F.lit("")).alias("pred_norm"), "alignment", "match_mode", "source_file",
    )


def write_long_csv(rows: DataFrame, path: str) -> bool:
    """Whether there were rows to write."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def escaped(c: Column) -> Column:
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(to))
    return c


def marked_diff(a: str, b: str) -> str:
    """a turned into b, character by character, as HTML spans of class eq, del and ins."""
    out = []
    for tag, i, j, k, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for name, part in (("eq", a[i:j]),) if tag == "equal" else (("del", a[i:j]), ("ins", b[k:n])):
            if part:
                out.append(f'<span class="{name}">{html.escape(part)}</span>')
    return "".join(out)


def diff(a: Column, b: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([marked_diff(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype=object)

    return run(a, b)


def html_pages(matches: DataFrame, metrics: DataFrame, title: str = "Alignment", preview: int = 500) -> DataFrame:
    """(task_id, model, html): the page's scores and a row for each region."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    shown = matches.withColumn("quire_diff", diff(F.col("gt_norm"), F.col("pred_norm")))
    row = F.concat(F.lit("<tr>"), cell(F.col("gt_index").cast("string")), cell(escaped(F.coalesce("region_id", F.lit("")))), cell(F.format_number("ned", 4)), cell(escaped(F.substring("gt_raw", 1, preview))), cell(escaped(F.substring("pred_raw", 1, preview))), cell(F.col("quire_diff")), F.lit("</tr>"))
    body = shown.groupBy("task_id", "model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gt_index", row.alias("r")))), lambda x: x["r"]), "\n").alias("body"))
    head = F.concat(F.lit(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>"), escaped(F.col("task_id")), F.lit("</h1><p>mean NED "), F.format_number("mean_ned", 4), F.lit(", micro NED "), F.format_number("micro_ned", 4), F.lit("</p><table>\n"))
    return metrics.join(body, ["task_id", "model"]).select("task_id", "model", F.concat(head, F.col("body"), F.lit("\n</table>")).alias("html"))


def text_table(found: DataFrame, most: int = 10_000) -> str:
    """Strata as plain text, four decimals. The report is for people: more than `most` strata are an error."""
    rows = found.orderBy("dimension", F.desc("n"), "stratum").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} strata")
    lines, last = [], None
    for r in rows:
        if r["dimension"] != last:
            last = r["dimension"]
            lines += ["", last, f"{'stratum':<32} {'n':>8} {'mean':>8} {'micro':>8}"]
        lines.append(f"{r['stratum']!s:<32} {r['n']:>8} {r['mean_ned']:>8.4f} {r['micro_ned']:>8.4f}")
    return "\n".join(lines).strip()


def json_report(found: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row of JSON: strata by dimension with their scores (four decimals); with rows: also the number of rows, files and
    rows that found no task or region."""
    one = F.struct("stratum", "n", F.round("mean_ned", 4).alias("mean_ned"), F.round("micro_ned", 4).alias("micro_ned"))
    place = F.struct((-F.col("n")).alias("o"), "stratum", one.alias("s"))
    held = found.groupBy("dimension").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["s"]).alias("strata"))
    doc = held.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "strata")))).alias("by"))
    if rows is None:
        return doc.select(F.to_json(F.struct("by")).alias("report"))
    counted = summary(rows).first()
    return doc.select(F.to_json(F.struct(*(F.lit(counted[k]).alias(k) for k in ("n", "files", "skipped")), "by")).alias("report"))


def write_texts(texts: DataFrame, path: str, key: str = "model") -> None:
    """A folder for each key, its text as one file's lines."""
    texts.select(key, "text").write.mode("overwrite").partitionBy(key).text(path, lineSep="\n")


def write_results(results: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Results of models, one a line, each with what is to be said of the whole run."""
    said = F.create_map(*(F.lit(x) for pair in (metadata or {}).items() for x in pair)) if metadata else None
    (results if said is None else results.withColumn("metadata", said)).write.mode("overwrite").json(path)


def write_sidecars(documents: DataFrame, path: str, key: str = "task_id") -> None:
    """Layout documents (key, pages, texts) as JSON, one a line, in a folder for each key."""
    documents.write.mode("overwrite").partitionBy(key).json(path)
