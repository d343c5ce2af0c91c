"""Scores by the annotations of their regions: joins with sentinels for what is missing, and all strata in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.normalize import strip
from quire.operators.align import micro

MISSING, NO_TASK, BAD_INDEX = "__missing__", "__no_task__", "__bad_index__"


def key_of(task_id: Column) -> Column:
    return strip(task_id.cast("string"))


def choice(choices: Column, key: str) -> Column:
    """The first value of a choice that is not blank, or a sentinel. choices: map<string, array<string>>."""
    filled = F.filter(F.try_element_at(choices, F.lit(key)), lambda v: strip(v) != "")
    return F.coalesce(strip(F.get(filled, F.lit(0))), F.lit(MISSING))


def data_value(data: Column, key: str) -> Column:
    """A task's value: null becomes empty, blank the sentinel. data: map<string, string>."""
    value = F.try_element_at(data, F.lit(key))
    return F.when(value.isNull(), "").when(strip(value) == "", MISSING).otherwise(value)


def choice_keys(regions: DataFrame) -> DataFrame:
    """Sorted distinct keys of the regions' choices."""
    return regions.select(F.explode(F.map_keys("choices")).alias("choice_key")).distinct().orderBy("choice_key")


def last_tasks(tasks: DataFrame, position: str = "position") -> DataFrame:
    """One row for each task id, the last one; rows without an id are dropped."""
    keyed = tasks.withColumn("task_id", key_of(F.col("task_id"))).filter("task_id is not null")
    rest = [c for c in keyed.columns if c not in ("task_id", position)]
    best = keyed.groupBy("task_id").agg(F.max_by(F.struct(*rest), F.col(position)).alias("t"))
    return best.select("task_id", *(F.col(f"t.{c}").alias(c) for c in rest))


def joined(matches: DataFrame, tasks: DataFrame, regions: DataFrame, keys: list[str], data_keys: list[str] = [], by_region: bool = False) -> DataFrame:
    """matches with _join (ok, no_task, bad_gt_index; of tasks with one id the last counts), a column for each choice key and task_data.<key> for each data key.

    Rows that find no task or region are kept with sentinels. by_region: regions are found by region_id, else by gt_index."""
    own = matches.withColumn("task_id", key_of(F.col("task_id")))
    ordered = tasks if "position" in tasks.columns else tasks.withColumn("position", F.monotonically_increasing_id())
    known = last_tasks(ordered).select("task_id", F.col("data").alias("quire_data"), F.lit(True).alias("quire_task"))
    on = "region_id" if by_region else "gt_index"
    there = regions.select(key_of(F.col("task_id")).alias("task_id"), on, F.coalesce(F.col("choices"), F.expr("map()").cast("map<string,array<string>>")).alias("quire_choices")).dropDuplicates(["task_id", on])
    rows = own.join(known, "task_id", "left").join(there, ["task_id", on], "left")
    no_task, no_region = F.col("quire_task").isNull(), F.col("quire_choices").isNull()
    sentinel = lambda value: F.when(no_task, NO_TASK).when(no_region, BAD_INDEX).otherwise(value)
    rows = rows.withColumn("_join", F.when(no_task, "no_task").when(no_region, "bad_gt_index").otherwise("ok"))
    for k in keys:
        rows = rows.withColumn(k, sentinel(choice(F.col("quire_choices"), k)))
    for k in data_keys:
        rows = rows.withColumn(f"task_data.{k}", sentinel(data_value(F.col("quire_data"), k)))
    return rows.drop("quire_data", "quire_task", "quire_choices")


def strata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, stratum, n, mean_ned, micro_ned) of every value of every column and over all, in one aggregation."""
    named = [F.struct(F.lit(c).alias("dimension"), F.col(f"`{c}`").cast("string").alias("stratum")) for c in columns]
    spread = rows.select("ned", "gt_norm", "pred_norm", F.inline(F.array(*named, F.struct(F.lit("__all__").alias("dimension"), F.lit("").alias("stratum")))))
    return spread.groupBy("dimension", "stratum").agg(F.count("*").alias("n"), F.avg("ned").alias("mean_ned"), micro().alias("micro_ned"))


def ranked(found: DataFrame) -> DataFrame:
    """strata with their place within a dimension: most rows first, then by name."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "stratum")))


def summary(rows: DataFrame, source: str = "source_file") -> DataFrame:
    """One row: rows, files, rows that found no task or region."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct(source).alias("files"), F.count_if(F.col("_join") != "ok").alias("skipped"))
