"""Orders of a page's regions; each adds the place from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G


def first_seen(results: DataFrame) -> DataFrame:
    """(task_id, region_id, place): ids in the order of their first rectangle. results: task_id, pos, id, type."""
    seen = results.filter("type = 'rectangle' and id is not null").groupBy("task_id", F.col("id").alias("region_id")).agg(F.min("pos").alias("first_pos"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("first_pos")) - 1)


def geometric(regions: DataFrame) -> DataFrame:
    """By the middle of the box: height first, then across; a box that cannot be read counts as (0, 0)."""
    v = lambda k: F.col("bbox")[k].try_cast("double")
    cy, cx = v("y") + v("height") / 2, v("x") + v("width") / 2
    ok = cy.isNotNull() & cx.isNotNull()
    w = Window.partitionBy("task_id").orderBy(F.when(ok, cy).otherwise(0.0), F.when(ok, cx).otherwise(0.0), "first_pos")
    return regions.withColumn("place", F.row_number().over(w) - 1)


def reading(regions: DataFrame, index: str = "gt_index") -> DataFrame:
    """By rows of a tenth of the page's height, then from the left; boxes without an area stand at the top left corner."""
    b = G.from_percent(F.col("bbox"))
    corner = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1e-6).alias("x1"), F.lit(1e-6).alias("y1"))
    rows = regions.withColumn("quire_box", F.when(b.isNull() | (G.area(b) <= 0), corner).otherwise(b))
    w = Window.partitionBy("task_id").orderBy(G.reading_row(F.col("quire_box")), F.col("quire_box")["x0"], index)
    return rows.withColumn("place", F.row_number().over(w) - 1).drop("quire_box")
