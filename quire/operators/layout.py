"""Layout alignment: regions with the text spans that lie on them, joined on the page with the overlap as residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import metrics as M
from quire.functions.normalize import TextConfig, normalize
from quire.sources.predictions import layout_spans, line_spans

MIN_IOU = 0.05


def touches(region: Column, corners: Column, span: Column, min_iou: float = MIN_IOU) -> Column:
    """Whether the span overlaps the region enough or has its centre in it. corners: the region's polygon or null."""
    mid = G.center(span)
    in_box = mid["x"].between(region["x0"], region["x1"]) & mid["y"].between(region["y0"], region["y1"])
    by_polygon = (G.iou_polygon_box(corners, span) >= min_iou) | G.inside_polygon(mid["x"], mid["y"], corners)
    return F.when(corners.isNotNull(), by_polygon).otherwise((G.iou(region, span) >= min_iou) | in_box)


def region_shapes(regions: DataFrame) -> DataFrame:
    """regions with box and, where they are turned, corners (an upright polygon is its box); bbox in percent."""
    turned = F.coalesce(F.col("bbox")["rotation"].try_cast("double"), F.lit(0.0)) != 0
    return regions.withColumns({"box": G.from_percent(F.col("bbox")), "corners": F.when(turned, G.polygon(F.col("bbox")))})


def overlaps(regions: DataFrame, spans: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    """(task_id, gt_index, span_index, iou, span, text) of all touching pairs. Boxes that share no area and no centre are
    dropped by comparisons before any polygon is built."""
    shaped = region_shapes(regions).select("task_id", "gt_index", "box", "corners").filter("box is not null")
    own = spans.select("task_id", "span_index", F.col("box").alias("span"), F.col("text") if "text" in spans.columns else F.lit(None).cast("string").alias("text"))
    a, b = F.col("box"), F.col("span")
    apart = (a["x1"] < b["x0"]) | (b["x1"] < a["x0"]) | (a["y1"] < b["y0"]) | (b["y1"] < a["y0"])
    met = shaped.join(own, "task_id").filter(F.col("corners").isNotNull() | ~apart)
    met = met.filter(touches(a, F.col("corners"), b, min_iou))
    score = F.when(F.col("corners").isNotNull(), G.iou_polygon_box(F.col("corners"), b)).otherwise(G.iou(a, b))
    return met.select("task_id", "gt_index", "span_index", score.alias("iou"), "span", "text")


def align_layout(regions: DataFrame, spans: DataFrame, config: TextConfig = TextConfig(), min_iou: float = MIN_IOU) -> DataFrame:
    """A row for each region: the texts of its spans in reading order, one space between, and the score.

    Regions without a box have NED 1, whatever their text; a span may serve several regions."""
    order = F.struct(G.reading_row(F.col("span")).alias("row"), F.col("span")["x0"].alias("x"), "span_index", "text")
    merged = overlaps(regions, spans, min_iou).groupBy("task_id", "gt_index").agg(F.array_sort(F.collect_list(order)).alias("parts"))
    out = regions.join(merged, ["task_id", "gt_index"], "left")
    pred = F.coalesce(F.array_join(F.col("parts.text"), " "), F.lit(""))
    out = out.select("task_id", "gt_index", "region_id", "bbox", F.coalesce("gt_raw", F.lit("")).alias("gt_raw"), pred.alias("pred_raw"), F.coalesce(F.col("parts.span_index"), F.array().cast("array<int>")).alias("pred_indices"))
    out = out.withColumns({"gt_norm": normalize(F.col("gt_raw"), config), "pred_norm": normalize(F.col("pred_raw"), config)})
    ned = F.when(G.from_percent(F.col("bbox")).isNull(), 1.0).otherwise(M.ned(F.col("gt_norm"), F.col("pred_norm")))
    some = F.size("pred_indices") > 0
    return out.withColumns({
        "ned": ned, "similarity": 1 - ned, "pred_segment_start": F.when(some, F.array_min("pred_indices")).otherwise(0),
        "pred_segment_end": F.when(some, F.array_max("pred_indices") + 1).otherwise(0),
    }).drop("bbox")


def as_regions(spans: DataFrame) -> DataFrame:
    """Spans of one document as regions, to compare two documents with each other."""
    b = F.col("box")
    pct = F.struct((b["x0"] * 100).alias("x"), (b["y0"] * 100).alias("y"), ((b["x1"] - b["x0"]) * 100).alias("width"), ((b["y1"] - b["y0"]) * 100).alias("height"), F.lit(0.0).alias("rotation"))
    return spans.select("task_id", F.col("span_index").alias("gt_index"), F.concat(F.lit("span_"), F.col("span_index").cast("string")).alias("region_id"), pct.alias("bbox"), F.col("text").alias("gt_raw"))


def align_recognizer_files(regions: DataFrame, pages: DataFrame, config: TextConfig = TextConfig(), min_iou: float = MIN_IOU) -> DataFrame:
    """Regions against recognizer files (task_id, rec_texts, rec_boxes, as sources.predictions.recognizer_pages reads them)."""
    return align_layout(regions, line_spans(pages), config, min_iou)


def align_layout_files(regions: DataFrame, docs: DataFrame, config: TextConfig = TextConfig(), min_iou: float = MIN_IOU, page_no: int = 1) -> DataFrame:
    """Regions against layout documents (task_id, pages, texts), one of them a task."""
    return align_layout(regions, layout_spans(docs, page_no), config, min_iou)


def align_documents(truth: DataFrame, predicted: DataFrame, config: TextConfig = TextConfig(), min_iou: float = MIN_IOU, page_no: int = 1) -> DataFrame:
    """Two layout documents of each task with each other: the texts of the first are the regions."""
    return align_layout(as_regions(layout_spans(truth, page_no)), layout_spans(predicted, page_no), config, min_iou)
