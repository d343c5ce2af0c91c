"""Annotated ground truth: annotation exports, manifests, maps of predictions, and PAGE-XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.normalize import strip
from quire.operators import order

BOX = "struct<x:double,y:double,width:double,height:double,rotation:double>"
RESULT = "struct<id:string,type:string,from_name:string,value:variant>"
TASK = f"id:string,inner_id:int,data:variant,annotations:array<struct<result:array<{RESULT}>>>"
MANIFEST = (
    "schema string, region_order string, tasks array<struct<task_id:string,inner_id:int,data:map<string,string>,source_export:string,"
    f"regions:array<struct<region_id:string,bbox_pct:{BOX},transcription_gt:string,choices:map<string,array<string>>>>>>"
)


def _text(value: Column) -> Column:
    """A string, or a list's strings with a space between; stripped, null as empty."""
    many = F.try_variant_get(value, "$.text", "array<string>")
    one = F.try_variant_get(value, "$.text", "string")
    return F.coalesce(strip(F.when(many.isNotNull(), F.array_join(many, " ")).otherwise(one)), F.lit(""))


def export_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(position, task_id, inner_id, data, results): all results of all annotations of a task, in order.

    The file holds a list of tasks, or an object with one under "tasks"."""
    kinds = ", ".join(x.replace(":", " ", 1) for x in TASK.split(",", 3))
    raw = spark.read.schema(f"{kinds}, tasks array<struct<{TASK}>>").json(path, multiLine=True)
    own = F.struct("id", "inner_id", "data", "annotations")
    rows = raw.select(F.input_file_name().alias("source_export"), F.posexplode(F.coalesce("tasks", F.array(own))).alias("k", "t"))
    results = F.flatten(F.filter(F.transform(F.col("t.annotations"), lambda a: a["result"]), lambda r: r.isNotNull()))
    return rows.select(F.monotonically_increasing_id().alias("position"), F.col("t.id").alias("task_id"), F.col("t.inner_id").alias("inner_id"), F.col("t.data").alias("data"), results.alias("results"), "source_export")


def export_regions(tasks: DataFrame, box_name: str = "bbox", text_name: str = "ground_truth_text", region_order: str = "first_seen") -> DataFrame:
    """(task_id, gt_index, region_id, bbox, gt_raw, choices) of the results of tasks; the last result of a kind counts.

    Regions without a rectangle are dropped. region_order: first_seen (by first rectangle) or geometric."""
    rows = tasks.select("task_id", F.posexplode("results").alias("pos", "r")).select("task_id", "pos", "r.*").filter("id is not null")
    v = F.col("value")
    number = lambda k: F.try_variant_get(v, f"$.{k}", "double").alias(k)
    box = F.struct(*map(number, ("x", "y", "width", "height", "rotation")))
    is_box = (F.col("type") == "rectangle") & (F.col("from_name") == box_name)
    is_text = (F.col("type") == "textarea") & (F.col("from_name") == text_name)
    picked = F.coalesce(F.try_variant_get(v, "$.choices", "array<string>"), F.array().cast("array<string>"))
    one = rows.withColumns({"box": F.when(is_box, box), "text": F.when(is_text, _text(v)), "picked": F.when(F.col("type") == "choices", F.struct("from_name", "pos", picked.alias("values")))})
    grouped = one.groupBy("task_id", F.col("id").alias("region_id")).agg(
        F.max_by("box", F.when(F.col("box").isNotNull(), F.col("pos"))).alias("bbox"), F.max_by("text", F.when(F.col("text").isNotNull(), F.col("pos"))).alias("gt_raw"),
        F.array_sort(F.collect_list("picked")).alias("picked"), F.min(F.when(F.col("type") == "rectangle", F.col("pos"))).alias("first_pos"),
    )
    # of several results of a name the last: entries are sorted by name and position
    last = F.filter("picked", lambda p: ~F.exists("picked", lambda q: (q["from_name"] == p["from_name"]) & (q["pos"] > p["pos"])))
    choices = F.map_from_entries(F.transform(last, lambda p: F.struct(p["from_name"], p["values"])))
    found = grouped.filter("bbox is not null").select("task_id", "region_id", "bbox", F.coalesce("gt_raw", F.lit("")).alias("gt_raw"), choices.alias("choices"), "first_pos")
    if region_order == "geometric":
        found = order.geometric(found)
    else:
        found = found.withColumn("place", F.row_number().over(order.Window.partitionBy("task_id").orderBy("first_pos")) - 1)
    return found.select("task_id", F.col("place").alias("gt_index"), "region_id", "bbox", "gt_raw", "choices")


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """tasks (task_id, inner_id, data, source_export, position) and regions of a manifest file."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.posexplode("tasks").alias("position", "t"))
    tasks = rows.select("t.task_id", "t.inner_id", "t.data", "t.source_export", "position")
    each = rows.select("t.task_id", F.posexplode("t.regions").alias("gt_index", "r"))
    return tasks, each.select("task_id", "gt_index", "r.region_id", F.col("r.bbox_pct").alias("bbox"), F.coalesce("r.transcription_gt", F.lit("")).alias("gt_raw"), "r.choices")


def manifest_tasks(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """(position, task): each task with its regions in order, in the form that manifests hold."""
    one = F.struct("gt_index", "region_id", F.col("bbox").alias("bbox_pct"), F.col("gt_raw").alias("transcription_gt"), "choices")
    held = regions.groupBy("task_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["gt_index"] - b["gt_index"]).alias("r"))
    rows = tasks.join(held.select("task_id", F.transform("r", lambda x: x.dropFields("gt_index")).alias("regions")), "task_id", "left")
    return rows.select("position", F.struct("task_id", "inner_id", "data", F.coalesce("regions", F.array()).alias("regions"), "source_export").alias("task"))


def save_manifest(tasks: DataFrame, regions: DataFrame, path: str, region_order: str = "first_seen", schema: str = "manifest", most: int = 100_000) -> None:
    """One JSON document, which one task has to hold: over `most` regions are an error (save_tasks has no bound)."""
    if regions.limit(most + 1).count() > most:
        raise ValueError(f"over {most} regions are not for one document: use save_tasks")
    rows = manifest_tasks(tasks, regions).agg(F.array_sort(F.collect_list(F.struct("position", "task")), lambda a, b: (a["position"] - b["position"]).cast("int")).alias("t"))
    doc = rows.select(F.lit(schema).alias("schema"), F.lit(region_order).alias("region_order"), F.col("t.task").alias("tasks"))
    doc.coalesce(1).write.mode("overwrite").json(path)


def save_tasks(tasks: DataFrame, regions: DataFrame, path: str) -> None:
    """A manifest of any size: one task a line, in files as Spark writes them."""
    rows = manifest_tasks(tasks, regions)
    rows.select("position", "task.*").write.mode("overwrite").json(path)


def load_tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As load_manifest, of what save_tasks wrote."""
    kinds = MANIFEST.split("tasks array<struct<", 1)[1].removesuffix(">>").replace("task_id:", "task_id ", 1).replace(",inner_id:", ", inner_id ", 1).replace(",data:", ", data ", 1).replace(",source_export:", ", source_export ", 1).replace(",regions:", ", regions ", 1)
    rows = spark.read.schema(f"position long, {kinds}").json(path)
    each = rows.select("task_id", F.posexplode("regions").alias("gt_index", "r"))
    return rows.select("task_id", "inner_id", "data", "source_export", "position"), each.select("task_id", "gt_index", "r.region_id", F.col("r.bbox_pct").alias("bbox"), F.coalesce("r.transcription_gt", F.lit("")).alias("gt_raw"), "r.choices")


def prediction_map(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, path) of a JSON object."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("task_id", "path"))


# PAGE-XML

# What the types of regions are called here; any other is a paragraph.
REGION_TYPES = {"text": "paragraph", "paragraph": "paragraph", "header": "header", "footer": "footer", "table": "table_cell", "tablecell": "table_cell", "form": "form_field", "field": "form_field", "handwritten": "handwritten"}
REGION_TYPE = re.compile(r"type:([^;]+);")
PAGE = "array<struct<region_id:string,text_id:string,bbox:struct<x:double,y:double,width:double,height:double>,region_type:string,text:string,page_width:int,page_height:int>>"


def _local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _last_text(equivalents: list[ET.Element]) -> str:
    """The last of several transcriptions, stripped."""
    return (equivalents[-1].text or "").strip() if equivalents else ""


def _under(element: ET.Element, *names: str) -> list[ET.Element]:
    """Descendants of a name, then children of each further name below them."""
    found = [e for e in element.iter() if _local(e) == names[0] and e is not element]
    for name in names[1:]:
        found = [e for parent in found for e in parent if _local(e) == name]
    return found


def region_type(custom: str) -> str:
    found = REGION_TYPE.search(custom)
    return REGION_TYPES.get(found[1].lower().replace(" ", "").strip(), "paragraph") if found else "paragraph"


def page_regions(xml: str) -> list[dict]:
    """Regions with corners: box in percent of the page, type, and the text of all lines in them (or their own)."""
    page = next((e for e in ET.fromstring(xml).iter() if _local(e) == "Page"), None)
    if page is None:
        raise ValueError("no Page in the XML")
    width, height = float(page.get("imageWidth") or 0), float(page.get("imageHeight") or 0)
    share = lambda v, total: 100.0 * v / total if total else 0.0
    out: list[dict] = []
    for region in _under(page, "TextRegion"):
        corners = next((e.get("points") or "" for e in region if _local(e) == "Coords"), "")
        points = [tuple(map(float, p.split(","))) for p in corners.split()]
        if not points:
            continue
        xs, ys = zip(*points, strict=True)
        lines = [_last_text(_under(line, "TextEquiv", "Unicode")) for line in _under(region, "TextLine")]
        own = [u for e in region if _local(e) == "TextEquiv" for u in e if _local(u) == "Unicode"]
        k = len(out)
        out.append({
            "region_id": f"r{k}", "text_id": f"t{k}",
            "bbox": {"x": share(min(xs), width), "y": share(min(ys), height), "width": share(max(xs) - min(xs), width), "height": share(max(ys) - min(ys), height)},
            "region_type": region_type(region.get("custom") or ""), "text": "\n".join(filter(None, lines)) or _last_text(own), "page_width": int(width), "page_height": int(height),
        })
    return out


def page_xml(spark: SparkSession, folder: str) -> DataFrame:
    """(path, gt_index, region_id, bbox, region_type, gt_raw, ...) of a folder's *.xml but mets.xml."""

    @F.pandas_udf(PAGE)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(page_regions)

    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.xml").select(F.input_file_name().alias("path"), "value").filter(~F.lower("path").endswith("/mets.xml"))
    rows = raw.select("path", F.posexplode(run("value")).alias("gt_index", "r"))
    return rows.select("path", "gt_index", "r.region_id", "r.text_id", "r.bbox", "r.region_type", F.col("r.text").alias("gt_raw"), "r.page_width", "r.page_height")


def page_tasks(regions: DataFrame, images: dict[str, str]) -> DataFrame:
    """Annotation tasks (id, data, predictions) as JSON, one row a page; a page without an image is an error."""
    names = regions.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    known = regions.sparkSession.createDataFrame(list(images.items()) or [("", "")], "name string, image string")
    missing = names.join(known, "name", "left_anti").first()
    if missing:
        raise KeyError(f"no image for {missing['name']}")
    box = F.struct(*(F.col("bbox")[k].alias(k) for k in ("x", "y", "width", "height")))
    shape = F.struct(F.col("region_id").alias("id"), F.lit("region_type").alias("from_name"), F.lit("rectanglelabels").alias("type"), F.to_json(F.struct(F.col("bbox.*"), F.array("region_type").alias("rectanglelabels"))).alias("value"))
    text = F.struct(F.col("text_id").alias("id"), F.lit("transcription").alias("from_name"), F.lit("textarea").alias("type"), F.to_json(F.struct(F.array("gt_raw").alias("text"))).alias("value"))
    rows = regions.withColumn("name", F.element_at(F.split("path", "/"), -1)).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("gt_index", F.array(shape, text).alias("r")))).alias("all"))
    out = F.struct(F.struct("image").alias("data"), F.array(F.struct(F.flatten(F.col("all.r")).alias("result"))).alias("predictions"))
    return rows.join(known, "name").select("name", F.to_json(out).alias("task"))
