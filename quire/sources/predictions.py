"""Predictions: page texts, layout documents, recognizer JSON, page images, and where to find them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import jsontext as J
from quire.functions.normalize import strip

IMAGES = "*.{png,jpg,jpeg,tif,tiff,bmp,webp,PNG,JPG,JPEG,TIF,TIFF,BMP,WEBP}"
BOX4 = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
LAYOUT = f"pages map<string,struct<size:struct<width:double,height:double>>>, texts array<struct<text:string,orig:string,label:string,prov:array<struct<page_no:int,bbox:{BOX4}>>>>"


def page_texts(spark: SparkSession, path: str, form: str = "auto", json_key: str | None = None, native: bool = True) -> DataFrame:
    """(path, task_id, text, error) of a folder's files, whole. form: auto (by the suffix), text or json; native: files
    with the names of recognizer or layout output are read by their own form. What cannot be read has an error."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    name = F.element_at(F.split("path", "/"), -1)
    read = raw.select("path", F.regexp_replace(name, "\\.[^.]*$", "").alias("task_id"), J.file_texts(name, F.col("raw"), form, json_key, native).alias("r"))
    return read.select("path", "task_id", "r.text", "r.error")


def default_path(folder: str, task_id: Column, suffix: str = ".md") -> Column:
    """Where a task's prediction lies if no map names it."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), task_id.cast("string"), F.lit(suffix))


def mapped(tasks: DataFrame, paths: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions of tasks by a map (task_id, path), and the tasks whose file is missing."""
    named = tasks.select(F.col("task_id").cast("string").alias("task_id")).join(paths.withColumnRenamed("path", "wanted"), "task_id")
    found = named.join(texts.select(F.col("path").alias("wanted"), "text"), "wanted", "left")
    return found.filter("text is not null").select("task_id", "wanted", "text"), found.filter("text is null").select("task_id", "wanted")


def candidates(raw: Column, folder: str, file: str = "docling.md", moved: tuple[str, str] = ("results/out_docling", "results/model_outputs/out_docling"), root: str = "") -> Column:
    """Where a map's path may point, best first: as it is, beside the map, the other tree, the page's own folder."""
    other = F.when(raw.contains(moved[1]), F.replace(raw, F.lit(moved[1]), F.lit(moved[0]))).when(raw.contains(moved[0]), F.replace(raw, F.lit(moved[0]), F.lit(moved[1])))
    page = F.regexp_extract(raw, "(?i)page_(\\d+)", 1)
    own = F.when(page != "", F.concat(F.lit(f"{root or folder}/page_"), F.lpad(page.cast("int").cast("string"), 4, "0"), F.lit(f"/{file}")))
    return F.array_compact(F.array(raw, F.concat(F.lit(f"{folder}/"), raw), other, F.concat(F.lit(f"{folder}/"), other), own))


def resolved(wanted: DataFrame, there: DataFrame, folder: str, **more) -> DataFrame:
    """wanted (task_id, path) with `found`, the first candidate that exists in there (path), or null."""
    rows = wanted.select("task_id", "path", F.posexplode_outer(candidates(F.col("path"), folder, **more)).alias("rank", "try"))
    met = rows.join(there.select(F.col("path").alias("try"), F.lit(True).alias("ok")).distinct(), "try", "left")
    return met.groupBy("task_id", "path").agg(F.min_by("try", F.when(F.col("ok"), F.col("rank"))).alias("found"))


def wanted_index(path: Column, explicit: Column, inner_id: Column) -> Column:
    from_path = F.nullif(F.regexp_extract(path, "(?i)page_(\\d+)", 1), F.lit("")).cast("int")
    return F.coalesce(explicit, from_path, inner_id - 1, F.lit(0))


def document_index(path: Column, explicit: Column, inner_id: Column, n: Column) -> Column:
    """Which of a list's documents: the explicit index, the page number in the path, inner_id - 1, or the first; within
    bounds. An empty list is an error."""
    at = F.greatest(F.lit(0), F.least(wanted_index(path, explicit, inner_id), n - 1))
    return F.when(n <= 0, F.raise_error(F.lit("an empty list of documents"))).otherwise(at)


def index_note(path: Column, explicit: Column, inner_id: Column, n: Column) -> Column:
    """A note where the wanted index lies outside the list, else null."""
    at = wanted_index(path, explicit, inner_id)
    return F.when((at < 0) | (at >= n), F.format_string("document index %s of %s was clamped", at, n))


def layout_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_index, pages, texts) of layout JSON files, each one document or a list of them."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    kind = "struct<" + LAYOUT.replace("pages map", "pages:map").replace("texts array", "texts:array") + ">"
    many = strip(F.col("value")).startswith("[")
    docs = F.when(many, F.from_json("value", f"array<{kind}>")).otherwise(F.array(F.from_json("value", kind)))
    return raw.select("path", F.posexplode(docs).alias("doc_index", "d")).select("path", "doc_index", "d.*")


def layout_spans(docs: DataFrame, page_no: int = 1, key: str = "task_id") -> DataFrame:
    """(key, span_index, text, box, page_no): texts with a place on the page, the first that has an area."""
    size = F.coalesce(F.try_element_at("pages", F.lit(str(page_no))), F.get(F.map_values("pages"), F.lit(0)))["size"]
    flat = size.isNull() | (size["width"] <= 0) | (size["height"] <= 0)
    sized = F.when(flat, F.raise_error(F.lit("a page of a layout document has no size"))).otherwise(size)
    rows = docs.select(key, sized.alias("size"), F.posexplode("texts").alias("span_index", "t"))
    w, h = F.col("size.width"), F.col("size.height")
    text = strip(F.coalesce(F.nullif(strip(F.col("t.text")), F.lit("")), F.col("t.orig"), F.lit("")))
    here = F.filter(F.col("t.prov"), lambda p: (p["page_no"].isNull() | (p["page_no"] == page_no)) & p["bbox"].isNotNull())
    boxed = F.transform(here, lambda p: F.struct(G.from_document(p["bbox"], w, h).alias("box"), F.coalesce(p["page_no"], F.lit(page_no)).alias("page_no")))
    placed = F.filter(boxed, lambda p: G.area(p["box"]) > 0)
    # the first place comes out of a generator, so that the box is worked out once however often it is used
    return rows.select(key, "span_index", text.alias("text"), F.inline(F.slice(placed, 1, 1))).filter("text <> ''")


def recognizer_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, rec_texts, rec_boxes, error) of recognizer files, one page a file."""

    @F.pandas_udf("rec_texts array<string>, rec_boxes array<array<double>>, error string")
    def run(raws: pd.Series) -> pd.DataFrame:
        out = []
        for raw in raws:
            try:
                out.append((*J.lines_and_boxes(raw or ""), None))
            except (ValueError, TypeError) as problem:
                out.append((None, None, str(problem)))
        return pd.DataFrame(out, columns=["rec_texts", "rec_boxes", "error"])

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), run("value").alias("r"))
    return raw.select("path", "r.*")


def line_spans(pages: DataFrame, key: str = "task_id") -> DataFrame:
    """Spans of recognizer lines (rec_texts, rec_boxes in pixels). The page's size is the farthest right and bottom of any
    box, at least 1; arrays of unlike length are an error."""
    even = F.when(F.size("rec_texts") != F.size("rec_boxes"), F.raise_error(F.lit("rec_texts and rec_boxes differ in length"))).otherwise(F.col("rec_boxes"))
    sized = pages.withColumn("quire_boxes", even)
    far = lambda k: F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform("quire_boxes", lambda b: b[k])), F.lit(1.0)))
    rows = sized.select(key, far(2).alias("w"), far(3).alias("h"), F.posexplode(F.arrays_zip(F.col("rec_texts").alias("text"), F.col("quire_boxes").alias("b"))).alias("span_index", "s"))
    b = F.col("s")["b"]
    text = strip(F.coalesce(F.col("s")["text"], F.lit("")))
    return rows.select(key, "span_index", text.alias("text"), G.box(b[0] / F.col("w"), b[1] / F.col("h"), b[2] / F.col("w"), b[3] / F.col("h")).alias("box"), F.lit(1).alias("page_no")).filter("text <> ''")


def lines_as_layout(pages: DataFrame, key: str = "task_id") -> DataFrame:
    """Recognizer lines as a layout document (pages, texts) whose y runs upwards from the page's bottom."""
    n = F.least(F.size("rec_texts"), F.size("rec_boxes"))
    far = lambda k: F.array_max(F.transform("rec_boxes", lambda b: b[k]))
    width, height = far(2), far(3)
    pair = F.arrays_zip(F.slice("rec_texts", 1, n).alias("t"), F.slice("rec_boxes", 1, n).alias("b"))
    sized = pages.select(key, pair.alias("pair"), width.alias("w"), height.alias("h")).filter("w > 0 and h > 0")
    h = F.col("h")
    bbox = lambda b: F.struct(b[0].alias("l"), (h - b[1]).alias("t"), b[2].alias("r"), (h - b[3]).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    item = lambda p: F.struct(p["t"].alias("text"), p["t"].alias("orig"), F.lit("text").alias("label"), F.array(F.struct(F.lit(1).alias("page_no"), bbox(p["b"]).alias("bbox"))).alias("prov"))
    size = F.create_map(F.lit("1"), F.struct(F.struct(F.col("w").alias("width"), h.alias("height")).alias("size")))
    return sized.select(key, size.alias("pages"), F.transform("pair", item).alias("texts"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(page_index, path, content) of a folder's images by path. Places are dealt over the paths alone, all of which Spark's
    own listing holds on the driver already; the contents stay where they are read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(folder)
    places = raw.agg(F.array_sort(F.collect_list("path")).alias("paths")).select(F.posexplode("paths").alias("page_index", "path"))
    return raw.join(places, "path").select("page_index", "path", "content")


def sidecars(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """(path, value, error): JSON files one a row; what does not parse has an error instead."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=glob).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    parsed = F.try_parse_json("raw")
    return raw.select("path", F.to_json(parsed).alias("value"), F.when(parsed.isNull(), F.lit("not valid JSON")).alias("error"))


def page_images(wanted: DataFrame, there: DataFrame, base: str, images: str | None = None) -> DataFrame:
    """wanted (task_id, image) with `found`, the first place where the image exists in there (path): as named, under base,
    under the images folder by its name, or by what stands behind the first hyphen of its name (upload prefixes)."""
    name = F.element_at(F.split(F.trim("image"), "/"), -1)
    places = [F.trim("image"), F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(F.trim("image"), "^/+", ""))]
    if images is not None:
        folder = F.lit(images.rstrip("/") + "/")
        places += [F.concat(folder, name), F.when(name.contains("-"), F.concat(folder, F.regexp_replace(name, "^[^-]*-", "")))]
    tried = F.when(F.trim("image") != "", F.array_compact(F.array(*places))).otherwise(F.array().cast("array<string>"))
    rows = wanted.select("task_id", "image", F.posexplode_outer(tried).alias("rank", "try"))
    met = rows.join(there.select(F.col("path").alias("try"), F.lit(True).alias("ok")).distinct(), "try", "left")
    return met.groupBy("task_id", "image").agg(F.min_by("try", F.when(F.col("ok"), F.col("rank"))).alias("found"))
