"""Recognizer runs: the plug-in surface, pages as tasks, and their times, texts and errors.

A recognizer is any class with load() and read(content) -> text; it is made and loaded once in each task, and
loading is not part of a page's time. Errors stay rows of their page and model.
"""

from __future__ import annotations

import hashlib
import resource
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.align import PAGE_BREAK

RUN = "model string, page_index int, elapsed double, text string, error string, native string, json string, peak_mb double"


class Recognizer:
    """The base of recognizers."""

    uses_gpu = False
    markdown = False
    extension = ".md"

    def load(self) -> None:
        """Whatever is needed before the first page."""

    def page(self, index: int) -> None:
        """Told the index (from 0) of the page that is read next."""

    def read(self, content: bytes) -> str:
        raise NotImplementedError

    def native(self) -> str | None:
        """The text of the page read last in the recognizer's own form, if it has one."""

    def json(self) -> str | None:
        """What the recognizer has to say of the page read last, as JSON, if anything."""


class Echo(Recognizer):
    """A stub without a model: the bytes as text, or their digest where they are none."""

    def read(self, content: bytes) -> str:
        try:
            return bytes(content).decode()
        except UnicodeDecodeError:
            return hashlib.sha256(content).hexdigest()


REGISTRY: dict[str, Callable[[], Recognizer]] = {"echo": Echo}


def register(name: str, make: Callable[[], Recognizer]) -> None:
    REGISTRY[name.lower()] = make


def known(names: list[str]) -> tuple[list[str], list[str]]:
    """Registered names in the order asked for, and the others."""
    low = [n.lower() for n in names]
    return [n for n in low if n in REGISTRY], [n for n in low if n not in REGISTRY]


def chosen_pages(pages: DataFrame, wanted: list[int] | None) -> DataFrame:
    """Pages in the order asked for, repeats kept, those that do not exist left out; slot: the place in that order."""
    if wanted is None:
        return pages.withColumn("slot", F.col("page_index"))
    asked = pages.sparkSession.createDataFrame([(k, p) for k, p in enumerate(wanted)], "slot int, page_index int")
    return pages.join(F.broadcast(asked), "page_index")  # as long as the list in the call


def run(pages: DataFrame, models: list[str], tasks: int | None = None) -> DataFrame:
    """(model, page_index, elapsed, text, error, native, json, peak_mb) of every page (page_index, content) and model;
    peak_mb: most memory that the task's process has held so far."""
    makers = {m: REGISTRY[m] for m in known(models)[0]}
    work = pages.select("page_index", "content", F.explode(F.array(*map(F.lit, makers))).alias("model"))
    work = work.repartition(tasks, "model", "page_index") if tasks else work.repartition("model", "page_index")

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Recognizer | Exception] = {}
        for batch in batches:
            out = []
            for index, content, name in batch.itertuples(index=False):
                if name not in held:
                    try:
                        held[name] = makers[name]()
                        held[name].load()
                    except Exception as problem:  # noqa: BLE001
                        held[name] = problem
                model, text, error, own, said = held[name], None, None, None, None
                if not isinstance(model, Exception):
                    model.page(index)
                began = time.perf_counter()
                try:
                    if isinstance(model, Exception):
                        raise model
                    text = model.read(content)
                except Exception as problem:  # noqa: BLE001
                    error = f"{type(problem).__name__}: {problem}"
                took = time.perf_counter() - began
                if error is None:
                    own, said = model.native(), model.json()
                out.append((name, index, took, text, error, own, said, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024))
            yield pd.DataFrame(out, columns=["model", "page_index", "elapsed", "text", "error", "native", "json", "peak_mb"])

    return work.mapInPandas(one, RUN)


#: Accuracy of the approximate ranks between which an exact one is looked for; the margin is twice its error.
ACCURACY = 10_000


def at_place(rows: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """(by, at): the value at place int(n * q) of each group's sorted values, without bringing a group together:
    approximate quantiles fence off a small range, and only the distinct values within it are ranked."""
    own = rows.select(F.col(by).alias("g"), F.col(value).alias("v")).filter("v is not null")
    margin = 2 / ACCURACY
    ends = F.percentile_approx("v", F.array(F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin))), F.lit(ACCURACY))
    fence = own.groupBy("g").agg(F.count("*").alias("n"), ends.alias("e")).select("g", F.floor(F.col("n") * F.lit(q)).alias("k"), F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
    held = own.join(fence.select(F.col("g").alias("g2"), "k", "low", "high"), F.col("g").eqNullSafe(F.col("g2")))
    near = held.filter("v <= high").groupBy("g", "k", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("g").orderBy(F.asc_nulls_first("v"))
    reached = near.withColumn("upto", F.sum("c").over(upto)).filter("upto > k")
    return reached.groupBy(F.col("g").alias(by)).agg(F.min("v").alias("at"))


def timings(runs: DataFrame, by: str = "model", value: str = "elapsed") -> DataFrame:
    """Sum, mean, sample deviation (0 for one), extremes and quartiles by place (the extremes for fewer than four)."""
    out = runs.groupBy(by).agg(
        F.count(value).alias("pages"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("least"), F.max(value).alias("greatest"),
    )
    for name, q, few in (("p25", 0.25, "least"), ("p75", 0.75, "greatest")):
        place = at_place(runs, by, value, q).select(F.col(by).alias("quire_g"), F.col("at").alias("quire_at"))
        out = out.join(place, F.col(by).eqNullSafe(F.col("quire_g")), "left").withColumn(name, F.when(F.col("pages") >= 4, F.col("quire_at")).otherwise(F.col(few))).drop("quire_g", "quire_at")
    return out


def combined(runs: DataFrame, *by: str, order: str = "page_index", text: str = "text", separator: str = PAGE_BREAK) -> DataFrame:
    """The texts of a model's pages as one, a page break between, with its length."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return runs.groupBy(*by).agg(parts.alias("quire_parts")).select(*by, F.array_join(F.col("quire_parts.t"), separator).alias("text"), F.length(F.array_join(F.col("quire_parts.t"), separator)).alias("total_chars"))


def results(runs: DataFrame) -> DataFrame:
    """One row a model: status, timings, characters of the combined text (breaks included), failed pages, the first error and,
    if runs have it, the peak of memory. A model with an error has status error."""
    chars = F.sum(F.length("text")) + F.lit(len(PAGE_BREAK)) * (F.count("text") - 1)
    peak = [F.max("peak_mb").alias("peak_mb")] if "peak_mb" in runs.columns else []
    all_pages = runs.groupBy("model").agg(F.min("error").alias("error"), F.count("error").alias("failed"), chars.alias("total_chars"), *peak)
    return all_pages.join(timings(runs.filter("error is null")), "model", "left").withColumn("status", F.when(F.col("failed") > 0, "error").otherwise("ok"))


def exports(texts: DataFrame, also_txt: bool = False) -> DataFrame:
    """(model, name, text): the files that combined texts (model, text) go to. Models that write markdown have a file with
    their own extension, and one of plain text if asked for; others one of plain text."""
    kinds = {m: make() for m, make in REGISTRY.items()}
    ends = {m: [k.extension, *([".txt"] if also_txt else [])] if k.markdown else [".txt"] for m, k in kinds.items()}
    known = texts.sparkSession.createDataFrame([(m, e) for m, es in ends.items() for e in es], "model string, quire_end string")
    return texts.join(F.broadcast(known), "model").select("model", F.concat("model", F.lit("_output"), "quire_end").alias("name"), "text")  # as many rows as models are registered


def summary_table(found: DataFrame, metadata: dict[str, str] | None = None) -> str:
    """results() as plain text for people, one line a registered model."""
    lines = [f"{k}: {v}" for k, v in (metadata or {}).items()] + [f"{'model':<16} {'status':<6} {'total s':>9} {'s a page':>17} {'RAM MB':>8} {'chars':>10}"]
    for r in found.filter(F.col("model").isin(list(REGISTRY))).orderBy("model").collect():
        if r["status"] == "ok":
            lines.append(f"{r['model']:<16} {'ok':<6} {r['total']:>9.2f} {r['mean']:>8.2f} ± {r['std']:>6.2f} {(r['peak_mb'] if 'peak_mb' in r else 0) or 0:>8.0f} {r['total_chars']:>10,}")
        else:
            lines.append(f"{r['model']:<16} {'error':<6} {(r['error'] or '')[:50]}")
    return "\n".join(lines)
