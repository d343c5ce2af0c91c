"""From raw documents to token digests: five stages, each over all rows that the one before kept.

Language ID drops documents without a known language; line dedup removes repeated and nearly repeated
lines (and documents that consist of nothing else); SimHash keeps one document of each group of near
copies; decontamination drops documents that hold benchmark passages; BPE encodes and decodes the rest.

Defined cases, as the operators' own docstrings state them: a null text has no language and goes in the first stage,
as an empty one does; very long texts go through whole; rows without an id are documents of their own; of repeated
rows and of ties one stays, by id and hash of the text; an empty table gives no rows; extra columns, whatever their
names, stay until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, decontaminate, langid, linededup, simhash
from quire.llm.common import stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", lines),
    ("simhash", near_copies),
    ("decontamination", leaks),
    ("bpe", tokens),
]

#: Learned and hash-based stages have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
