"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A batch holds changes (op: insert, delete or revise) with the documents' old and new texts and, for revisions that
move a document, its old source and language; each change is one or two signed counts of documents and tokens,
summed per batch and key before any shuffle of more than one row per batch, key and task. All batches of a call are
counted in one pass. A batch is committed by one rename to `batch_id=<id>` in the ledger, so it is there whole or not
at all, and committing it again, by a retry or by mistake, changes nothing. Totals are the sums over the committed
batches; compact() folds them into one snapshot, again by one rename, which changes no total and forgets no id.

Tokenizer versions are runs of characters over the whole text: `space-1` counts runs without ASCII white
space, `word-1` runs of letters and digits (any character beyond ASCII counts as a letter). As no character beyond ASCII
ends a run, runs are counted on the bytes of many texts at once, all versions in one pass; a pattern of another form is refused.

Defined cases: null source or language is a key of its own; a null or empty text has 0 tokens and counts as a document
(very long ones are counted whole); repeated rows count as often as they come, and order within a batch does not
matter; keys whose totals are all 0 are left out; an empty table has no totals; other columns are not looked at; an
unknown op, or a batch id that is no plain name, is an error.
"""

from __future__ import annotations

import functools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import vectext as V
from quire.llm.common import mapped, shared_dir

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Version: what a token is.
VERSIONS = {"space-1": "[^\\x20\\x09-\\x0D]+", "word-1": "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"}
CHANGE = "op string, source string, lang string, text string, old_source string, old_lang string, old_text string"


@functools.cache
def token_bytes(token: str) -> np.ndarray:
    """Whether each of 256 bytes is of a token, for a pattern of runs of all characters but some of ASCII."""
    if not re.fullmatch(r"\[\^(\\x[0-7][0-9A-F](-\\x[0-7][0-9A-F])?)+\]\+", token):
        raise ValueError(f"not runs of all characters but some of ASCII: {token}")
    return np.array([b >= 128 or re.fullmatch(token, chr(b)) is not None for b in range(256)])


def n_tokens(texts: V.Texts, token: str) -> np.ndarray:
    """Tokens of each text: bytes of a token that begin their text or come after one of none."""
    on = token_bytes(token)[texts.data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    edge = texts.at[:-1][np.diff(texts.at) > 0]
    first[edge] = on[edge]
    return np.diff(np.searchsorted(np.flatnonzero(first), texts.at))


def _counted(by: int):
    """A function from rows whose column `by` is a text to the rows with its numbers of tokens, one for each version."""

    def run(batches):
        for batch in batches:
            for row, end, texts in V.slices(batch.column(by)):
                counts = [pa.array(n_tokens(texts, token), pa.int64()) for token in VERSIONS.values()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, end - row) for k in range(by)), *counts], [*batch.schema.names[:by], *(f"n{k}" for k in range(len(counts)))])

    return run


def signed(changes: DataFrame, *by: str) -> DataFrame:
    """by, source, lang, d, text: +1 for what a change brings, -1 for what it takes. A change without columns for the old
    key takes from its own."""
    old = lambda c: F.col(f"old_{c}") if f"old_{c}" in changes.columns else F.col(c)
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    come = F.when(op != "delete", F.struct("source", "lang", F.lit(1).alias("d"), "text"))
    go = F.when(op != "insert", F.struct(old("source").alias("source"), old("lang").alias("lang"), F.lit(-1).alias("d"), F.col("old_text").alias("text")))
    return changes.select(*by, F.inline(F.array_compact(F.array(come, go))))


def delta(changes: DataFrame, *by: str) -> DataFrame:
    """Signed counts per key (and by) of changes: op, source, lang, text, old_text and, if given, old_source, old_lang."""
    texts = signed(changes, *by).select(*by, "source", "lang", "d", "text")
    kept = [f"`{name}` {kind}" for name, kind in texts.dtypes[:-1]]
    counted = mapped(texts, _counted(len(kept)), ", ".join([*kept, *(f"n{k} long" for k in range(len(VERSIONS)))]))
    per = F.array(*(F.struct(F.lit(name).alias("tokenizer"), (F.col("d") * F.col(f"n{k}")).alias("n")) for k, name in enumerate(VERSIONS)))
    rows = counted.select(*by, "source", "lang", "d", F.inline(per))
    return rows.groupBy(*by, *KEYS).agg(F.sum("d").cast("long").alias("n_docs"), F.sum("n").alias("n_tokens"))


class Ledger:
    """Committed deltas in a folder that all can reach."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}"

    def _at(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, prefix: str) -> list[str]:
        fs, p = self._at()
        return sorted(n for n in ([f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []) if n.startswith(prefix))

    def _settle(self, aside: str, name: str) -> bool:
        """Whether this call put the folder in its place."""
        fs, source = self._at(aside)
        _, target = self._at(name)
        return not fs.exists(target) and fs.rename(source, target)

    def _drop(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The last snapshot, and the ids of the batches in it."""
        there = self._names("snapshot-")
        if not there:
            return None, set()
        return there[-1], {r[0] for r in self.spark.read.schema("batch_id string").parquet(f"{self.path}/{there[-1]}/ids").collect()}

    def batches(self) -> set[str]:
        return self._snapshot()[1] | {n.removeprefix("batch_id=") for n in self._names("batch_id=")}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether this call committed the batch."""
        return self.commit_all(changes.withColumn("batch_id", F.lit(batch_id)), [batch_id]) == [batch_id]

    def commit_all(self, changes: DataFrame, ids: list[str]) -> list[str]:
        """The ids of the batches that this call committed, in the order given. changes has a column batch_id; those of
        batches that are there already, or not named in ids, are passed over before anything is counted."""
        if odd := [i for i in ids if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", i)]:
            raise ValueError(f"not plain names: {odd}")
        held = self.batches()
        new = [i for i in dict.fromkeys(ids) if i not in held]
        if not new:
            return []
        aside = f"_aside-{uuid.uuid4().hex}"
        delta(changes.filter(F.col("batch_id").isin(new)), "batch_id").coalesce(1).write.partitionBy("batch_id").parquet(f"{self.path}/{aside}")
        for i in new:  # a batch without changes is committed as well
            fs, p = self._at(f"{aside}/batch_id={i}")
            fs.mkdirs(p)
        done = [i for i in new if self._settle(f"{aside}/batch_id={i}", f"batch_id={i}")]
        self._drop(aside)
        return done

    def compact(self) -> None:
        """Folds all committed batches into one snapshot, then removes their folders."""
        last, folded = self._snapshot()
        loose = self._names("batch_id=")
        if not loose:
            return
        aside = f"_aside-{uuid.uuid4().hex}"
        ids = folded | {n.removeprefix("batch_id=") for n in loose}
        self._sums(last, [n for n in loose if n.removeprefix("batch_id=") not in folded]).coalesce(1).write.parquet(f"{self.path}/{aside}/sums")
        self.spark.createDataFrame([(i,) for i in sorted(ids)], "batch_id string").coalesce(1).write.parquet(f"{self.path}/{aside}/ids")
        if self._settle(aside, f"snapshot-{int(last.rpartition('-')[2]) + 1 if last else 0:012d}"):
            for n in [*loose, *([last] if last else [])]:
                self._drop(n)

    def _sums(self, snapshot: str | None, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in names] + ([f"{self.path}/{snapshot}/sums"] if snapshot else [])
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """Totals of what is committed; what a compaction left behind of folded batches is not counted again."""
        last, folded = self._snapshot()
        sums = self._sums(last, [n for n in self._names("batch_id=") if n.removeprefix("batch_id=") not in folded])
        return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def load(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Totals of docs, reached through every kind of change: a third of them is inserted as it is; a third inserted under
    another source with no text and then revised; a third inserted, deleted and inserted again. All batches are counted in
    one pass, committed, committed again and compacted."""
    ledger = Ledger(spark, path)
    none = F.lit(None).cast("string")

    def change(batch: str, op: str, source: Column, text: Column, old_source: Column = none, old_text: Column = none) -> Column:
        return F.struct(F.lit(batch).alias("batch_id"), F.lit(op).alias("op"), source.alias("source"), F.col("lang"), text.alias("text"), old_source.alias("old_source"), F.col("lang").alias("old_lang"), old_text.alias("old_text"))

    source, text, moved = F.col("source").cast("string"), F.col("text"), F.lit("not yet sorted")
    kind = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    inserted = change("load", "insert", source, text)
    steps = F.when(kind == 0, F.array(inserted)).when(kind == 1, F.array(change("load", "insert", moved, none), change("revise", "revise", source, text, moved, none)))
    steps = steps.otherwise(F.array(inserted, change("delete", "delete", none, none, source, text), change("again", "insert", source, text)))
    changes = docs.select(F.col("source"), F.col("lang").cast("string").alias("lang"), "text", "doc_id").select(F.inline(steps))
    ids = ["load", "revise", "delete", "again"]
    ledger.commit_all(changes, ids)
    ledger.commit_all(changes, ids)
    ledger.compact()
    return ledger.totals()


def _sql() -> str:
    return " union all ".join(
        f"select source, lang, '{k}' as tokenizer, count(*) as n_docs, cast(sum(len(regexp_extract_all(coalesce(text, ''), '{v}'))) as bigint) as n_tokens from documents group by source, lang" for k, v in VERSIONS.items()
    )


ORACLE = _sql()
