"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most two bits differ in at most one bit in one of two disjoint groups of 31
bits. The anchors of a group are the words of the Hamming code of length 31, which covers every point
within radius 1. Each distinct fingerprint has its covering anchor as home and is replicated to all
anchors within radius plus threshold (1 + 1): 1 or 16 of them. Two fingerprints within one bit meet at
the home of either; there the whole 64 bits are compared. Equal fingerprints are one point throughout, so
groups of copies cost one row, and links are only between different fingerprints.

Words: A-Z folded, runs of [^\\x20\\x09-\\x0D]; shingles of three words joined by a space, repeats kept (fewer
words: the whole sequence). Hash: XXH64 with seed 42 of UTF-8. A bit is set if set in over half of them.
Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows are
documents of one group; the component of rows whose ids are all null is null; a bit set in exactly half of the
shingles is 0; very long texts count whole, their bits summed in parts; an empty table gives no rows; extra columns
are not looked at, whatever their names, and keep_one() keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, free, mapped
from quire.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 2
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bit positions 1..31 whose number has bit k set, as masks: the parity checks of the code.
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def fingerprint(text: str | None) -> int:
    """Signed 64 bits."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())])
    bits = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(bits), 1 << 16):
        counts += np.unpackbits(bits[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(bits)).view(">i8")[0])


def _fingerprints(batches):
    for batch in batches:
        for first in range(0, len(batch), 256):
            some = batch.slice(first, 256)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([fingerprint(t) for t in some.column(1).to_pylist()], pa.int64()), some.column(2)], ["doc_id", "fp", "w"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("w")), _fingerprints, "doc_id long, fp long, w long")


def anchors(x: Column) -> tuple[Column, Column]:
    """The home anchor of 31 bits, and the array of the anchors within distance 2."""
    s = F.lit(0)
    for k, mask in enumerate(CHECKS):
        s = s + (F.bit_count(x.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
    flip = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), (i - 1).cast("int"))).cast("long")
    home = x.bitwiseXOR(flip(s))
    pairs = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i < i.bitwiseXOR(s))
    near = F.transform(pairs, lambda i: x.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(s))))
    return home, F.when(s == 0, F.array(x)).otherwise(near)


def _marked(side: Column):
    return lambda anchor: anchor.bitwiseOR(side)


def links(points: DataFrame) -> DataFrame:
    """(a, b): every pair of different fingerprints, a < b, that differ in at most two bits; points: distinct fp."""
    home, near = [], []
    for k in (0, 1):
        half = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32 * k)).bitwiseAND(F.lit(0x7FFFFFFF))
        h, n = anchors(half)
        side = F.lit(k << 32)
        home.append(h.bitwiseOR(side))
        near.append(F.transform(n, _marked(side)))
    left = points.select(F.col("fp").alias("a"), F.explode(F.array(*home)).alias("anchor"))
    right = points.select(F.col("fp").alias("b"), F.explode(F.concat(*near)).alias("anchor"))
    met = left.join(right, (left.anchor == right.anchor) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable), w (hash of the text) and root (one fp of the component) of each row of docs."""
    fps = cut(fingerprints(docs))
    points = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    joined = components(links(points))
    named = points.join(joined.withColumnRenamed("node", "fp"), "fp")
    lowest = named.groupBy("least").agg(F.min("low").alias("lowest"))
    named = named.join(lowest, "least").select("fp", "lowest", "least")
    every = points.join(named, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("least", "fp").alias("root"))
    return fps.join(every, "fp").select("doc_id", "fp", "component_id", "w", "root")


def report(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: that with the smallest id and, of these, the smallest hash of its text.
    All columns stay; rows with a null id stay; rows with one id and different groups are told apart by their texts."""
    found = cut(grouped(docs).filter("doc_id is not null").groupBy("root", "doc_id", "w").count())
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "w")).alias("best"))
    found = found.join(best, "root").withColumn("first", F.struct("doc_id", "w") == F.col("best"))
    own, text = free(docs, "quire_id", "quire_hash")
    gone = found.filter("not first").select(F.col("doc_id").alias(own), F.col("w").alias(text))
    out = docs.join(gone, (docs["doc_id"].cast("long") == gone[own]) & (F.xxhash64(docs["text"]) == gone[text]), "left_anti")
    if not found.filter("first and count > 1").limit(1).count():
        return out
    with_id = out.filter("doc_id is not null").withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return with_id.unionByName(out.filter("doc_id is null"))
