"""Quality rules: Gopher-style counts plus a calibrated hashed n-gram classifier.

Counts and features are taken over whole texts, in numpy over Arrow batches. The classifier is a
logistic regression on hashed words, word pairs and byte 4-grams (each group as shares of the text),
fitted on at most `most` labelled rows and calibrated (Platt) on a fifth of them held back.

The rows fitted on are chosen by a hash of their ids and sorted, so that neither partitions nor order matter; beyond
`most_bytes` of text a share of them is taken, by a hash of the text, that comes to about so much.

Defined cases: a null or empty text has no words, all counts 0, and fails (n_words < 10). Very long texts are counted
whole. A probability of just the threshold is kept. An empty table gives no rows; extra columns are not looked at,
whatever their names. Repeated rows are judged one by one. A null doc_id stays. Without labelled rows of both kinds nothing is rejected by
the classifier (probability 1). Equal word windows and lines are told by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import vectext as V
from quire.llm.common import bounded_sample

WORD_BITS, PAIR_BITS, GRAM_BITS = 18, 18, 16
SIZES = (1 << WORD_BITS, 1 << PAIR_BITS, 1 << GRAM_BITS)
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


@dataclass
class Model:
    weights: list[np.ndarray]
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def groups(x: V.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and byte 4-grams: their buckets, and where each text's begin."""
    starts, ends, at = x.spans(V.SPACE)
    words = x.hashes(starts, ends)
    out = [((words >> np.uint64(64 - WORD_BITS)).astype(np.int32), at)]
    for bits, width, own, values in ((PAIR_BITS, 2, at, words), (GRAM_BITS, 4, x.at, x.data)):
        ok = V.inner(own, width, len(values))
        if width == 2:
            h = values[:-1] * np.uint64(3) + values[1:] if len(values) else values
            bucket = V.mix(h) >> np.uint64(64 - bits)
        else:
            c = values.astype(np.uint32)
            h = c[:-3] | c[1:-2] << 8 | c[2:-1] << 16 | c[3:] << 24 if len(c) > 3 else c[:0]
            bucket = (h * np.uint32(2654435761)) >> np.uint32(32 - bits)
        kept = np.zeros(len(ok) + 1, np.int64)
        np.cumsum(ok, out=kept[1:])
        out.append((bucket[ok[: len(bucket)]].astype(np.int32), kept[own]))
    return out


def logits(x: V.Texts, model: Model) -> np.ndarray:
    z = np.full(x.n, model.bias)
    for w, (bucket, at) in zip(model.weights, groups(x), strict=True):
        z += x.sums(w[bucket], at) / np.maximum(np.diff(at), 1)
    return z


def base(x: V.Texts) -> dict[str, np.ndarray]:
    """The exact counts."""
    starts, ends, at = x.spans(V.SPACE)
    n_words = np.diff(at)
    points = (x.data & 0xC0) != 0x80
    words = x.hashes(starts, ends)
    out = {"n_words": n_words, "word_chars": x.sums(points & ~V.SPACE[x.data]), "n_symbols": x.sums(SYMBOL[x.data])}
    ls, le, lat = x.lines()
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    line_doc = np.repeat(np.arange(x.n), np.diff(lat))[has_word]
    lines = np.unique(np.stack([line_doc.astype(np.uint64), x.hashes(ls, le)[has_word]], 1), axis=0)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=x.n) - np.bincount(lines[:, 0].astype(np.int64), minlength=x.n)
    out["n_repeat_words"] = repeat_words(words, at, x)
    return out


def repeat_words(words: np.ndarray, at: np.ndarray, x: V.Texts, width: int = 5) -> np.ndarray:
    n = len(words)
    if n < width:
        return np.zeros(x.n, np.int64)
    where = np.flatnonzero(V.inner(at, width, n))
    doc = np.repeat(np.arange(x.n, dtype=np.uint64), np.diff(at))
    h = V.mix(doc[where])
    for k in range(width):
        h = V.mix(h + words[where + k])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(where), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, where[twice], 1)
    np.add.at(edge, where[twice] + width, -1)
    return x.sums(np.cumsum(edge[:-1]) > 0, at)


def fit(texts: pa.Array, good: np.ndarray, rounds: int = 60) -> Model | None:
    """Adam on the logistic loss, then Platt's two parameters on every fifth row."""
    if len(set(good.tolist())) < 2:
        return None
    rows, cols, vals = [], [], []
    for first, _, x in V.slices(texts):
        shift = 0
        for size, (bucket, at) in zip(SIZES, groups(x), strict=True):
            doc = np.repeat(np.arange(x.n), np.diff(at))
            key, count = np.unique(doc.astype(np.int64) * size + bucket, return_counts=True)
            d = key // size
            rows.append((d + first).astype(np.int32))
            cols.append((key % size + shift).astype(np.int32))
            vals.append((count / np.maximum(np.diff(at), 1)[d]).astype(np.float32))
            shift += size
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    names, col = np.unique(col, return_inverse=True)
    col = col.astype(np.int32)
    n, held = len(good), np.arange(len(good)) % 5 == 0
    if len(set(good[held].tolist())) < 2 or len(set(good[~held].tolist())) < 2:
        held = np.zeros(n, bool)
    w, m, v, b = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names)), 0.0
    weight = np.where(held, 0, 1.0)
    for t in range(1, rounds + 1):
        z = np.bincount(row, val * w[col], n) + b
        r = weight * (1 / (1 + np.exp(-z)) - good) / weight.sum()
        g = np.bincount(col, r[row] * val, len(names)) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= 0.5 * r.sum()
    full = np.zeros(sum(SIZES), np.float32)
    full[names] = w
    model = Model(np.split(full, np.cumsum(SIZES)[:-1]), b)
    on = held if held.any() else np.ones(n, bool)
    z, y = (np.bincount(row, val * w[col], n) + b)[on], good[on]
    n1 = y.sum()
    y = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + c)))
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, [((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * c])
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -2, 2)
    model.slope, model.shift = max(a, 1e-3), c
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, most_bytes: int = 200 << 20) -> Model | None:
    """most, most_bytes: bounds on the labelled rows the classifier is fitted on (whole texts) and on their size."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quire_good"))
    marked = bounded_sample(marked, F.col("doc_id"), most, "quality")
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(marked), "doc_id").select("doc_id", "text", "quire_good")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        rows = bounded_sample(rows, F.col("text"), max(1, int(rows.count() * most_bytes / size)), "quality-bytes")
    rows = rows.toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(rows["text"].combine_chunks(), (rows["quire_good"].to_numpy() > 0).astype(np.int64)) if len(rows) else None


def judge(docs: DataFrame, model: Model | None, threshold: float = 0.5, min_words: int = 10, max_repeat: float = 0.2) -> DataFrame:
    """Counts, the calibrated probability of good quality, and the verdict for each row of docs."""
    names = pa.schema([("doc_id", pa.int64())])
    held = docs.sparkSession.sparkContext.broadcast(model)
    percent = round(100 * max_repeat)

    def run(batches):
        fitted = held.value
        for batch in batches:
            for first, end, x in V.slices(batch.column(1)):
                out = base(x)
                failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > percent * out["n_words"])
                p = np.ones(x.n) if fitted is None else 1 / (1 + np.exp(-np.clip(fitted.slope * logits(x, fitted) + fitted.shift, -500, 500)))
                cols = [batch.column(0).slice(first, end - first), *(pa.array(out[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], [*names.names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
