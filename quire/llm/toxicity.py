"""Toxicity by non-negative positive-unlabelled learning.

Features are the distinct plain words of the whole text (ASCII case folded) and their first STEMS bytes,
hashed to 2**20 buckets: words of one stem speak for each other. A numpy logistic model is trained on confirmed toxic rows against unlabelled text with the non-negative
risk  pi R_P(+) + max(0, R_U(-) - pi R_P(-));  pi, the share of toxic rows, is estimated from the labels
of the training folds. Only words markedly more frequent in the confirmed rows get a weight, found after
near copies were removed from the sample by a bottom-4 sketch.

Bounds: at most `most_positive` confirmed and `most_unlabelled` unlabelled rows are fitted on, each with
its whole text; what reaches the driver is their distinct buckets, at most 2**20 numbers a row. The rows are chosen by a
hash of their ids and sorted before the fit, so that neither partitions nor order matter. Defined cases: null or
empty texts score like a text without any listed word; very long texts are read whole; a score of just 0.5 is
toxic; repeated rows are scored one by one; without confirmed rows every score is the prior; an empty table gives no
rows; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import vectext as V
from quire.llm.common import bounded_sample, fold, mapped

BITS = 20
FOLDS = 5
#: Sizes in bytes of the stems.
STEMS = (4, 6)


def features(x: V.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each word and stem."""
    starts, ends, at = x.spans(V.PLAIN_END)
    doc = np.repeat(np.arange(x.n), np.diff(at))
    docs, hashes = [doc], [x.hashes(starts, ends, fold_case=True)]
    for k, size in enumerate(STEMS, 1):
        on = ends - starts > size
        docs.append(doc[on])
        hashes.append(V.mix(x.hashes(starts[on], starts[on] + size, fold_case=True) + np.uint64(k)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _bags(batches):
    for batch in batches:
        for first, end, x in V.slices(batch.column(1)):
            doc, bucket = features(x)
            key = np.unique(doc << BITS | bucket)
            cut = np.searchsorted(key, np.arange(x.n + 1) << BITS)
            bags = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((key & (2**BITS - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), bags], ["positive", "bag"])


def _distinct(bags: list[np.ndarray]) -> list[np.ndarray]:
    """Without near copies: one bag for each set of the four words that hash lowest."""
    kept = {}
    for bag in bags:
        kept.setdefault(tuple(np.sort(V.mix(bag.astype(np.uint64)))[:4]), bag)
    return list(kept.values())


class Model:
    """bucket -> weight, sorted by bucket; bias."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias
        self.listed = np.zeros(1 << BITS, np.int32)
        self.listed[buckets] = np.arange(1, len(buckets) + 1)

    def scores(self, x: V.Texts) -> np.ndarray:
        z = np.full(x.n, self.bias)
        if len(self.buckets):
            listed = self.listed
            doc, bucket = features(x)
            which = listed[bucket]
            hit = np.flatnonzero(which)
            pair = np.unique(doc[hit] * (len(self.buckets) + 1) + which[hit])
            z += np.bincount(pair // (len(self.buckets) + 1), self.weights[pair % (len(self.buckets) + 1) - 1], x.n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    prior = float(np.clip(prior, 1e-4, 0.9))
    positive, unlabelled = _distinct(positive), _distinct(unlabelled)
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    n_p, n_u = len(positive), len(unlabelled)
    df_p = np.bincount(np.concatenate(positive).astype(np.int64), minlength=1 << BITS)
    df_u = np.bincount(np.concatenate(unlabelled).astype(np.int64), minlength=1 << BITS)
    expected = n_p * df_u / n_u
    names = np.flatnonzero((df_p >= 3) & (df_p > 2 * expected) & ((df_p - expected) / np.sqrt(expected + 1) > 2.5))
    place = np.full(1 << BITS, -1)
    place[names] = np.arange(len(names))

    def pairs(bags):
        cols = place[np.concatenate(bags).astype(np.int64)]
        rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return rows[cols >= 0], cols[cols >= 0]

    (rp, cp), (ru, cu) = pairs(positive), pairs(unlabelled)
    w, b = np.zeros(len(names)), -1.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    loss = lambda z: np.logaddexp(0, -z)
    for t in range(1, rounds + 1):
        zp, zu = np.bincount(rp, w[cp], n_p) + b, np.bincount(ru, w[cu], n_u) + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        rest = loss(-zu).mean() - prior * loss(-zp).mean()
        if rest >= 0:  # the whole risk
            dp, du = prior * ((sp - 1) - sp) / n_p, su / n_u
        else:  # the unlabelled part has gone below zero: step back
            dp, du = prior * sp / n_p, -su / n_u
        g = np.bincount(cp, dp[rp], len(names)) + np.bincount(cu, du[ru], len(names)) + decay * w
        gb = dp.sum() + du.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return Model(names, w, float(b))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_unlabelled: int = 9000) -> Model:
    """Learns from rows whose fold is not 0 only. The two bounds are on rows; their texts are read whole."""
    seen = labels.filter(fold(F.col("doc_id"), FOLDS) != 0).filter("doc_id is not null and toxic is not null")
    seen = seen.groupBy("doc_id").agg(F.max("toxic").alias("quire_toxic"))
    prior = seen.agg(F.avg(F.col("quire_toxic").cast("double"))).first()[0] or 0.0
    marked = bounded_sample(seen.filter("quire_toxic > 0").select("doc_id"), F.col("doc_id"), most_positive, "toxic")
    own = docs.select("doc_id", "text").filter(fold(F.col("doc_id"), FOLDS) != 0)
    pos = own.join(F.broadcast(marked), "doc_id").select(F.lit(True).alias("positive"), "text")
    rest = bounded_sample(own, F.col("doc_id"), most_unlabelled, "unlabelled").select(F.lit(False).alias("positive"), "text")
    rows = mapped(pos.unionAll(rest), _bags, "positive boolean, bag array<int>").toArrow()
    which = rows["positive"].to_numpy()
    bags = [np.asarray(x, np.int64) for x in rows["bag"].to_numpy()]
    order = sorted(range(len(bags)), key=lambda i: bags[i].tobytes())
    return fit([bags[i] for i in order if which[i] and len(bags[i])], [bags[i] for i in order if not which[i]], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, end, x in V.slices(batch.column(1)):
                p = held.value.scores(x)
                ids, out = (batch.column(k).slice(first, end - first) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int")
