"""Learned operators: gradients, accuracy on held-out rows, odd rows, and that nothing but the text is an input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, lm, quality, registry, toxicity
from quire.llm.common import table
from tests.conftest import rows
from tests.llm.fixtures import clashing, held_out, no_docs, odd_docs

#: The larger of the small tables: held-out rows of each label.
LARGER = "/root/testdata/sf0.01"
LARGEST = "/root/testdata/sf0.1"


def test_recurrent_gradients_are_those_of_the_loss():
    net = langid.Network(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows_, lengths, _ = langid.encode(["abc", "zz", "hello"])
    lang = np.array([0, 1, 0])

    def loss():
        s = np.concatenate([net.states(rows_, lengths, d) for d in "fb"], 2)
        y = s @ net.p["out"] + net.p["bias"]
        y = y - np.log(np.exp(y).sum(2, keepdims=True))
        return -sum(y[t, i, lang[i]] for i in range(3) for t in range(lengths[i])) / lengths.sum()

    g = net.gradients(rows_, lengths, lang)
    for k, at in (("out", (1, 0)), ("bias", (1,)), ("uf", (0, 4)), ("ub", (2, 7)), ("xf", (ord("b"), 8)), ("xb", (ord("z"), 1)), ("cf", (5,))):
        was = net.p[k][at]
        net.p[k][at] = was + 1e-2
        up = loss()
        net.p[k][at] = was - 1e-2
        down = loss()
        net.p[k][at] = was
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-4, (k, at)


def test_language_on_held_out_rows(spark):
    docs = table(spark, LARGER, "documents")
    got = registry.op10_language(spark, LARGER).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert (got.held_out == [held_out(d, 3, 1) for d in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    worded = got[got.held_out & (got.lang_pred != "und")]
    assert (worded.lang == worded.lang_pred).mean() > 0.97
    assert all((p == "und") == (t is None or not langid.LETTER.search(t)) for p, t in zip(got.lang_pred, got.text))


def test_language_on_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    net = langid.train(docs)
    got = rows(langid.identify(docs, net))
    assert len(got) == docs.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} >= {1, 2, 3, 14, None}
    assert langid.train(no_docs(spark)) is None
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows(langid.identify(docs, None)))
    assert langid.identify(no_docs(spark), net).count() == 0
    kept = langid.keep_known(docs, net, least=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" for r in got)


def test_clean_documents_stay_in_the_language_stage(spark):
    docs = table(spark, LARGER, "documents")
    kept = langid.keep_known(docs, langid.train(docs))
    assert kept.count() > 0.97 * docs.count()


def test_lm_beats_its_base_on_held_out_rows(spark):
    got = registry.op3_lm_scores(spark, LARGER).toPandas()
    out = got[got.held_out]
    gain = out.score.sum() / out.base_score.sum()  # both are negative
    assert gain < 0.95, gain


@pytest.fixture(scope="module")
def lm_model(spark):
    return lm.train(table(spark, LARGER, "documents"))


def test_lm_probabilities_sum_to_one(spark, lm_model):
    """Over all known words and one unknown of each class, after any context."""
    model, counts = lm_model
    held = counts.toPandas()
    keys = np.sort(held.h.to_numpy())
    number = model.numbers(keys.view(np.uint64))
    n = held.set_index("h").c.loc[keys].to_numpy()
    kind = np.clip(number - len(model.words), 0, lm.CLASSES - 1)
    rare = (number >= len(model.words)) & (number < len(model.words) + lm.CLASSES)
    inside = np.where(rare, (1 - model.unknown[kind]) * n / np.maximum(model.class_n[kind], 1), 1)
    rng = np.random.default_rng(1)
    n_symbols = len(model.bias)
    for one, two in [(model.end, model.end), *rng.integers(0, n_symbols, (4, 2)).tolist()]:
        every = 10.0 ** model.log_probabilities(np.full(n_symbols, one), np.full(n_symbols, two), np.arange(n_symbols)).astype(np.float64)
        assert abs(every.sum() - 1) < 1e-4
        of_class = every[model.place[len(model.words) : len(model.words) + lm.CLASSES]]
        assert abs((every[model.place[number]] * inside).sum() + (of_class * np.where(model.class_n > 0, model.unknown, 1)).sum() - 1) < 1e-3
    assert ((model.unknown > 0) & (model.unknown <= 1)).all()


def test_lm_knows_more_words_of_a_larger_corpus(spark, lm_model):
    small, _ = lm.train(table(spark, "/root/testdata/sf0.001", "documents"))
    assert len(small.words) < len(lm_model[0].words) == int(lm.GROWTH * lm_model[0].n ** 0.5)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, LARGEST, "documents"), table(spark, LARGEST, "labels")
    marked = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score(marked, toxicity.train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got.held_out == [held_out(d, 5, 0) for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    assert out[out.toxic == 1].predicted.mean() > 0.9
    assert out[out.toxic == 0].predicted.mean() < 0.02


def test_toxicity_sees_the_text_only(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    model = toxicity.train(docs, labels)
    a = toxicity.score(docs, model).toPandas().set_index("doc_id").score
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "n_chars": F.lit(0)})
    b = toxicity.score(other, model).toPandas().set_index("doc_id").score
    pd.testing.assert_series_equal(a.sort_index(), b.sort_index())


def test_toxicity_on_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    labels = spark.createDataFrame([(2, 1, 1), (4, 0, 0), (6, 1, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.score(docs, toxicity.train(docs, labels)))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    empty = toxicity.train(no_docs(spark), labels.filter("false"))
    assert all(0 <= r["score"] < 0.5 for r in rows(toxicity.score(docs, empty)))
    assert toxicity.score(no_docs(spark), empty).count() == 0


def test_the_risk_estimate_does_not_go_below_zero():
    """With a prior far above the truth the unlabelled part is held at zero: unlabelled rows do not all turn positive."""
    rng = np.random.default_rng(2)
    bag = lambda own, hi: np.unique(np.concatenate([rng.integers(100, hi, 20), own]))
    positive = [bag([1, 2], 4000) for _ in range(40)]
    unlabelled = [bag([], 4000) for _ in range(300)] + [bag([1, 2], 4000) for _ in range(20)]
    model = toxicity.fit(positive, unlabelled, 0.06)
    weights = dict(zip(model.buckets.tolist(), model.weights))
    assert sum(weights.get(k, 0) for k in (1, 2)) + model.bias > 0 > model.bias


def test_quality_on_labelled_rows(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    half = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    model = quality.train(docs, half)
    got = quality.judge(docs, model).join(labels.join(half.select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality"), "doc_id").toPandas()
    assert (got.kept == ((got.p_good >= 0.5) & ~got.base_failed)).all()
    worded = got[~got.base_failed]
    assert ((worded.p_good >= 0.5) == (worded.quality == 1)).mean() > 0.85
    good = worded[worded.quality == 1]
    assert good.kept.mean() > 0.9


@pytest.mark.parametrize("labels", [[], [(4, 1, 0)], [(4, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, 0)]])
def test_quality_on_odd_rows(spark, labels):
    docs = clashing(odd_docs(spark))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows(quality.judge(docs, quality.train(docs, marked)))
    assert len(got) == docs.count() and all(0 <= r["p_good"] <= 1 for r in got)
    assert all(not r["kept"] for r in got if r["n_words"] < 10)


@pytest.mark.parametrize("work", [lambda docs: toxicity.score(docs, toxicity.Model(np.zeros(0, np.int64), np.zeros(0), -1.0)), lambda docs: langid.keep_known(docs, None)])
def test_batches_of_long_texts_are_bounded_by_bytes(spark, work):
    """3,000 rows of 10,000 characters went to Python as one batch of 30 MB."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    own = spark.newSession()
    docs = own.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefghi "), 1000).alias("text"))
    assert work(docs) is not None
    assert docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 6 << 20


def test_toxicity_scores_long_texts_in_little_memory():
    """The tables of a slice of texts are bounded (they took 131 MB, now 44)."""
    import tracemalloc

    import pyarrow as pa

    from quire.llm import vectext

    texts = pa.array(["word of a text " * 250] * 1500)  # 5.6 MB
    model = toxicity.Model(np.arange(100), np.ones(100), -1.0)
    tracemalloc.start()
    try:
        for _, _, x in vectext.slices(texts):
            model.scores(x)
        assert tracemalloc.get_traced_memory()[1] < 90e6
    finally:
        tracemalloc.stop()
