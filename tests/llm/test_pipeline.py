"""The pipeline: stage by stage on the small tables, and the guard of the entry points."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quire.llm import bpe, decontaminate, langid, linededup, simhash  # noqa: E402
from quire.llm.common import table  # noqa: E402
from tests.conftest import rows  # noqa: E402
from tests.llm.fixtures import no_docs, odd_docs  # noqa: E402


def test_stages_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == columns, name
        assert out.count() <= left
        left, docs = out.count(), out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == left
    # decisions took effect: a second pass finds nothing more to do
    assert linededup.report(docs).filter("n_near > 0").count() == 0
    groups = simhash.report(docs)
    assert groups.select("component_id").distinct().count() == groups.count()
    assert decontaminate.report(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").count() == 0
    assert left > 0.5 * table(spark, sf_dir, "documents").count()


def test_run_is_the_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, rows(docs))) == sorted(map(str, rows(corpus_pipeline.run(spark, sf_dir))))


@pytest.mark.parametrize("k", range(5))
def test_each_stage_on_odd_and_empty_rows(spark, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, no_docs(spark), sf_dir).count() == 0
    assert stage(spark, odd_docs(spark), sf_dir).count() <= odd_docs(spark).count()


def test_stage_modules():
    assert [m.__name__.rpartition(".")[2] for m in (langid, linededup, simhash, decontaminate, bpe)] == ["langid", "linededup", "simhash", "decontaminate", "bpe"]
