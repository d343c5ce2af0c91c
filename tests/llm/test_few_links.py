"""What line dedup does not do for every few rows: rounds of joins over few links, searches for words, looks through modules."""

import gc

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import components, linededup
from quire.llm.common import mapped


def brute(links: list[tuple[int, int]]) -> dict[int, int]:
    least = {x: x for pair in links for x in pair}
    while True:
        was = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if was == least:
            return least


def some_links(seed: int) -> list[tuple[int, int]]:
    rng = np.random.default_rng(seed)
    chain = rng.permutation(40).tolist()
    star = [(1 << 62, int(k)) for k in rng.integers(100, 200, 30)]
    return [*zip(chain, chain[1:]), *star, *map(tuple, rng.integers(-300, -200, (45, 2)).tolist())]


@pytest.mark.parametrize("seed", range(20))
def test_the_least_node_that_each_reaches(seed):
    links = some_links(seed)
    nodes, least = components.least_reached(*np.array(links, np.int64).T)
    assert dict(zip(nodes.tolist(), least.tolist())) == brute(links)


def test_few_links_take_no_rounds(spark, monkeypatch):
    links = some_links(3)
    want = brute([x for x in links if x[0] != x[1]])
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert {(r.node, r.least) for r in components.components(df).collect()} == set(want.items())
    monkeypatch.undo()
    monkeypatch.setattr(components, "_large_star", lambda _: pytest.fail("joined"))
    assert sorted((r.node, r.least) for r in components.components(df).collect()) == sorted(want.items())
    assert components.components(df.filter("a is null")).count() == 0


def test_words_are_told_as_by_the_pattern():
    rng = np.random.default_rng(4)
    signs = ["ab", "c", " ", "  ", "\t", "\x00", "\x1f", "\x7f", "\x85", "\xa0", "é", "ß", "ж", " ", " ", "​", "⹿", "⺀", "漢", "　", "😀", "\ud800"]
    for kinds in (signs[:3], signs[:11], signs):
        for _ in range(2000):
            line = "".join(rng.choice(kinds, rng.integers(0, 12)))
            assert linededup.words_of(line) == linededup.WORD.findall(line)


def test_a_line_in_many_pairs_is_parted_once(monkeypatch):
    held, calls = linededup.words_of, []
    monkeypatch.setattr(linededup, "words_of", lambda line: calls.append(line) or held(line))
    lines = [f"a line with some words of which the last is {k}" for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([0] * 50), pa.array(lines), pa.array([lines[0]] * 50)], ["a", "b", "x", "y"])
    got = pa.Table.from_batches(linededup._verify(2, 10)(iter([batch])))
    assert got["a"].to_pylist() == list(range(50))
    assert sorted(calls) == sorted(lines)


def test_a_worker_does_not_look_through_what_it_has_loaded(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.get_freeze_count()] * len(batch), pa.int64())], ["n"])

    assert all(r.n > 0 for r in mapped(spark.range(3), run, "n long").collect())
