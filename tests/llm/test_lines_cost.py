"""What line dedup spares itself: words past a bound, ids of lines that no one asks for, sorts of whole tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import linededup
from tests.llm.near import distance


def test_word_distance_stops_at_a_bound():
    rng = np.random.default_rng(6)
    early = 0
    for _ in range(3000):
        a = rng.choice(list("abcdefgh"), rng.integers(1, 60)).tolist()
        b = list(a) if rng.random() < 0.7 else rng.choice(list("abcdefgh"), rng.integers(1, 60)).tolist()
        for _ in range(rng.integers(0, 12)):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = rng.choice(list("abcdefgh"), rng.integers(0, 2)).tolist()
        want, most = distance(a, b), max(len(a), len(b)) // 5
        got = linededup.word_distance(a, b, most)
        assert linededup.word_distance(a, b) == want
        assert got == want if want <= most else most < got <= want
        early += got != want
    assert early > 100


def test_occurrences_need_no_words_of_lines(monkeypatch):
    monkeypatch.setattr(linededup, "Lines", lambda *_: pytest.fail("words of lines were looked for"))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one line\nanother line\none line", None]), pa.array([5, 6])], ["d", "text", "w"])
    got = [r for b in linededup._occurrences(iter([batch])) for r in b.to_pylist()]
    assert [(r["d"], r["w"], r["at"]) for r in got] == [(1, 5, 0), (1, 5, 1)]
    assert len({(r["e"], r["g"]) for r in got}) == 2


@pytest.mark.parametrize("bits", [12, 20, 24, 25, 26, 27])
def test_the_bitmap_lets_every_wanted_line_through(bits):
    lines = [f"line number {k} of those that " + "have some more words " * (k % 25) for k in range(3000)]
    h, _ = linededup.line_ids(lines)
    filled = np.zeros(1 << bits - 6, np.uint64)
    for slot in (h[::10] >> (61 - bits)).tolist():
        filled[slot >> 6] |= np.uint64(1 << (slot & 63))
    on = linededup._let_through(filled, linededup.digests(lines)[:, 0])
    assert on[::10].all()
    assert bits < 20 or on.sum() < 330


def test_the_largest_class_is_found_without_sorting(spark):
    met = spark.createDataFrame([(1, 10, 10, 3, 11, 11, 2), (1, 12, 10, 3, 11, 11, 2), (2, 10, 10, 3, 12, 10, 3), (3, 20, 1 << 40, 7, 21, (1 << 40) + 1, 7), (3, 22, 1 << 40, 7, 21, (1 << 40) + 1, 7), (4, 20, 1 << 40, 7, 21, (1 << 40) + 1, 7)], "key long, id long, label long, members long, r_id long, r_label long, r_members long")
    met = met.withColumn("rank", linededup._rank("members", "label")).withColumn("r_rank", linededup._rank("r_members", "r_label"))
    found = linededup._open_groups(met)
    assert {(r.key, r.main, r.id, r.label) for r in found.collect()} == {(1, 10, 10, 10), (1, 10, 12, 10), (1, 10, 11, 11), (3, (1 << 40) + 1, 20, 1 << 40), (3, (1 << 40) + 1, 22, 1 << 40), (3, (1 << 40) + 1, 21, (1 << 40) + 1)}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_two_lines_alone_go_into_no_group(spark, monkeypatch):
    """Keys of two lines are settled by comparing these; only keys of more lines are looked at again."""
    rng = np.random.default_rng(8)
    lines = [" ".join(f"c{c}w{k}x{rng.integers(0, 1000)}" for k in range(45)) for c in range(12)]
    lines += [line.replace(" ", f" and{k} ", 1) for k, line in enumerate(lines[:6])]
    met, held = [], linededup._open_groups
    monkeypatch.setattr(linededup, "_open_groups", lambda x: met.append(x.count()) or held(x))
    rows = linededup.owned(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert sorted(r.members for r in linededup.near_classes(rows).collect()) == [2] * 12
    assert met == [0]


def test_keys_are_made_in_bounded_memory():
    """Two workers of an executor make keys at once, beside a heap that has all of its size by then."""
    rng = np.random.default_rng(9)
    words = np.array([f"word{k}" for k in range(5000)])
    texts = ["\n".join(" ".join(words[rng.integers(0, 5000, rng.integers(5, 120))]) for _ in range(20)) for _ in range(1000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k] * 100), pa.array(texts[k : k + 100])], ["d", "text"]) for k in range(0, 1000, 100)]
    tracemalloc.start()
    try:
        rows = sum(len(b) for b in linededup._packed(2, 10, 8)(iter(batches)))
        assert rows and tracemalloc.get_traced_memory()[1] < 75 << 20
    finally:
        tracemalloc.stop()


def test_keys_of_all_lengths_are_made_together():
    lines = [" ".join(f"w{k}x{i}" for i in range(k)) for k in range(5, 300)]
    assert len(list(linededup.Keys(2, 10).of(linededup.Lines(lines)))) < 20


def test_words_are_counted_before_their_distance_is(monkeypatch):
    """Lines that hold a word many times have few different words, and parities that say little."""
    monkeypatch.setattr(linededup, "word_distance", lambda *_: pytest.fail("the distance was worked out"))
    a, b = ("one " * 40 + "two " * 40).split(), ("one " * 40 + "three " * 40).split()
    assert not linededup.near_word_lists(a, b, 10) and not linededup.near_word_lists(a, a[:40] + a[:40], 10)
    label, shape = np.arange(2), np.zeros((2, 7), np.int64)
    shape[:, 0], shape[:, 1] = 360, 80
    every = np.ones(2, bool)
    assert linededup._settle(np.zeros(2, np.int64), label, every, every, label, shape, [" ".join(a), " ".join(b)], 2, 10) == []
