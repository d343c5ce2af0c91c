"""Lines of open groups are compared once, however many keys they share, and dealt to units without losing a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import linededup
from tests.llm.near import classes_of


def chain(n: int, words: int, seed: int) -> list[str]:
    """Lines of which each has one word of the line before changed: near by steps only."""
    rng = np.random.default_rng(seed)
    line, out = [f"w{k}" for k in rng.integers(0, 10_000, words)], []
    for _ in range(n):
        line = [*line]
        line[int(rng.integers(0, words))] = f"x{rng.integers(0, 10_000)}"
        out.append(" ".join(line))
    return out


def shapes(lines: list[str]) -> np.ndarray:
    held = linededup.Lines(lines)
    return np.stack([np.diff(held.at), np.diff(held.first), *(x.view(np.int64) for x in held.sketches())], 1)


@pytest.mark.parametrize("keys", [1, 40])
def test_a_pair_is_compared_once_for_all_its_keys(monkeypatch, keys):
    lines, calls = chain(60, 12, 3), []
    near = linededup.near_word_lists
    monkeypatch.setattr(linededup, "near_word_lists", lambda a, b, share: calls.append(1) or near(a, b, share))
    who = np.tile(np.arange(60), keys)
    # neighbouring keys leave out a line each, so that no two have the same lines
    on = who != np.repeat(np.arange(keys), 60)
    every = np.ones(on.sum(), bool)
    got = linededup._settle(np.repeat(np.arange(keys), 60)[on], who[on], every, every, np.arange(60), shapes(lines), lines, 2, 10)
    assert len(got) == len(set(got)) == len(set(who[on])) - 1  # as few pairs as connect all
    assert len(calls) <= 60 * 59 // 2


def test_equal_classes_are_not_compared(monkeypatch):
    lines = chain(50, 30, 5)
    monkeypatch.setattr(linededup, "near_word_lists", lambda *_: pytest.fail("compared"))
    every = np.ones(50, bool)
    assert linededup._settle(np.zeros(50, np.int64), np.arange(50), every, every, np.zeros(50, np.int64), shapes(lines), lines, 2, 10) == []


@pytest.mark.parametrize("late,members", [(2000, 20000), (3, 20000), (2000, 7), (3, 7)])
def test_units_meet_every_pair(spark, monkeypatch, late, members):
    """Chains and lines that are near to none, in one group, by whatever squares the group's pairs are dealt out."""
    monkeypatch.setattr(linededup, "MOST_LATE", late)
    monkeypatch.setattr(linededup, "MOST_MEMBERS", members)
    lines = chain(12, 20, 1) + chain(9, 25, 2) + [" ".join(chain(1, 20, 10 + k)) for k in range(8)]
    rows = [(k, line, *map(int, shape)) for k, (line, shape) in enumerate(zip(lines, shapes(lines)))]
    texts = spark.createDataFrame(rows, "id long, line string, " + ", ".join(f"{c} long" for c in linededup.SHAPE))
    groups = texts.drop("line").withColumns({"label": F.col("id"), "main": F.lit(0).cast("long")}).withColumn("key", F.explode(F.array(F.lit(5), F.lit(6)).cast("array<long>")))
    got = [set(r) for r in linededup._settled(groups.select("key", "main", "id", "label", *linededup.SHAPE), texts, 2, 10).collect()]
    label = list(range(len(lines)))
    for a, b in got:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    held = classes_of(lines)
    want = {frozenset(held[x]) for x in lines if x in held}
    mine = {frozenset(lines[k] for k in range(len(lines)) if label[k] == c) for c in set(label)}
    assert {c for c in mine if len(c) > 1} == {c for c in want if len(c) > 1}


def test_near_classes_of_a_large_group_by_one_pass(spark, monkeypatch):
    """Many lines share segments but are near by steps only; groups were compared again and again, a pair for each key."""
    joins = []
    held = linededup._settled
    monkeypatch.setattr(linededup, "_settled", lambda *a: joins.append(a) or held(*a))
    lines = chain(80, 40, 7)
    rows = linededup.owned(spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "doc_id long, text string"))
    got = linededup.near_classes(rows)
    assert got.count() == 80 and got.select("label").distinct().count() == len({frozenset(c) for c in classes_of(lines).values()}) == 1
    assert len(joins) == 1
