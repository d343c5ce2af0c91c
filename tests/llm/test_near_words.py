"""Near repeats that grow with the line: whole words inserted, removed or changed, against brute force over all pairs."""

import numpy as np
import pytest

from quire.llm import linededup
from quire.llm.common import table
from tests.conftest import rows
from tests.llm.near import classes_of, distance, pairs_near


def changed(rng, line, edits):
    out = line.split(" ")
    for _ in range(edits):
        k, op = int(rng.integers(0, len(out))), rng.integers(0, 3)
        if op == 0:
            out.insert(k, "inserted")
        elif op == 1:
            del out[k]
        else:
            out[k] = "replacement"
    return " ".join(out)


def found_classes(spark, lines, **more):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "d long, text string")
    names = dict(zip(map(tuple, np.stack(linededup.line_ids(lines), 1).tolist()), lines))
    got = {}
    for r in rows(linededup.near_classes(df, **more)):
        got.setdefault(r["label"], []).append((names[r["h"], r["g"]], r["members"]))
    assert all(len(c) == n for c in got.values() for _, n in c)
    return {x: frozenset(y for y, _ in c) for c in got.values() for x, _ in c}


def test_word_distance():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        a, b = (list(rng.choice(list("abc"), rng.integers(0, 80 if k else 12))) for k in (0, 1))
        assert linededup.word_distance(a, b) == distance(a, b)


@pytest.mark.parametrize("share", [5, 10, 20])
def test_word_probes_find_every_near_line(share):
    """The longer line looks up some segment of the shorter one, wherever the edits are."""
    rng = np.random.default_rng(share)
    for _ in range(300):
        n = int(rng.integers(share, 20 * share if rng.random() < 0.03 else 5 * share))
        x = list(rng.choice(list("ab"), n))
        y = list(x)
        for _ in range(n // share):
            k, op = int(rng.integers(0, len(y))), rng.integers(0, 3)
            if op == 0:
                y.insert(k, "c")
            elif op == 1:
                del y[k]
            else:
                y[k] = "c"
        short, long = sorted((x, y), key=len)
        if distance(short, long) > len(long) // share:
            continue
        index = {(b, i, tuple(short[p : p + s])) for b, i, p, s in linededup.word_segments(len(short), share)}
        assert any((b, i, tuple(long[p : p + s])) in index for b, i, p, s in linededup.word_probes(len(long), share))


def test_copies_with_words_changed_in_lines_of_all_lengths(spark):
    rng = np.random.default_rng(8)
    lines = []
    for n in (9, 10, 11, 19, 20, 28, 35, 60, 110, 450):
        base = " ".join(f"w{k}x{rng.integers(0, 1000)}" for k in range(n))
        lines += [base, *(changed(rng, base, e) for e in (1, 1, 1, max(1, n // 10), max(1, n // 10), n // 10 + 1, n // 5))]
    lines += ["日本語のテキストがここに長く書かれていて一文字だけ違うもの", "日本語のテキストがここに長く書かれていて数文字も違うもの", "  ".join(lines[40].split(" "))]
    lines = sorted(set(lines))
    want = classes_of(lines)
    assert found_classes(spark, lines) == want and len(want) > 40


def test_chains_that_their_least_line_does_not_hold_together(spark):
    """Lines far from the one that all are first paired with, near to others that share a key with it."""
    rng = np.random.default_rng(5)
    lines = []
    for c in range(12):
        words_ = [f"c{c}w{k}x{rng.integers(0, 1000)}" for k in range(45)]
        for step in range(6):
            lines.append(" ".join(words_))
            for k in rng.choice(np.arange(20, 45), 3, replace=False):
                words_[k] = f"new{step}v{rng.integers(0, 100000)}"
    lines += [" ".join(["all of these lines begin with the same ten words and then"] + [f"z{i}y{rng.integers(0, 10000)}" for _ in range(30)]) for i in range(60)]
    want = classes_of(lines)
    assert found_classes(spark, lines) == want and len(want) > 60


def test_many_lines_of_one_key_are_paired_within_a_task():
    rng = np.random.default_rng(6)
    key = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    key[:400], key[400:420] = key[0], key[401]
    hr = rng.integers(0, 1 << 60, 3000) << 2 | 1
    got = [linededup._star(b, [k], [h]) if b >= 0 else linededup._pairs(np.frombuffer(k, np.int64), *np.frombuffer(h, np.int64).reshape(-1, 2).T.copy()) for b, k, h in zip(*linededup.pack(key, hr, 5).to_pydict().values())]
    met = {frozenset((h, r)) for b in got for h, r in zip(b["h"].to_pylist(), b["r"].to_pylist())}
    for some in (hr[:400] >> 2, hr[400:420] >> 2):
        assert sum(len(p & set(some.tolist())) == 2 for p in met) == len(some) - 1
    assert len(met) == 399 + 19


def test_groups_that_are_paired_in_parts(spark, monkeypatch):
    """Tasks pair the lines of a key themselves, each with its own first one."""
    rng = np.random.default_rng(7)
    lines = []
    for c in range(3):
        words_ = [f"c{c}w{k}x{rng.integers(0, 1000)}" for k in range(45)]
        for step in range(30):
            lines.append(" ".join(words_))
            for k in rng.choice(np.arange(15, 45), 3, replace=False):
                words_[k] = f"new{step}v{rng.integers(0, 100000)}"
    want = classes_of(lines)
    monkeypatch.setattr(linededup, "MANY", 3)
    for held in (500, 4000):
        monkeypatch.setattr(linededup, "HELD_KEYS", held)
        own = linededup.Keys(2, 10)
        packed, keys, hs, size = [], [], [], 0
        for i in range(0, len(lines), 7):
            some = linededup.Lines(lines[i : i + 7])
            h, _ = linededup.line_ids(lines[i : i + 7], some)
            for key, on, role in own.of(some):
                keys.append(key)
                hs.append(h[on] << 2 | role)
                size += len(key)
            if size > held or i + 7 >= len(lines):
                packed += zip(*linededup.pack(np.concatenate(keys), np.concatenate(hs), 3).to_pydict().values())
                keys, hs, size = [], [], 0
        groups = {}
        order = sorted(packed, key=lambda r: r[0])
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in order], pa.int32()), "keys": pa.array([r[1] for r in order], pa.binary()), "hs": pa.array([r[2] for r in order], pa.binary())})
        for b in linededup._stars(2)(iter([batch])):
            for k, h, r in zip(*b.to_pydict().values()):
                groups.setdefault(k, set()).update((h, r))
        ids = dict(zip(linededup.line_ids(lines)[0].tolist(), lines))
        assert set(map(frozenset, pairs_near(lines))) <= {frozenset((ids[x], ids[y])) for g in groups.values() for x in g for y in g if x != y}
    monkeypatch.undo()
    assert found_classes(spark, lines) == want


def test_numbers_of_the_same_digits_are_different_lines(spark):
    rng = np.random.default_rng(9)
    lines = ["Serial number " + "".join(rng.permutation(list("0123456789" * 2))) for _ in range(100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    kept = {r["text"] for r in rows(linededup.clean(df))}
    assert kept == set(lines) - {x for c in set(classes_of(lines).values()) for x in c if x != min(c, key=lines.index)}


def test_classes_on_the_table(spark, sf_dir):
    texts = [r.text for r in table(spark, sf_dir, "documents").select("text").collect()]
    lines = sorted({x for t in texts for x in (t or "").split("\n") if len(x) >= linededup.MIN_CHARS and linededup.WORDY.search(x)})
    want = classes_of(lines)
    assert found_classes(spark, lines) == want and want
