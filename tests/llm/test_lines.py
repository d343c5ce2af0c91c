"""Line dedup against brute force over all pairs of lines, and the edit distance by itself."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quire.llm import editdist, linededup, registry
from quire.llm.common import table
from tests.conftest import rows
from tests.llm.fixtures import CLASHING, clashing, no_docs, odd_docs
from tests.llm.near import classes_of, distance

LAST = (1 << 63) - 1


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_bounded_distance(most):
    rng = np.random.default_rng(most)
    a, b = [], []
    for _ in range(1500):
        x = list("".join(rng.choice(list("abcé😀"), rng.integers(0, 40))))
        y = list(x)
        for _ in range(rng.integers(0, most + 3)):
            k = int(rng.integers(0, len(y) + 1))
            op = rng.integers(0, 3)
            if op == 0 or not y:
                y.insert(k, str(rng.choice(list("abcd"))))
            elif op == 1:
                del y[k % len(y)]
            else:
                y[k % len(y)] = str(rng.choice(list("abcd")))
        a.append("".join(x))
        b.append("".join(y))
    got = editdist.within(a, b, most)
    assert got.tolist() == [distance(x, y) <= most for x, y in zip(a, b)]
    assert editdist.within([], [], most).tolist() == []


def test_probes_find_every_line_within_the_threshold():
    """Whatever two edits do, some segment of the shorter line is among the probed substrings of the longer one."""
    rng = np.random.default_rng(4)
    for t in (1, 2, 3):
        for _ in range(3000):
            n = int(rng.integers(t + 1, 30))
            x = "".join(rng.choice(list("ab"), n))
            y = list(x)
            for _ in range(t):
                k, op = int(rng.integers(0, len(y) + 1)), rng.integers(0, 3)
                if op == 0:
                    y.insert(k, str(rng.choice(list("ab"))))
                elif op == 1 and len(y) > 1:
                    del y[k % len(y)]
                else:
                    y[k % len(y)] = str(rng.choice(list("ab")))
            y = "".join(y)
            short, long = sorted((x, y), key=len)
            index = {(len(short), i, short[p : p + s]) for i, (p, s) in enumerate(linededup.segments(len(short), t))}
            assert any((length, i, long[p : p + s]) in index for length, i, p, s in linededup.probes(len(long), t))


def place(d, text):
    """What orders documents: id (null last), then Spark's hash of the text."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return (LAST if d is None else d, h - (1 << 64) if h >> 63 else h)


def brute(docs):
    """(id, kept text, n_lines, n_exact, n_near, n_links, n_kept) of each row."""
    lines, docs = {}, [(place(d, text), text) for d, text in docs]
    for d, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if linededup.WORDY.search(line):
                lines[line] = min(lines.get(line, (d, k)), (d, k))
    classes = classes_of([x for x in lines if len(x) >= linededup.MIN_CHARS])
    rank = dict(zip(lines, zip(lines.values(), *(map(int, x) for x in linededup.line_ids(list(lines))))))
    first = {c: min(c, key=rank.get) for c in set(classes.values())}
    out = []
    for (d, w), text in docs:
        if text is None:
            out.append((d, None, 0, 0, 0, 0, 0))
            continue
        seen, kept, exact, close, n_links = set(), [], 0, 0, 0
        for line in text.split("\n"):
            if linededup.WORDY.search(line):
                if line in seen:
                    exact += 1
                    continue
                seen.add(line)
                n_links += len(classes.get(line, " ")) - 1
                if lines[line][0] < (d, w):
                    exact += 1
                    continue
                if line in classes and first[classes[line]] != line:
                    close += 1
                    continue
            kept.append(line)
        out.append((d, "\n".join(kept), len(text.split("\n")), exact, close, n_links, len(kept)))
    return out


def reported(df):
    return Counter((LAST if r["doc_id"] is None else r["doc_id"], r["kept_sha256"], r["n_lines"], r["n_exact"], r["n_near"], r["n_links"], r["n_kept"]) for r in rows(df))


def wanted(docs):
    return Counter((d, None if t is None else hashlib.sha256(t.encode()).hexdigest(), *more) for d, t, *more in brute(docs))


def fixture(spark):
    base = "this is a line of some length to be found"
    edits = [base, base + "!", base.replace("some", "sme"), base.replace("line", "lime").replace("found", "fount"), base.upper(), "x" + base + "yz", base[:30], base[2:]]
    docs = [(20 + i, f"{x}\n---\nown line number {i} stands here alone\n{x if i % 2 else '...'}") for i, x in enumerate(edits)]
    docs += [(40, "a shared line\nshort"), (41, "a shared line\nshort\n\n"), (42, "a shared line"), (None, "a shared line\n" + base)]
    odd = [(r.doc_id, r.text) for r in odd_docs(spark).select("doc_id", "text").collect()]
    return docs + odd


def test_report_on_odd_rows(spark):
    docs = fixture(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert reported(linededup.report(clashing(df))) == wanted(docs)
    assert linededup.report(no_docs(spark)).count() == 0


def test_report_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert reported(registry.op7_line_dedup(spark, sf_dir)) == wanted(docs)


def test_clean_drops_documents_that_lose_all(spark):
    docs = fixture(spark)
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    out = linededup.clean(df)
    assert out.columns == ["doc_id", "text", *CLASHING]
    want = Counter((d, t) for (d, t, *_), (_, was) in zip(brute(docs), docs) if t is None or t.strip() or not was.strip())
    assert Counter((LAST if r["doc_id"] is None else r["doc_id"], r["text"]) for r in rows(out)) == want


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "the same line in two equal rows")] * 2, "doc_id long, text string")
    assert [r["n_kept"] for r in rows(linededup.report(df))] == [1, 1]
