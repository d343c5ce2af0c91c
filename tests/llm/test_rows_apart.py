"""Rows without an id, and with one id and different texts, are documents of their own."""

from collections import Counter

import xxhash

from quire.llm import linededup, simhash
from tests.conftest import rows
from tests.llm.fixtures import clashing, odd_docs

LAST = (1 << 63) - 1


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_clean(docs):
    """Exact repeats only: no lines here are near to others."""
    at = [(LAST if d is None else d, text_hash(t) if t is not None else 42) for d, t in docs]
    first = {}
    for own, (_, text) in zip(at, docs):
        for line in (text or "").split("\n"):
            first[line] = min(first.get(line, own), own)
    out = Counter()
    for own, (d, text) in zip(at, docs):
        kept, seen = [], set()
        for line in (text or "").split("\n"):
            if linededup.WORDY.search(line):
                if line in seen or first[line] < own:
                    continue
                seen.add(line)
            kept.append(line)
        new = None if text is None else "\n".join(kept)
        if new is None or new.strip() or not text.strip():
            out[d, new] += 1
    return out


def test_line_dedup_keeps_rows_apart(spark):
    docs = [(1, "a line that all rows share"), (None, "one\nonly here: alpha\na line that all rows share"), (None, "a line that all rows share\nonly here: beta\nonly here: gamma"), (None, "a line of null rows only\nx"), (None, "a line of null rows only\ny"),
            (5, "a line that all rows share\nfive, first text"), (5, "five, second text\nnumber two of it"), (6, "equal rows"), (6, "equal rows")]
    docs += [(r.doc_id, r.text) for r in odd_docs(spark).select("doc_id", "text").collect()]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in rows(linededup.clean(df))) == brute_clean(docs)


def test_simhash_keeps_rows_apart(spark):
    a, b, c = ("one text of some words that stand here", "another text with words of its own in it", "third and last of the texts that differ")
    docs = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (None, a), (None, c), (None, c), (None, None)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # b's only document with the smallest id is the one of id 2, whose other row is a copy of 1
    assert Counter((r["doc_id"], r["text"]) for r in rows(kept)) == Counter([(1, a), (2, b), (4, c), (None, a), (None, c), (None, c), (None, None)])
