"""Operators with exact results against brute force: decontamination, BPE, SimHash, counts, URLs, quality counts, LM base."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import bpe, counts, decontaminate, lm, quality, registry, simhash, urlfilter
from quire.llm.common import table
from tests.conftest import rows
from tests.llm.fixtures import CLASHING, clashing, fold_case, held_out, no_docs, odd_docs, words

ITEMS = "item_id long, text string, note string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# decontamination


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold_case(text))


def brute_leaks(docs, items, width=13):
    windows = defaultdict(set)
    for i, text in items:
        w = item_words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])] |= {str(i)} - {"None"}
    by_size = defaultdict(set)
    for win in windows:
        by_size[len(win)].add(win)
    out = []
    for d, text in docs:
        w, hit, found = item_words(text), set(), set()
        for size, wins in by_size.items():
            for k in range(len(w) - size + 1):
                if (win := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    found |= windows[win]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def leaks_of(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(df))


def leak_fixture(spark):
    texts = [f"w{i} common the w{i + 1} of a{i % 3} " * 6 for i in range(6)]
    odd = [(1, None, ""), (2, "", ""), (3, "Short Item", ""), (3, "short item", ""), (4, " ".join(f"t{i}" for i in range(20)), ""), (5, "the the the the the the the the the the the the the the", ""), (None, "null id item of five words", ""), (6, "...", "")]
    docs = [(20, "x SHORT, item! y short item"), (21, " ".join(f"t{i}" for i in range(3, 18)) + " end"), (22, "the " * 40), (23, "here null id item of five words there"), (24, "t0 t1 t2"), (25, texts[0]), (25, texts[0]), (25, texts[1])]
    items = [*odd, *((10 + i, t, "") for i, t in enumerate(texts[:3]))]
    return spark.createDataFrame(items, ITEMS), [(i, t) for i, t, _ in items], docs


@pytest.mark.parametrize("few", [True, False])
def test_leaks_on_odd_rows(spark, few, monkeypatch):
    items, plain, docs = leak_fixture(spark)
    from tests.llm.fixtures import ODD_TEXTS

    all_docs = [*ODD_TEXTS, *docs]
    df = spark.createDataFrame([(i, t) for i, t in all_docs], "doc_id long, text string")
    if not few:  # beyond the bound of the broadcast
        found = decontaminate.report(clashing(df), items, broadcast_windows=1)
        got = Counter()
        for r in rows(found):
            got[(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])] += r["copies"]
        assert got == brute_leaks(all_docs, plain)
    else:
        assert leaks_of(decontaminate.digests(clashing(df), items)) == brute_leaks(all_docs, plain)


def test_leaks_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    want = brute_leaks(docs, items)
    assert leaks_of(registry.op1_decontamination(spark, sf_dir)) == want
    assert any(x[-1] for x in want)


def test_leaks_with_empty_tables(spark):
    items, _, _ = leak_fixture(spark)
    assert decontaminate.digests(no_docs(spark), items).count() == 0
    clean = decontaminate.digests(odd_docs(spark), items.filter("false"))
    assert clean.count() == odd_docs(spark).count() and clean.filter("contaminated or n_hit > 0").count() == 0


def test_clean_documents_stay(spark):
    items, plain, docs = leak_fixture(spark)
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    kept = decontaminate.keep_clean(df, items)
    assert kept.columns == df.columns
    leak = lambda d, t, k: next(iter(brute_leaks([(d, t)], plain)))[k]
    assert Counter(r["text"] for r in rows(kept)) == Counter(t for d, t in docs if not leak(d, t, 2))
    assert Counter(r["text"] for r in rows(decontaminate.keep_clean(df, items, share=20))) == Counter(t for d, t in docs if not leak(d, t, 5))


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def library_row(tok, d, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return d, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False))


def coded(df):
    return Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(df))


def test_bpe_on_odd_rows(spark, library):
    docs = odd_docs(spark)
    want = Counter(library_row(library, r.doc_id, r.text) for r in docs.collect())
    assert coded(bpe.encode(clashing(docs))) == want
    assert bpe.encode(no_docs(spark)).count() == 0


def test_bpe_on_the_table(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert coded(registry.op2_bpe(spark, sf_dir)) == Counter(library_row(library, r.doc_id, r.text) for r in docs)


def test_bpe_trees_agree_with_the_library(library):
    rng = np.random.default_rng(3)
    codec = bpe.Codec(bpe.default_path(), leaf=8, threads=2)
    letters = list("abcdeéßñ日本1234567890!?,.ABCZ")
    for n in [*range(1, 60), 500, 3000]:
        word = "".join(rng.choice(letters, n))
        for text in (word, "a" * n, "ab" * n, word + "\u00a0" + word):
            ids, decoded = codec.encode(text)
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, text
            assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_texts_are_put_together_from_halves(spark, sf_dir, library):
    docs = [r.text or "" for r in table(spark, sf_dir, "documents").select("text").collect()]
    rng = np.random.default_rng(4)
    mixed = ["".join(rng.choice(list("ab é\n日.,'0"), n)) for n in (1, 5, 63, 64, 65, 129, 1000)] + ["<|endoftext|> " * 30, " " * 500, "x" * 500]
    for leaf, texts in ((bpe.TEXT_LEAF, docs[:60]), (7, docs[:10] + mixed), (64, docs[:20] + mixed)):
        codec = bpe.Codec(bpe.default_path(), text_leaf=leaf)
        for text in texts:
            ids, decoded = codec.encode(text)
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert decoded == library.decode(want, skip_special_tokens=False)
        assert codec.joined == sum(len(t) > leaf for t in texts)


def test_bpe_trees_end_with_unknown_characters():
    from tokenizers import Tokenizer, models

    tok = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "ab": 2}, merges=[("a", "b")]))
    codec = bpe.Codec(data=tok.to_str(), leaf=4)
    for text in ("z" * 40, "ab" * 20, "abz" * 20 + "a"):
        assert np.frombuffer(codec.encode(text)[0], "<u4").tolist() == tok.encode(text).ids


def test_bpe_ids_and_text_come_along(spark, library):
    got = rows(bpe.encode(spark.createDataFrame([(1, "Hello there, world")], "doc_id long, text string"), tokens=True))[0]
    assert got["ids"] == library.encode("Hello there, world", add_special_tokens=False).ids
    assert got["decoded"] == library.decode(got["ids"], skip_special_tokens=False)


# SimHash


def brute_fingerprint(text):
    import xxhash

    w = words(fold_case(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(pairs):
    """The least id reachable by links of two bits or fewer."""
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return Counter((d, f"{f:016x}", least.get(root(f))) for d, f in pairs)


def groups_of(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(df))


def test_simhash_on_odd_rows(spark):
    docs = odd_docs(spark)
    want = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    assert groups_of(simhash.report(clashing(docs))) == want
    assert simhash.report(no_docs(spark)).count() == 0


def test_simhash_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in docs])
    assert groups_of(registry.op5_simhash(spark, sf_dir)) == want
    assert any(d != c for d, _, c in want)


def test_links_are_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for base in rng.integers(0, 1 << 63, 40).tolist():
        for _ in range(8):
            base ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
            fps.add(base)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {(r["a"], r["b"]) for r in rows(simhash.links(spark.createDataFrame(signed, "fp long")))}
    want = {(min(a, b), max(a, b)) for (a,) in signed for (b,) in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and want


def test_one_document_of_each_group_stays(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == docs.columns + CLASHING
    found = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    ids = [r["doc_id"] for r in rows(kept)]
    # of an id that stands for two groups, a row of each may stay
    stay = Counter(d for d, _, c in found if d is not None and d == c)
    assert Counter(i for i in ids if i is not None) == stay and ids.count(None) == sum(n for (d, _, _), n in found.items() if d is None)


# token counts


def test_counts_follow_deltas_and_commits_are_idempotent(spark, tmp_path):
    kind = "op string, source string, lang string, text string, old_text string"
    ledger = counts.Ledger(spark, str(tmp_path / "ledger"))
    first = spark.createDataFrame([("insert", "s", "en", "a b c", None), ("insert", "s", None, None, None), ("insert", None, "en", "x", None)], kind)
    assert ledger.commit("1", first) and not ledger.commit("1", first)
    again = counts.Ledger(spark, str(tmp_path / "ledger"))
    assert not again.commit("1", first)
    second = spark.createDataFrame([("revise", "s", "en", "a, b c d", "a b c"), ("delete", None, "en", None, "x")], kind)
    assert again.commit("2", second)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rows(again.totals())}
    assert got == {("s", "en", "space-1"): (1, 4), ("s", "en", "word-1"): (1, 4), ("s", None, "space-1"): (1, 0), ("s", None, "word-1"): (1, 0)}


def test_documents_move_and_batches_are_folded(spark, tmp_path):
    ledger = counts.Ledger(spark, str(tmp_path / "ledger"))
    make = lambda *r: spark.createDataFrame(list(r), "batch_id string, " + counts.CHANGE)
    first = make(("1", "insert", "s", "en", "a b c", None, None, None), ("1", "insert", "s", "en", "d", None, None, None), ("2", "revise", "t", "de", "a b", "s", "en", "a b c"), ("2", "delete", None, None, None, "s", "en", "d"))
    assert ledger.commit_all(first, ["1", "2", "3"]) == ["1", "2", "3"] and ledger.commit_all(first, ["2", "1"]) == []
    want = [("de", 1, 2, "t")] * 2
    got = lambda: sorted((r["lang"], r["n_docs"], r["n_tokens"], r["source"]) for r in rows(ledger.totals()))
    assert got() == want
    ledger.compact()
    assert got() == want and ledger.commit_all(first, ["1", "2", "3"]) == [] and ledger.batches() == {"1", "2", "3"}
    # a compaction that ended before it removed the folded batches
    counts.delta(first.filter("batch_id = '1'")).write.parquet(str(tmp_path / "ledger/batch_id=1"))
    assert got() == want
    assert ledger.commit("4", make(("4", "insert", "t", "de", "x", None, None, None)).drop("batch_id"))
    ledger.compact()
    assert got() == [("de", 2, 3, "t")] * 2
    with pytest.raises(ValueError):
        ledger.commit("a/b", first)


def test_a_half_written_batch_does_not_count(spark, tmp_path):
    ledger = counts.Ledger(spark, str(tmp_path / "ledger"))
    one = spark.createDataFrame([("insert", "s", "en", "a b", None)], "op string, source string, lang string, text string, old_text string")
    counts.delta(one).write.parquet(str(tmp_path / "ledger/_aside-lost"))
    assert ledger.commit("1", one)
    assert [r["n_tokens"] for r in rows(ledger.totals())] == [2, 2]


def test_counts_on_odd_rows(spark):
    docs = odd_docs(spark)
    want = Counter()
    n = Counter()
    for r in docs.collect():
        for name, pattern in (("space-1", r"[^\x20\x09-\x0D]+"), ("word-1", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
            want[r.source, r.lang, name] += len(re.findall(pattern, r.text or ""))
            n[r.source, r.lang, name] += 1
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rows(counts.load(spark, clashing(docs)))}
    assert got == {k: (n[k], want[k]) for k in n}
    assert counts.load(spark, no_docs(spark)).count() == 0


# URL filters


def brute_url(url, rules=urlfilter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    bare = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, tail = bare.partition("/")
    host, path = fold_case(host), bare[len(host) :]
    fit = [(len(h) + len(p), f"{h}/{p}", v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_urls(spark):
    urls = [
        None, "", "no scheme/en/", "http://", "HTTP://A.COM/en/x", "https://com/en/", "x://example.com/en/7?q=://b", "x://notexample.com/en/7", "x://a.b.example.com/en/71", "x://example.net/de/8#f", "x://b.net/de/", "x://net./de/",
        "x://a.org/es", "x://a.org/es/", "x://a.org?/es/", "x://ÄB.org/es/ü", "x://a.org:80/es/", "x://u@a.org/es/", "://org/es/", "x://org//es/",
    ]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "own") for i, u in enumerate([*urls, *urls[:2]])], "page_id long, url string, host string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urlfilter.judge(pages)))
    assert got == Counter((i if i != 3 else None, *brute_url(u)) for i, u in enumerate([*urls, *urls[:2]]))
    assert urlfilter.judge(pages.filter("false")).count() == 0


def test_equal_rules_block(spark):
    pages = spark.createDataFrame([(1, "x://a.com/p/q")], "page_id long, url string")
    got = rows(urlfilter.judge(pages, [("allow", "com", "p/"), ("block", "com", "p/")]))[0]
    assert (got["rule"], got["verdict"]) == ("com/p/", "block")


# quality counts


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("odd", [True, False])
def test_quality_counts(spark, sf_dir, odd):
    docs = odd_docs(spark) if odd else table(spark, sf_dir, "documents")
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows(quality.judge(clashing(docs), None)))
    want = Counter()
    for r in docs.collect():
        q = brute_quality(r.text)
        want[(r.doc_id, *q, q[0] < 10 or 100 * q[4] > 20 * q[0])] += 1
    assert got == want
    assert quality.judge(no_docs(spark), None).count() == 0


# LM base


@pytest.mark.parametrize("odd", [True, False])
def test_lm_counts_and_base(spark, sf_dir, odd):
    docs = odd_docs(spark) if odd else table(spark, sf_dir, "documents")
    tokens = lambda t: [*words(fold_case(t)), None]
    seen = Counter(x for r in docs.collect() if not held_out(r.doc_id, 7, 2) for x in tokens(r.text))
    n, v = sum(seen.values()), len(seen)
    got = rows(lm.score(clashing(docs), *lm.train(docs)))
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(r.text)
    assert len(got) == docs.count()
    left = {d: [(len(tokens(t)), sum(x in seen for x in tokens(t)), sum(math.log10((seen[x] + 1) / (n + 1 * (v + 1))) for x in tokens(t))) for t in ts] for d, ts in text.items()}
    for r in got:
        assert r["train_tokens"] == n and r["held_out"] == held_out(r["doc_id"], 7, 2)
        assert any(r["n_tokens"] == a and r["n_known"] == b and abs(r["base_score"] - c) < 1e-6 * max(1, abs(c)) for a, b, c in left[r["doc_id"]]), r
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_lm_without_rows(spark):
    assert lm.score(no_docs(spark), *lm.train(no_docs(spark))).count() == 0
    docs = odd_docs(spark)
    model, counted = lm.train(docs.filter("false"))
    assert all(r["score"] == r["base_score"] for r in rows(lm.score(docs, model, counted)))


def test_url_rules_as_stated(spark):
    """The verdicts written out, not taken from RULES."""
    want = {
        "http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://x.example.com/en/6": ("com/en/", "block"),
        "http://a.net/de/8": ("net/de/", "allow"), "http://x.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://a.org/es/": ("org/es/", "block"), "http://a.org/en/": (None, "allow"), "http://com/": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(urlfilter.judge(pages))}
    assert got == dict(enumerate(want.values()))
