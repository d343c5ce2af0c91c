"""Tokens are counted on bytes, all versions in one pass over a text, and as the versions' patterns count them."""

import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import counts
from quire.llm import vectext as V


def odd_texts() -> list[str | None]:
    rng = np.random.default_rng(5)
    signs = ["a", "Z", "0", "9", " ", "\t", "\x0b", "\r", "\n", "\x00", "\x1f", "/", ":", "@", "[", "`", "{", "\x7f", "\x85", "\xa0", "é", " ", "漢", "😀"]
    some = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(500)]
    return [None, "", *some, "", "a", "a", None, "b " * 300_000, "c" * 1_200_000, " ", "d"]


def test_runs_of_bytes_are_the_patterns_matches():
    texts = odd_texts()
    for column in (pa.array(texts), pa.array(["x", *texts])[1:]):
        for token in counts.VERSIONS.values():
            got = np.concatenate([counts.n_tokens(some, token) for _, _, some in V.slices(column)])
            assert got.tolist() == [len(re.findall(token, t or "")) for t in texts]


def test_counts_and_texts_stay_together(spark):
    texts = odd_texts()
    made = [("insert", f"s{k % 7}" if k % 7 else None, "en", t, None) for k, t in enumerate(texts)]
    made += [("revise", "s1", "de", t, texts[-k - 1]) for k, t in enumerate(texts)] + [("delete", "s2", "fr", None, t) for t in texts]
    want: dict[tuple, list[int]] = {}
    for op, source, lang, new, old in made:
        for name, token in counts.VERSIONS.items():
            held = want.setdefault((source, lang, name), [0, 0])
            for d, t in ((1, new), (-1, old)):
                if op != ("delete" if d > 0 else "insert"):
                    held[0] += d
                    held[1] += d * len(re.findall(token, t or ""))
    df = spark.createDataFrame(made, "op string, source string, lang string, text string, old_text string").repartition(3)
    found = counts.delta(df)
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in found.collect()} == want
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("token", ["[a-z]+", "[^\\x20]", "[^é]+", "\\w+"])
def test_other_patterns_are_refused(token):
    with pytest.raises(ValueError):
        counts.token_bytes(token)
