"""Edit-distance metrics as Column builders; all but the best window and distances of long texts evaluate inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.base import let

#: Tokens are written as single code points from here on (a plane without surrogates or letters).
_PLANE = 0x10000


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points; null counts as empty."""
    return F.levenshtein(_text(a), _text(b))


def ned(a: Column, b: Column) -> Column:
    """Distance over the longer length; two empty texts have 0."""
    longer = F.greatest(F.length(_text(a)), F.length(_text(b)), F.lit(1))
    return distance(a, b) / longer


def similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - ned(a, b)


def weight(a: Column, b: Column) -> Column:
    """Weight of a pair in micro averages: the longer length, at least 1."""
    return F.greatest(F.length(_text(a)), F.length(_text(b)), F.lit(1))


def _rate(d: Column, n_ref: Column, n_hyp: Column) -> Column:
    return F.when(n_ref > 0, d / n_ref).otherwise((n_hyp > 0).cast("double"))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate; it may exceed 1. Empty reference: 0 against empty, else 1."""
    return _rate(distance(reference, hypothesis), F.length(_text(reference)), F.length(_text(hypothesis)))


def tokens(text: Column) -> Column:
    """Words between white space (Unicode), without empty ones."""
    return F.filter(F.split(_text(text), "(?U)[\\s\\x1c-\\x1f]+"), lambda w: w != "")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over arrays of tokens: each distinct token becomes one code point, and the
    built-in distance runs over the two strings. Holds for up to 900,000 distinct tokens in a pair."""

    def spelled(xs: Column, place: Column) -> Column:
        letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.element_at(place, w).cast("long") + _PLANE), 8, "0")), "UTF-32")
        return F.array_join(F.transform(xs, letter), "")

    def coded(t: Column, known: Column) -> Column:
        place = F.map_from_arrays(known, F.sequence(F.lit(1), F.size(known)))
        both = let(place, lambda m: F.levenshtein(spelled(t["a"], m), spelled(t["b"], m)))
        return F.when(F.size(known) == 0, F.lit(0)).otherwise(both)

    pair = F.struct(a.alias("a"), b.alias("b"))
    return let(pair, lambda t: let(F.array_distinct(F.concat(t["a"], t["b"])), lambda known: coded(t, known)))


def wer(reference: Column, hypothesis: Column) -> Column:
    pair = F.struct(tokens(reference).alias("a"), tokens(hypothesis).alias("b"))
    return let(pair, lambda t: _rate(token_distance(t["a"], t["b"]), F.size(t["a"]), F.size(t["b"])))


def long_distance(a: Column, b: Column, words: bool = False) -> Column:
    """As distance, or with `words` as token_distance, for texts of whole pages: in bits, by Arrow batches. The built-in
    distance passes each cell of the table by itself."""
    from quire.operators.solvers import distances

    def spelled(u: list[str], v: list[str]) -> list[str]:
        place: dict[str, int] = {}
        return ["".join([chr(_PLANE + place.setdefault(w, len(place))) for w in ws]) for ws in (u, v)]

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [spelled(u, v) if words else [u, v] for u, v in zip(x, y, strict=True)]
        at = 2 * np.arange(len(pairs))
        return pd.Series(distances([t for pair in pairs for t in pair], at, at + 1), dtype="int32")

    return run(a, b) if words else run(_text(a), _text(b))


def best_window(needle: Column, hay: Column) -> Column:
    """struct(d, at): least distance of needle to any equally long window of hay, relative to its length,
    and the first such window (from 0); null where needle is empty or longer than hay. By Arrow batches, many pairs at once."""
    from quire.operators.solvers import windows

    @F.pandas_udf("struct<d:double,at:int>")
    def run(needles: pd.Series, hays: pd.Series) -> pd.DataFrame:
        pairs = [(n, h) if isinstance(n, str) and isinstance(h, str) else ("", "") for n, h in zip(needles, hays, strict=True)]
        found = [w and (w[0] / len(n), w[1]) for (n, _), w in zip(pairs, windows(*map(list, zip(*pairs, strict=True))) if pairs else [], strict=True)]
        return pd.DataFrame([p or (None, None) for p in found], columns=["d", "at"]).astype({"d": "float64", "at": "Int32"})

    found = run(needle, hay)
    return F.when(found["d"].isNotNull() & ~F.isnan(found["d"]), found)
