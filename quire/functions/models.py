"""What recognizers' raw answers need before they are compared, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.normalize import strip, sub, whitespace


def after_thinking(c: Column) -> Column:
    """The answer behind the last closing tag of a thinking block."""
    return strip(F.substring_index(c, "</think>", -1))


def tagged_values(c: Column) -> Column:
    """The texts between tags joined by spaces; without any, the text less its tags."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(">([^<]+)<"), 1), strip), lambda x: x != "")
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(whitespace(sub(c, "<[^>]+>", " ")))


def nested_lines(pages: Column) -> Column:
    """pages: array of blocks, each an array of lines, each an array of words: lines joined, a blank line between blocks."""
    line = lambda words: F.array_join(words, " ")
    block = lambda lines: F.array_join(F.transform(lines, line), "\n")
    return F.array_join(F.transform(pages, block), "\n\n")


def longest(texts: Column) -> Column:
    """The longest of an array of texts; of equally long ones the first."""
    ranked = F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    return F.array_max(ranked)["t"]


def first_filled(texts: Column) -> Column:
    return F.get(F.filter(texts, lambda t: strip(t) != ""), F.lit(0))
