"""Benchmark decontamination: a prefix-filtered set join, native expressions only.

Item windows (WINDOW consecutive words; a shorter item is one window) are the sets to be contained. For
whole containment one token of a window is a sufficient prefix when tokens are ordered by rarity, so each
distinct window joins on its rarest word: the one with fewest occurrences in the corpus (counted over all
documents, for the benchmark's words only). A document position with that word gives one candidate place
for the window; the length and position bound (the window lies within the document) is checked, then the
words themselves are compared. Documents are split once per pass; exploded words are joined with the
broadcast prefixes inside one generated stage, so only hits are ever shuffled. A marker token carries each
document's length through the same join.

The prefixes are broadcast while there are at most `broadcast_windows` distinct windows, counted first;
beyond that the exploded words are joined by a shuffle and the candidates checked in a second join.

Words: A-Z folded, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Defined cases: a null or empty text has no
words and is clean; null or empty items have no windows; an item without an id marks words but is not
listed; an empty benchmark leaves every document clean, empty documents give no rows; texts are split and compared
whole, however long; of equally rare words of a window that which sorts first is its prefix (either finds the same
places). Repeated rows (same id and text) come out as often as they came in, each with its own result. Extra
columns are not looked at, whatever their names; keep_clean() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, free

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words; upper-case letters are folded later.
BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
MARK = "\x00"


def pieces(text: Column) -> Column:
    """Words in order, with an empty piece first or last where a break stands there."""
    return F.split(F.coalesce(text, F.lit("")), BREAK, -1)


def count_words(parts: Column) -> Column:
    empty = lambda k: (F.element_at(parts, k) == "").cast("long")
    return F.size(parts).cast("long") - empty(1) - F.when(F.size(parts) > 1, empty(-1)).otherwise(0)


def folded(words: Column) -> Column:
    """The words as one string, A-Z folded; words hold no space."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, win): win, the folded words of each window, joined by spaces."""
    words = F.filter(F.split(folded(pieces(F.col("text"))), " "), lambda w: w != "")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " "))).alias("win")).distinct()


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(token, place, size, win): each distinct window with its rarest word in docs and that word's place."""
    distinct = wins.select("win").distinct().select("win", F.split("win", " ").alias("w"))
    tokens = distinct.select(F.explode("w").alias("token")).distinct()
    # one row for each word of the benchmark, in the form that documents' words are looked up by
    seen = docs.select(F.explode(pieces(F.col("text"))).alias("token")).select(F.lower("token").alias("token"))
    keys = tokens.select(F.lower("token").alias("token")).distinct()
    counted = seen.join(small(keys), "token").groupBy("token").agg(F.count("*").alias("n"))
    placed = distinct.select("win", F.size("w").alias("size"), F.posexplode("w").alias("place", "word")).withColumn("token", F.lower("word"))
    ranked = placed.join(counted, "token", "left")
    first = ranked.groupBy("win", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("best"))
    return first.select(F.col("best.token").alias("token"), F.col("best.place").alias("place"), "size", "win")


_small: dict[str, int] = {"rows": 200_000}


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if a count shows that it has no more rows than the bound."""
    return F.broadcast(df) if df.limit(_small["rows"] + 1).count() <= _small["rows"] else df


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, broadcast_windows: int = 200_000) -> DataFrame:
    """For each row of docs: doc_id, quire_text (hash of the text), copies, n_words, spans of hit pieces, item_ids."""
    wins = cut(windows(benchmark, width))
    pre = cut(prefixes(docs, wins))
    few = wins.count() <= broadcast_windows
    mark = docs.sparkSession.createDataFrame([(MARK, 0, 0, None, None)], "token string, place int, size int, win string, item_id string")
    pre = pre.join(F.broadcast(wins) if few else wins, "win").select("token", "place", "size", "win", "item_id").unionByName(mark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("quire_text"), pieces(F.col("text")).alias("w"))
    if few:
        rows = own.select("doc_id", "quire_text", "w", F.posexplode(F.concat(F.array(F.lit(MARK)), F.col("w"))).alias("at", "word"))
        rows = rows.select("doc_id", "quire_text", "w", "at", F.lower("word").alias("word"))
        # "at" counts from 1, the marker is 0; a window begins `place` words earlier
        begin = F.col("at") - F.col("place")
        fits = (begin >= 1) & (begin + F.col("size") - 1 <= F.size("w"))
        same = folded(F.slice("w", begin, F.col("size"))) == F.col("win")
        found = rows.join(F.broadcast(pre), (F.col("word") == F.col("token")) & (F.col("win").isNull() | (fits & F.when(fits, same).otherwise(False))))
        found = found.select("doc_id", "quire_text", F.when(F.col("win").isNull(), count_words(F.col("w"))).alias("n"), F.when(F.col("win").isNotNull(), begin).alias("begin"), "size", "item_id")
    else:
        rows = own.select("doc_id", "quire_text", F.posexplode("w").alias("at", "word")).select("doc_id", "quire_text", (F.col("at") + 1).alias("at"), F.lower("word").alias("word"))
        near = rows.join(pre, F.col("word") == F.col("token")).select("doc_id", "quire_text", (F.col("at") - F.col("place")).alias("begin"), "size", "win", "item_id").filter("begin >= 1").distinct()
        there = own.alias("o").dropDuplicates(["doc_id", "quire_text"]).join(near.alias("c"), F.col("o.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("o.quire_text") == F.col("c.quire_text")))
        there = there.filter((F.col("begin") + F.col("size") - 1 <= F.size("w"))).filter(folded(F.slice("w", F.col("begin"), F.col("size"))) == F.col("win"))
        there = there.select("o.doc_id", "o.quire_text", F.lit(None).cast("long").alias("n"), "begin", "size", "item_id")
        found = own.select("doc_id", "quire_text", count_words(F.col("w")).alias("n"), F.lit(None).cast("int").alias("begin"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("item_id")).unionByName(there)
    span = F.when(F.col("begin").isNotNull(), F.struct("begin", (F.col("begin") + F.col("size")).alias("end")))
    return found.groupBy("doc_id", "quire_text").agg(
        F.max("n").alias("n_words"), F.count("n").alias("copies"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], s["to"]))).cast("long").alias("n"), F.greatest(s["to"], x["end"]).alias("to"))
    return F.aggregate(spans, start, step)["n"]


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20, broadcast_windows: int = 200_000) -> DataFrame:
    """One row for each row of docs; contaminated where at least one word in `share` is hit."""
    found = hits(docs, benchmark, width, broadcast_windows)
    out = found.select(
        "doc_id", "quire_text", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "item_ids", "spans", "copies",
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The report without texts and spans, one row for each row of docs."""
    out = report(docs, benchmark)
    out = out.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: int | None = None) -> DataFrame:
    """docs without those that hold a window of the benchmark; with share, only those go that are contaminated by it
    (at least one word in `share` hit). All columns stay."""
    own, text = free(docs, "quire_id", "quire_hash")
    bad = hits(docs, benchmark).filter(F.size("spans") > 0) if share is None else report(docs, benchmark, share=share).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias(own), F.col("quire_text").alias(text))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[own]) & (F.xxhash64(docs["text"]) == bad[text]), "left_anti")
