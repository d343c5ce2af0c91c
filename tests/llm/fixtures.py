"""Documents with the cases that each operator defines, and plain ways to read the tables."""

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\v\f\r"


def fold_case(text):
    return (text or "").translate({ord(c): ord(c) + 32 for c in UPPER})


def words(text):
    """Runs of [^\\x20\\x09-\\x0D]."""
    for c in SPACE[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Zürich ÀÉ naïve \u00a0 word\u2028sep\u0085x"), (6, "\x00\x01 control \x1f chars \x7f"),
    (7, "😀 emoji 𝔘𝔫𝔦 日本語のテキスト ①②"), (8, "A b C d E f G h"), (8, "A b C d E f G h"), (8, "another text, same id"), (None, "no id at all here"), (None, None),
    (9, "x" * 30_000), (10, "long " * 20_000), (11, "a\r\nb\r\nc"), (12, "<|endoftext|> <|startoftext|>special tokens <|endoftext|>"),
    (13, "line one is here\nline one is here\n\nline two is here\nline one is here"), (14, "!!! ??? ... ---"),
]


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, one id twice with different texts."""
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", len(t or "")) for i, t in ODD_TEXTS], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


CLASHING = ["d", "h", "at", "w", "key", "word", "token", "win", "fp", "least", "node", "block", "line", "odd", "n", "copies", "lang_pred", "score", "held_out", "quire_id", "quire_0", "first", "b", "a", "quire_text", "links", "ats", "near", "exact"]


def clashing(docs):
    """docs with extra columns under the names that operators use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
