"""BPE encoding and decoding, exactly as the tokenizers library does, by tree concatenation.

A text longer than a leaf is halved, wherever the middle falls, until its parts are leaves; the leaves' words are
encoded together, in one call of the library outside Python's lock (each word once while it is remembered), and the
parts are joined again in pairs. Where a cut fell into a word, a window around the join is encoded anew as one text
and grown by a word on each side until its first and last words encode as both sides have them. Neither the
normaliser nor the pre-tokeniser looks across white space, so this agreement makes the whole exact.

A single pre-token too long for one go (a word of over `leaf` characters) is itself encoded as a tree: its halves in
parallel (threads), and at each join a window that is grown until its first and last token are those that both sides
have there. As a sequence is the encoding of its text when every adjacent pair of tokens is, agreement on both sides
makes the whole exact. (Merges make each token in one way, and none before its parts.) Where tokens do not spell the
pre-token (unknown characters), it is encoded by the library at one go.

Defined cases: a null or empty text has no tokens, and decodes to empty text; very long texts are encoded whole.
Repeated rows are encoded one by one. Special-token strings in a text are encoded as the library does: as those
tokens. Ties between merges are the tokenizer's own. An empty table gives no rows; extra columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mapped

#: Characters of a text, and of one pre-token, that are a leaf of the tree; words that a task remembers.
TEXT_LEAF, LEAF = 1 << 11, 1 << 12
REMEMBERED = 300_000
#: Cuts at ASCII white space only: every tokenizer's idea of white space holds it.
WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """An encoder and decoder of one tokenizer file."""

    def __init__(self, path: str | None = None, leaf: int = LEAF, threads: int = 2, data: str | None = None, remembered: int = REMEMBERED, text_leaf: int = TEXT_LEAF):
        from tokenizers import Tokenizer, models

        data = data if data is not None else open(path, encoding="utf-8").read()
        self.tok = Tokenizer.from_str(data)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.threads, self.remembered, self.text_leaf = leaf, threads, remembered, text_leaf
        self.joined = 0  # texts that were put together from halves
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        raw = json.loads(data)
        model = raw["model"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.model = self.tok.model
        self.inside = models.BPE(vocab=model["vocab"], merges=merges) if self.suffix else self.model
        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.special = [t["content"] for t in raw["added_tokens"]]

    # a pre-token, as the model sees it

    def _ids(self, symbols: str, last: bool) -> list[int]:
        return [t.id for t in (self.model if last else self.inside).tokenize(symbols)]

    def _length(self, token: int, last: bool) -> int:
        text = self.text_of[token]
        return len(text) - (len(self.suffix) if last and self.suffix and text.endswith(self.suffix) else 0)

    def tree(self, symbols: str) -> list[int]:
        """The ids of one pre-token of any length."""
        pieces = [symbols]
        while len(pieces[0]) > self.leaf:
            pieces = [h for p in pieces for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        ends = [k == len(pieces) - 1 for k in range(len(pieces))]
        with ThreadPoolExecutor(self.threads) as pool:
            nodes = list(pool.map(self._ids, pieces, ends))
            sizes = [len(p) for p in pieces]
            if any(sum(self._length(t, last) for t in node) != n for node, n, last in zip(nodes, sizes, ends, strict=True)):
                return self._ids(symbols, True)
            while len(nodes) > 1:
                starts = np.concatenate([[0], np.cumsum(sizes)])
                jobs = [(symbols, int(starts[k]), int(starts[k + 1]), int(starts[k + 2]), nodes[k], nodes[k + 1]) for k in range(0, len(nodes), 2)]
                nodes = list(pool.map(lambda j: self.join(*j), jobs))
                sizes = [sizes[k] + sizes[k + 1] for k in range(0, len(sizes), 2)]
        return nodes[0]

    def join(self, symbols: str, begin: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of symbols[begin:end] from those of symbols[begin:middle] and symbols[middle:end]."""
        last = end == len(symbols)
        k = 2
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            a = middle - sum(self._length(t, False) for t in left[i:])
            b = end if j == len(right) else middle + sum(self._length(t, False) for t in right[:j])
            ids = self._ids(symbols[a:b], last and b == end)
            whole_left, whole_right = i == 0, j == len(right)
            if (whole_left and whole_right) or sum(self._length(t, last and b == end) for t in ids) != b - a:
                return ids if whole_left and whole_right else self._ids(symbols[begin:end], last)
            if ids and (whole_left or ids[0] == left[i]) and (whole_right or ids[-1] == right[j - 1]):
                return left[:i] + ids + right[j:]
            k *= 2

    # a text

    def _long(self, word: str) -> list[int]:
        """A run without white space of over self.leaf characters."""
        if any(s in word for s in self.special):
            return self.tok.encode(word, add_special_tokens=False).ids
        shown = self.tok.normalizer.normalize_str(word) if self.tok.normalizer else word
        pieces = [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(shown)] if self.tok.pre_tokenizer else [shown]
        return [i for w in pieces for i in (self.tree(w) if len(w) > self.leaf else self._ids(w, True))]

    def _learn(self, words: list[str]) -> None:
        """Ids (as bytes) and decoded text of words that are not remembered."""
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if not new:
            return
        if len(self.ids) + len(new) > self.remembered:
            self.ids.clear()
            self.decoded.clear()
            new = list(dict.fromkeys(words))
        short = [w for w in new if len(w) <= self.leaf]
        found = [(w, e.ids) for w, e in zip(short, self.tok.encode_batch_fast(short, add_special_tokens=False), strict=True)]
        found += [(w, self._long(w)) for w in new if len(w) > self.leaf]
        for w, ids in found:
            self.ids[w] = np.asarray(ids, "<u4").tobytes()
        if self.tok.decoder is None:
            self.decoded.update(zip((w for w, _ in found), self.tok.decode_batch([i for _, i in found], skip_special_tokens=False)))

    def forget(self, most: int = 50_000) -> None:
        """A worker outlives its task: it keeps the tokenizer, but no more than `most` words."""
        if len(self.ids) > most:
            self.ids.clear()
            self.decoded.clear()

    def words_of(self, text: str) -> list[str]:
        """The words of a text, by way of its leaves."""
        size, cuts = self.text_leaf, [0, len(text)]
        while len(text) > size * (len(cuts) - 1):
            cuts = [c for a, b in zip(cuts, cuts[1:]) for c in (a, (a + b) // 2)] + [len(text)]
        parts = [WORD.findall(text[a:b]) for a, b in zip(cuts, cuts[1:])]
        # pieces of words that a cut fell into are not encoded, nor remembered
        cut = [False, *(WORD.fullmatch(text, c - 1, c + 1) is not None for c in cuts[1:-1]), False]
        self._learn([w for k, part in enumerate(parts) for w in part[cut[k] : len(part) - cut[k + 1]]])
        self.joined += len(parts) > 1
        while len(parts) > 1:
            parts = [self.join_words(parts[k], parts[k + 1], WORD.fullmatch(text, cuts[k + 1] - 1, cuts[k + 1] + 1) is not None) for k in range(0, len(parts), 2)]
            cuts = cuts[::2]
        return parts[0]

    def join_words(self, left: list[str], right: list[str], within: bool) -> list[str]:
        """The words of two halves as those of the whole; within: the cut fell into a word. That word's ids are what is
        left of a window's when the words around it, which both sides have encoded, agree."""
        if not within:
            return left + right
        word, grown = left[-1] + right[0], 1
        while word not in self.ids:
            before, after = left[max(0, len(left) - 1 - grown) : -1], right[1 : 1 + grown]
            ids = self.tok.encode(" ".join([*before, word, *after]), add_special_tokens=False).ids if len(word) <= self.leaf else []
            known = [np.frombuffer(b"".join(self.ids.get(w, b"") for w in some), "<u4").tolist() for some in (before, after)]
            agree = ids[: len(known[0])] == known[0] and ids[len(ids) - len(known[1]) :] == known[1]
            if agree and all(w in self.ids for w in (*before, *after)) and len(word) <= self.leaf:
                self._keep(word, ids[len(known[0]) : len(ids) - len(known[1])])
            elif grown > max(len(left), len(right)) or len(word) > self.leaf:
                self._learn([word])
            grown *= 2
        return [*left[:-1], word, *right[1:]]

    def _keep(self, word: str, ids: list[int]) -> None:
        self.ids[word] = np.asarray(ids, "<u4").tobytes()
        if self.tok.decoder is None:
            self.decoded[word] = self.tok.decode(ids, skip_special_tokens=False)

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit numbers, and the text decoded from them.

        Without a decoder the library puts one space between any two tokens, so words decode alone."""
        words = self.words_of(text)
        self._learn(words)
        ids = b"".join(map(self.ids.__getitem__, words))
        if self.tok.decoder is None:
            return ids, " ".join(filter(None, map(self.decoded.__getitem__, words)))
        return ids, self.tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, tokens: bool = False) -> DataFrame:
    """n_tokens and the digests of ids and decoded text of each row; tokens: also the ids and the decoded text.

    The tokenizer file at path is read on the driver and sent along (its size is fixed)."""
    data = docs.sparkSession.sparkContext.broadcast(open(path or default_path(), encoding="utf-8").read())

    def run(batches):
        kept = sys.modules.setdefault("_quire_codecs", type(sys)("_quire_codecs")).__dict__
        key = hashlib.sha256(data.value.encode()).hexdigest()
        if key not in kept:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
            kept[key] = Codec(data=data.value)
        codec = kept[key]
        yield from coded(codec, batches)
        codec.forget()

    def coded(codec, batches):
        for batch in batches:
            for first in range(0, len(batch), 256):
                some = batch.slice(first, 256)
                found = [codec.encode(t or "") for t in some.column(1).to_pylist()]
                cols = [
                    some.column(0),
                    pa.array([len(x) // 4 for x, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x, _ in found]),
                    pa.array([hashlib.sha256(y.encode("utf-8", "replace")).hexdigest() for _, y in found]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if tokens:
                    cols += [pa.array([np.frombuffer(x, "<i4") for x, _ in found], pa.list_(pa.int32())), pa.array([y for _, y in found], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA + ", ids array<int>, decoded string" * tokens)
