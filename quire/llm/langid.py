"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

The text is cut into units (runs without white space, pieces of at most UNIT bytes of longer ones). One
network reads a unit's bytes forwards, one backwards; a softmax over both states labels every byte
position. A document's probabilities are the mean of those of all its positions; no text is cut off.
States begin anew with each unit, so a unit that occurs again in a task is not computed again.

Training: back-propagation through time with Adam on units of at most `most` labelled documents (whole
texts, chosen by a hash of their ids), drawn in proportion to their counts; what reaches the driver is the distinct
units with their counts. Rows of fold 1 (crc32 of the id mod 3) are never learned.

Defined cases: null texts and texts without a letter are `und` with score 0; without a labelled row (an empty table) all
are `und`. Very long texts are read whole, a long run without white space in pieces. Ties go to the language that sorts
first. Repeated rows are judged one by one. Extra columns are not looked at, whatever their names; keep_known() keeps
them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, fold, mapped

FOLDS, HELD = 3, 1
UNIT = 24
LETTER = re.compile(r"[^\W\d_]")
#: Units whose probabilities a task remembers.
REMEMBERED = 400_000


def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the units as rows of bytes, their lengths, and each piece's unit."""
    pieces, owner = [], []
    for k, unit in enumerate(units):
        raw = unit.encode("utf-8", "replace")
        for i in range(0, len(raw), UNIT):
            pieces.append(raw[i : i + UNIT])
            owner.append(k)
    rows = np.frombuffer(b"".join(p.ljust(UNIT, b"\0") for p in pieces), np.uint8).reshape(-1, UNIT)
    return rows, np.array([len(p) for p in pieces], np.int64), np.array(owner, np.int64)


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        n = len(langs)
        self.p = {"out": rng.normal(0, 0.2, (2 * hidden, n)), "bias": np.zeros(n)}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.3, (256, 3 * hidden)), f"u{d}": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"c{d}": np.zeros(3 * hidden)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, rows: np.ndarray, lengths: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(time, piece, hidden): the state after each byte; beyond a piece's end it stays."""
        h, w = self.h, int(lengths.max())
        x, u, c = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        s, out = np.zeros((len(rows), h), np.float32), np.zeros((w, len(rows), h), np.float32)
        for t in range(w) if d == "f" else range(w - 1, -1, -1):
            a, r = x[rows[:, t]] + c, s @ u
            z, g = sigmoid(a[:, :h] + r[:, :h]), sigmoid(a[:, h : 2 * h] + r[:, h : 2 * h])
            n = np.tanh(a[:, 2 * h :] + g * r[:, 2 * h :])
            on = (t < lengths)[:, None].astype(np.float32)
            if keep is not None:
                keep.append((t, s, z, g, n, r[:, 2 * h :], on))
            s = s + on * (1 - z) * (n - s)
            out[t] = s
        return out

    def label(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The sum of the position probabilities of each piece."""
        total = np.zeros((len(rows), len(self.langs)), np.float32)
        order = np.argsort(lengths, kind="stable")
        for i in range(0, len(order), 4096):
            on = order[i : i + 4096]
            r, n = rows[on], lengths[on]
            y = np.concatenate([self.states(r, n, "f"), self.states(r, n, "b")], 2) @ self.p["out"] + self.p["bias"]
            y = np.exp(y - y.max(2, keepdims=True))
            y /= y.sum(2, keepdims=True)
            y *= (np.arange(len(y))[:, None] < n)[:, :, None]
            total[on] = y.sum(0)
        return total

    def gradients(self, rows: np.ndarray, lengths: np.ndarray, lang: np.ndarray) -> dict[str, np.ndarray]:
        h, kept = self.h, {"f": [], "b": []}
        s = np.concatenate([self.states(rows, lengths, d, kept[d]) for d in "fb"], 2)
        y = s @ self.p["out"] + self.p["bias"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        y[:, np.arange(len(rows)), lang] -= 1
        y *= (np.arange(len(y))[:, None] < lengths)[:, :, None] / lengths.sum()
        g = {"out": np.tensordot(s, y, ((0, 1), (0, 1))), "bias": y.sum((0, 1))}
        ds = y @ self.p["out"].T
        for d, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
            gx, gu, gc = (np.zeros_like(self.p[f"{k}{d}"]) for k in "xuc")
            u, back = self.p[f"u{d}"], np.zeros((len(rows), h), np.float32)
            for t, before, z, r, n, un, on in reversed(kept[d]):
                dh = back + part[t]
                dn = dh * on * (1 - z) * (1 - n * n)
                dz = dh * on * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                dr_u = np.concatenate([dz, dr, dn * r], 1)
                hot = np.zeros((256, len(rows)), np.float32)
                hot[rows[:, t], np.arange(len(rows))] = 1
                gx += hot @ da
                gc += da.sum(0)
                gu += before.T @ dr_u
                back = dh * (1 - on * (1 - z)) + dr_u @ u.T
            g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return g


def fit(units: list[str], langs: list[str], counts: np.ndarray, drawn: int = 60_000, batch: int = 300, rate: float = 0.01, seed: int = 7) -> Network | None:
    names = sorted(set(langs))
    if not names:
        return None
    net, rng = Network(names, seed=seed), np.random.default_rng(seed)
    own = np.searchsorted(names, langs)
    if len(names) == 1:
        return net
    pick = rng.choice(len(units), drawn, p=counts / counts.sum())
    rows, lengths, owner = encode([units[i] for i in pick])
    lang = own[pick][owner]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    for turn in range(3):
        order = rng.permutation(len(rows))
        order = order[np.argsort(lengths[order], kind="stable")]  # pieces of a batch are about as long
        for i in rng.permutation(np.arange(0, len(order), batch)):
            on, t = order[i : i + batch], t + 1
            for k, g in net.gradients(rows[on], lengths[on], lang[on]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (rate / (1 + 2 * turn) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def _units(batches):
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for unit in text.split():
                seen[lang, unit] = seen.get((lang, unit), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "unit", "n"])


def train(docs: DataFrame, most: int = 1500) -> Network | None:
    """most: bound on the labelled documents learned from."""
    own = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null").filter(fold(F.col("doc_id"), FOLDS) != HELD)
    own = bounded_sample(own, F.col("doc_id"), most, "langid").select("lang", "text")
    units = mapped(own, _units, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")).toArrow()
    units = units.sort_by([("lang", "ascending"), ("unit", "ascending")])
    return fit(units["unit"].to_pylist(), units["lang"].to_pylist(), units["n"].to_numpy())


class Memory:
    """Position-probability sums of units, computed once while they are remembered."""

    def __init__(self, net: Network):
        self.net, self.place = net, {}
        self.sums = np.zeros((1024, len(net.langs) + 1), np.float32)

    def look_up(self, units: list[str]) -> np.ndarray:
        place = self.place
        new = [u for u in dict.fromkeys(units) if u not in place]
        if new:
            if len(place) + len(new) > REMEMBERED:
                place.clear()
                new = list(dict.fromkeys(units))
            rows, lengths, owner = encode(new)
            first = len(place)
            while len(self.sums) < first + len(new):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.sums[first : first + len(new)] = 0
            np.add.at(self.sums, first + owner, np.concatenate([self.net.label(rows, lengths), lengths[:, None]], 1))
            place.update(zip(new, range(first, first + len(new))))
        return self.sums[np.fromiter(map(place.__getitem__, units), np.int64, len(units))]


def identify(docs: DataFrame, net: Network | None, extra: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; extra: columns of docs to carry along, renamed quire_0, quire_1, ..."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    named = list(extra or [])

    def run(batches):
        memory = Memory(held.value) if held.value is not None else None
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(where)
            for first in range(0, len(texts), 64):
                some = texts.slice(first, 64).to_pylist()
                units = [t.split() if t and memory and LETTER.search(t) else [] for t in some]
                flat = [u for us in units for u in us]
                sums = np.zeros((len(flat) + 1, memory.sums.shape[1] if memory else 1))
                if flat:
                    np.cumsum(memory.look_up(flat), 0, out=sums[1:])
                at = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)
                for i, us in enumerate(units):
                    if us:
                        s = sums[at[i + 1]] - sums[at[i]]
                        p = s[:-1] / max(s[-1], 1)
                        k = int(p.argmax())
                        langs.append(memory.net.langs[k])
                        scores.append(float(min(1.0, max(0.0, p[k]))))
                    else:
                        langs.append("und")
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *(batch.column(3 + k) for k in range(len(named)))], ["doc_id", "held_out", "lang_pred", "score", *(f"quire_{k}" for k in range(len(named)))])

    # a text that is carried along anyway is sent once
    kinds, where = dict(docs.dtypes), 3 + named.index("text") if "text" in named else 1
    text = F.lit(None).cast("string").alias("text") if "text" in named else F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), *(F.col(f"`{c}`").alias(f"quire_{k}") for k, c in enumerate(named)))
    more = "".join(f", quire_{k} {kinds[c]}" for k, c in enumerate(named))
    return mapped(rows, run, f"doc_id long, held_out boolean, lang_pred string, score double{more}")


def keep_known(docs: DataFrame, net: Network | None, least: float = 0.3) -> DataFrame:
    """docs without the rows that are `und` or whose language has a pooled probability under `least`; all columns stay."""
    names = docs.columns
    found = identify(docs, net, names).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*(F.col(f"quire_{k}").alias(c) for k, c in enumerate(names)))
