"""Line dedup: exact repeats, and a segment-partition edit join for near repeats.

A line (`\\n`-split) with a letter or digit is dropped if an equal line stands earlier: earlier in its
document, or in an earlier document (smaller id; of equal or null ids, null ones last, smaller hash of the text).
Near lines make classes: a line is dropped if another line of its class first occurs earlier. Near are lines of at
least MIN_CHARS code points within THRESHOLD edits of characters (shorter ones: equal lines only), and lines within
one edit of words (inserted, removed or changed) for every SHARE words of the longer one; from WORDS_SUFFICE words on
words alone decide, of which an edit of a character is two at most. Words are runs of
characters above the space; from U+2E80 on (scripts written without spaces) each character is one. A class is
whatever near lines connect; its number of links is, for each line, the number of the other lines in it.

The edit join works on distinct lines, each cut into one segment more than the edits that are looked for: some
segment survives. By characters, segments are indexed under (line length, segment number, segment), and a line
probes, for each length up to THRESHOLD shorter than its own, only the substrings that a segment could have become
(the multi-match-aware window of positions). By words, bands of lengths take the place of lengths: a line looks up
its own band and is indexed in each that may look for it; of a segment, and of a substring, only the GRAM words
that hash lowest stand as its key, so that neighbouring substrings mostly share one.

Keys travel as packed arrays, one row for each task and bucket of keys. In a bucket, the lines that share a key are
each paired with one of them only (within a task already, where a key has many lines; apart, where parities of their
words rule it out that any chain of near lines connects them): rows grow with the lines, not with their pairs. Pairs are verified on the texts by banded bit-parallel edit distance and give the first
classes; where lines that share a key are left in different ones, all such pairs are met in units of work that hold the
lines' texts, a pair once for all its keys, and compared unless others have connected it meanwhile. Parities of
characters and words, of which every edit changes two at most, spare most texts a comparison. Texts of candidates are picked out at the scan by a
bitmap of fixed largest size (it may let others through, which a join then drops).

Defined cases: equal lines are told by 128 bits of a hash; lines without a letter or digit stay; a null text stays
null; an empty text stays empty; a document with text whose every lettered line is dropped has text of the rest
(clean() lets such a document go if only blanks are left); equal rows (same id and text) are one document; ties of
place are broken by id, text hash, position and line hash; very long lines and texts are taken whole, in arrays of
bounded size; an empty table gives no rows; extra columns of any name are carried along.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import vectext as V
from quire.llm.common import cut, mapped, stash
from quire.llm.components import components
from quire.llm.editdist import within

THRESHOLD, MIN_CHARS, SHARE = 2, 24, 10
#: Words whose lowest hash stands for a segment; words from which on lines are compared by words alone.
GRAM = 6
WORDS_SUFFICE = 2 * THRESHOLD * SHARE
LAST = (1 << 63) - 1
WORDY = re.compile(r"[^\W_]")
WIDE = 0x2E80
WORD = re.compile(r"[^\x00-\x20\u2e80-\U0010ffff]+|[\u2e80-\U0010ffff]")


def code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lines' characters one after the other, and where each line begins, and the end."""
    at = np.zeros(len(lines) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)), out=at[1:])
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), at


def digests(lines: list[str]) -> np.ndarray:
    """128 bits of a hash of each line, as two numbers."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x.encode("utf-8", "surrogatepass")) for x in lines]), "<u8").reshape(-1, 2)


def line_ids(lines: list[str], held: Lines | None = None, share: int = SHARE, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each line: 24 bits of a hash, the edits of words that it allows (31: as many or more) and 32
    parities of its words, which leave room for two bits more; then 64 bits of the hash. both: the lines' digests."""
    held, both = held or Lines(lines), digests(lines) if both is None else both
    edits = np.minimum(np.diff(held.first) // share, 31).astype(np.uint64)
    own = (both[:, 0] >> np.uint64(40)) << np.uint64(37) | edits << np.uint64(32) | held.word_parities()
    return own.view(np.int64), both[:, 1].view(np.int64)


def distinct_lines(text: str | None) -> list[tuple[int, str]]:
    """(position, line) of the first of each lettered line of a text."""
    seen: dict[str, int] = {}
    for k, line in enumerate((text or "").split("\n")):
        if line not in seen and WORDY.search(line):
            seen[line] = k
    return [(k, line) for line, k in seen.items()]


# plans: which parts of a line are indexed and looked up


def segments(n: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of a line of n characters; the longer ones last."""
    short, more = divmod(n, threshold + 1)
    out, at = [], 0
    for i in range(threshold + 1):
        size = short + (i > threshold - more)
        out.append((at, size))
        at += size
    return out


def probes(n: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(length, segment, start, size) of the substrings that a line of n characters looks up."""
    out = []
    for length in range(max(1, n - threshold), n + 1):
        gap = n - length
        for i, (start, size) in enumerate(segments(length, threshold)):
            low = max(0, start - i, start + gap - (threshold - i))
            high = min(n - size, start + i, start + gap + (threshold - i))
            out += [(length, i, p, size) for p in range(low, high + 1)]
    return out


def band_edges(share: int) -> np.ndarray:
    """Numbers of words at which bands begin, multiples of share; a line with fewer than the first has no edits of words."""
    out = [share]
    while out[-1] < 1 << 31:
        out.append(out[-1] + share * max(1, out[-1] // share // 5))
    return np.array(out, np.int64)


def word_band(b: int, edges: np.ndarray, share: int) -> tuple[int, int, int]:
    """The most edits in a band, the fewest words of a line near to one of its lines, and the size of a segment."""
    most, low = int(edges[b + 1] - 1) // share, int(edges[b] - edges[b] // share)
    return most, low, low // (most + 1)


#: Segments of a band are numbered in their keys up to so many edits.
NUMBERED = 8
#: Spans whose keys are made at once, and spans in plans that a worker remembers.
SPANS, PLANNED = 150_000, 200_000


def word_segments(n: int, share: int, edges: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(band, segment, start, size) under which a line of n words is indexed; segments go without number where they are many."""
    edges, out = band_edges(share) if edges is None else edges, []
    for b in range(max(0, int(np.searchsorted(edges, n, "right")) - 1), len(edges) - 1):
        most, low, size = word_band(b, edges, share)
        if n < low:
            break
        out += [(b, i if most <= NUMBERED else 0, i * size, size) for i in range(most + 1)]
    return out


def word_probes(n: int, share: int, edges: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(band, segment, start, size) that a line of n words looks up, to find all near lines with at most as many words."""
    edges = band_edges(share) if edges is None else edges
    b, own = int(np.searchsorted(edges, n, "right")) - 1, n // share
    if b < 0:
        return []
    most, low, size = word_band(b, edges, share)
    i = np.arange(own + 1)  # some segment is whole behind exactly i edits, which leaves own - i behind it
    first = np.maximum(0, i * size - np.minimum(i, own - i))
    last = np.minimum(n - size, i * size + np.minimum(i, n - low + own - i))
    if most <= NUMBERED:
        return [(b, int(k), p, size) for k in i for p in range(int(first[k]), int(last[k]) + 1)]
    step = np.zeros(n + 2, np.int64)
    on = first <= last
    np.add.at(step, first[on], 1)
    np.add.at(step, last[on] + 1, -1)
    return [(b, 0, p, size) for p in np.flatnonzero(np.cumsum(step)).tolist()]


def word_distance(a: list[str], b: list[str], most: int | None = None) -> int:
    """Edits of words, bit-parallel over all of a; with most, some number above it may stand for what is more."""
    # words that both begin or end with cost nothing
    first, size = 0, min(len(a), len(b))
    while first < size and a[first] == b[first]:
        first += 1
    end = 0
    while end < size - first and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[first : len(a) - end], b[first : len(b) - end]
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    # the edits of two beginnings of one length, less the difference of the lengths, are no more than those of the whole
    enough = len(a) + len(b) if most is None else most + abs(len(a) - len(b))
    vp, vn = full, 0
    for j, x in enumerate(b, 1):
        on = places.get(x, 0)
        d = (((on & vp) + vp) ^ vp) | on
        hp, hn = (vn | ~(d | vp)) & full, vp & d
        hp, hn, on = hp << 1 | 1, hn << 1, on | vn
        vp, vn = (hn | ~(on | hp)) & full, hp & on & full
        if not j % 8 and enough < j <= len(a):
            head = (1 << j) - 1
            if (so_far := j + (vp & head).bit_count() - (vn & head).bit_count()) > enough:
                return so_far - abs(len(a) - len(b))
    return len(b) + vp.bit_count() - vn.bit_count()


def words_of(line: str) -> list[str]:
    """WORD's matches; without its search where nothing but blanks parts words."""
    if line.isprintable():  # which no space but the plain one is
        if line.isascii():
            return line.split()
        try:
            line.encode("latin-1")
        except UnicodeEncodeError:
            return WORD.findall(line)
        return line.split()
    return WORD.findall(line)


def near_words(x: str, y: str, share: int) -> bool:
    return near_word_lists(words_of(x), words_of(y), share)


def near_word_lists(a: list[str], b: list[str], share: int) -> bool:
    most = max(len(a), len(b)) // share
    if not most or abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b) and sum(map(ne, a, b)) <= most:  # word for word, which is as many edits at least
        return True
    return len(set(a) - set(b)) <= most and not _more_apart(Counter(a), Counter(b), most) and word_distance(a, b, most) <= most


def _more_apart(a: dict[str, int], b: dict[str, int], most: int) -> bool:
    """Whether more than so many words, counted as often as they occur, are in one and not in the other: each is an edit."""
    for x, y in ((a, b), (b, a)):
        off = 0
        for word, n in x.items():
            if (more := n - y.get(word, 0)) > 0 and (off := off + more) > most:
                return True
    return False


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the values times powers of a base, and the inverse powers: hashes of any span follow from them."""
    up, down = V.powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


def _spans(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, down = sums
    return (total[end] - total[start]) * down[start]


class Lines:
    """A batch of lines as arrays: characters, hashes of words, and where each line's begin."""

    def __init__(self, lines: list[str]):
        self.points, self.at = code_points(lines)
        self.sums = _sums(self.points + np.uint64(1))
        gap, wide = self.points <= 0x20, self.points >= WIDE
        edge = np.zeros(len(self.points) + 1, bool)  # whether a word cannot go on across the place before a character
        edge[self.at] = True
        edge[1:-1] |= gap[1:] | gap[:-1] | wide[1:] | wide[:-1]
        starts, ends = np.flatnonzero(~gap & edge[:-1]), np.flatnonzero(~gap & edge[1:]) + 1
        self.words, self.first = V.mix(_spans(self.sums, starts, ends)), np.searchsorted(starts, self.at)

    def sketches(self) -> list[np.ndarray]:
        """Parities of how many of a line's characters lie in each of 64 classes, then of its words in 4 times 64. One edit
        changes at most two of either."""
        letters = _parities((self.points * np.uint32(2654435761)) >> np.uint32(26), self.at, np.uint64)
        # each word in one class of one of the four
        which, kind = self.words >> np.uint64(62), self.words >> np.uint64(56) & np.uint64(63)
        return [letters, *(_parities(kind, self.first, np.uint64, which == k) for k in range(4))]

    def word_parities(self) -> np.ndarray:
        return _parities(self.words >> np.uint64(59), self.first)


def _parities(kinds: np.ndarray, at: np.ndarray, form=np.uint32, of: np.ndarray | None = None) -> np.ndarray:
    bits = np.append(form(1) << kinds.astype(form), form(0))
    if of is not None:
        bits[:-1][~of] = 0
    return np.where(np.diff(at) > 0, np.bitwise_xor.reduceat(bits, at[:-1]), 0).astype(np.uint64)


class Keys:
    """The hashed keys of lines; plans of lengths are worked out once."""

    def __init__(self, threshold: int, share: int):
        self.threshold, self.share, self.edges = threshold, share, band_edges(share)
        self.plans: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
        self.held = 0

    def plan(self, kind: str, n: int) -> tuple[np.ndarray, ...]:
        """Of each span of a line of n: its tag, start, size, role (1 what is indexed, 0 what is looked up), whether it is
        indexed or another than those that are, and whether it is the first of its role. kind: chars or words."""
        if (kind, n) in self.plans:
            return self.plans[kind, n]
        if kind == "words":
            indexed, asked = word_segments(n, self.share, self.edges), word_probes(n, self.share, self.edges)
        else:
            indexed, asked = [(n, i, start, size) for i, (start, size) in enumerate(segments(n, self.threshold))], probes(n, self.threshold)
            asked = [r for r in asked if r not in indexed]
        known, rows = set(indexed), asked + indexed
        own = np.array(rows, np.int64).reshape(-1, 4)
        role, head = np.repeat([0, 1], [len(asked), len(indexed)]), np.zeros(len(rows), bool)
        head[[k for k in (0, len(asked)) if k < len(rows)]] = True
        other = np.array([r not in known for r in asked] + [True] * len(indexed), bool)
        found = V.mix((own[:, 0] << 5 | own[:, 1] << 1 | (kind == "words")).astype(np.uint64)), own[:, 2], own[:, 3], role, other, head
        if len(rows) * 100 <= PLANNED:  # those of long lines, which are few, are made anew
            if self.held > PLANNED:
                self.plans.clear()
                self.held = 0
            self.plans[kind, n] = found
            self.held += len(rows)
        return found

    def of(self, held: Lines) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, numbers of lines, roles), of all lengths at once."""
        n_words = np.diff(held.first)
        lowest: dict[int, np.ndarray] = {}
        for kind, at, lengths, lines_on in (("chars", held.at, np.diff(held.at), n_words < WORDS_SUFFICE), ("words", held.first, n_words, n_words >= self.share * 9 // 10)):
            which = np.flatnonzero(lines_on)
            if not len(which):
                continue
            known, form = np.unique(lengths[which], return_inverse=True)
            plans = [self.plan(kind, n) for n in known.tolist()]
            per = np.array([len(p[0]) for p in plans])
            tag, start, size, role, other, head = map(np.concatenate, zip(*plans, strict=True))
            first, count = (np.cumsum(per) - per)[form], per[form]
            total = np.cumsum(count)
            low = 0
            while low < len(which):  # bounded, however many the lines are; a long one stands alone
                high = max(low + 1, int(np.searchsorted(total, total[low] - count[low] + SPANS, "right")))
                some = count[low:high]
                line, row = np.repeat(which[low:high], some), np.arange(some.sum()) + np.repeat(first[low:high] - np.cumsum(some) + some, some)
                begin = at[line] + start[row]
                if kind == "chars":
                    yield V.mix(_spans(held.sums, begin, begin + size[row]) + tag[row]), line, role[row]
                else:
                    key, tags = self.lowest(held, lowest, begin, size[row]), tag[row]
                    fresh = head[row]
                    fresh[1:] |= (key[1:] != key[:-1]) | (tags[1:] != tags[:-1])
                    fresh &= other[row]
                    yield V.mix(key[fresh] + tags[fresh]), line[fresh], role[row[fresh]]
                low = high

    @staticmethod
    def lowest(held: Lines, known: dict[int, np.ndarray], begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The lowest hash of GRAM words in each span of words. known: by size, of the spans at each word."""
        out = np.empty(len(begin), np.uint64)
        for own in np.flatnonzero(np.bincount(size)).tolist():
            if own not in known:
                wide = min(GRAM, own)
                if -wide not in known:  # the hashes themselves
                    first = np.arange(max(0, len(held.words) - wide + 1))
                    known[-wide] = V.mix(_spans(_sums(held.words), first, first + wide))
                grams = known[-wide]
                best = grams[: len(grams) - (own - wide)].copy()
                for k in range(1, own - wide + 1):
                    np.minimum(best, grams[k : k + len(best)], out=best)
                known[own] = best
            on = size == own
            out[on] = known[own][begin[on]]
        return out


@functools.cache
def keys_of(threshold: int, share: int) -> Keys:
    """Their plans stay for a worker's next task."""
    return Keys(threshold, share)


# keys in packed rows

#: Bits of a key within its bucket, keys that a task holds, and lines of a key beyond which a task pairs them itself.
KEY_BITS, HELD_KEYS, MANY = 40, 300_000, 16
#: Lines of a key up to which all their pairs' parities are compared; more are one group, of which the texts decide.
ALL_PAIRS = 256
PACKED = "bucket int, keys binary, hs binary"


def _long_lines(batches, chars: int = 600_000, once: int = 200_000) -> Iterator[list[str]]:
    """Lines that take part in the edit join; what a task has seen lately is left out."""
    seen: set[int] = set()
    held, size = [], 0
    for batch in batches:
        for first in range(0, len(batch), 256):
            for text in batch.column(1).slice(first, 256).to_pylist():
                for line in text.split("\n") if text else ():
                    if len(line) >= MIN_CHARS and (known := hash(line)) not in seen:
                        if len(seen) >= once:
                            seen.clear()
                        seen.add(known)
                        if WORDY.search(line):
                            held.append(line)
                            size += len(line)
                if size > chars:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)]]).astype(np.int64)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def pack(key: np.ndarray, hr: np.ndarray, bits: int) -> pa.RecordBatch:
    """Keys and lines (hash, a bit for those that stand for many, a bit for the role) as one row a bucket; under
    -1 - bucket stand pairs of lines whose key many lines here have: all with one of them, which alone goes on."""
    key = key >> np.uint64(64 - bits - KEY_BITS)
    order = np.argsort(key)
    key, hr = key[order], hr[order]
    at = _runs(key)
    pairs, keep = [], np.ones(len(key), bool)
    for i in np.flatnonzero(np.diff(at) > MANY).tolist():
        own = hr[at[i] : at[i + 1]]
        lines, roles = np.unique(own >> 2), own & 1
        if len(lines) > MANY:
            least = (own[roles == 1] >> 2).min() if roles.any() else lines[0]
            rest = lines[lines != least]
            pairs.append(np.stack([np.full(len(rest), key[at[i]], np.int64), rest, np.full(len(rest), least)], 1))
            keep[at[i] + 1 : at[i + 1]] = False
            hr[at[i]] = least << 2 | 2 | int(roles.any())
    key, hr = key[keep], hr[keep]
    bucket = (key >> np.uint64(KEY_BITS)).astype(np.int32)
    ends = _runs(bucket) if len(bucket) else np.zeros(1, np.int64)
    low = np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BITS // 8 :])
    rows = [pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]]), _binary(low, ends * (KEY_BITS // 8)), _binary(hr, ends * 8)], ["bucket", "keys", "hs"])]
    if pairs:
        met = np.concatenate(pairs)
        cuts = np.arange(0, len(met) + 4096, 4096).clip(max=len(met))
        rows.append(pa.RecordBatch.from_arrays([pa.array((-1 - met[cuts[:-1], 0] % (1 << bits)).astype(np.int32)), _binary(np.ascontiguousarray(met[:, 0]), cuts * 8), _binary(np.ascontiguousarray(met[:, 1:]), cuts * 16)], ["bucket", "keys", "hs"]))
    return pa.concat_batches(rows)


def _packed(threshold: int, share: int, bits: int):
    """A function from documents to packed keys."""

    def run(batches):
        maker, keys, lines, size = keys_of(threshold, share), [], [], 0
        for held in _long_lines(batches):
            own = Lines(held)
            h, _ = line_ids(held, own, share)
            for key, on, role in maker.of(own):
                keys.append(key)
                lines.append(h[on] << 2 | role)
                size += len(key)
                if size >= HELD_KEYS:
                    yield pack(np.concatenate(keys), np.concatenate(lines), bits)
                    keys, lines, size = [], [], 0
        if size:
            yield pack(np.concatenate(keys), np.concatenate(lines), bits)

    return run


def _star(bucket: int, keys: list[bytes], lines: list[bytes], threshold: int = THRESHOLD) -> pa.RecordBatch:
    """Each line that shares a key with others, and the least of these; a key below 0 has two lines in all."""
    low = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BITS // 8)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, 8 - KEY_BITS // 8 :] = low
    key, hr = full.view(">u8").ravel().astype(np.int64), np.frombuffer(b"".join(lines), np.int64)
    order = np.argsort(key)
    key, hr = key[order], hr[order]
    again = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    again[1:] |= same
    again[:-1] |= same
    key, hr = key[again], hr[again]
    order = np.lexsort((hr, key))
    key, hr = key[order], hr[order]
    # a line that comes several times under a key comes once, with all its bits
    line, at = hr >> 2, _runs(key) if len(key) else np.zeros(1, np.int64)
    if not len(key):
        return _pairs(key, line, line)
    index = np.repeat(np.bitwise_or.reduceat(hr & 1, at[:-1]) == 1, np.diff(at))
    many = np.repeat(np.bitwise_or.reduceat(hr & 2, at[:-1]) == 2, np.diff(at))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    new &= index
    key, line, many = key[new], line[new], many[new]
    group = np.repeat(line, 1)
    at = _runs(key) if len(key) else np.zeros(1, np.int64)
    size, first = np.diff(at), at[:-1]
    for n in np.unique(size).tolist():
        on = first[size == n]
        for some in np.split(on, range(0, len(on), max(1, 400_000 // (n * n)))[1:]):
            rows = some[:, None] + np.arange(n)
            group[rows] = line[some][:, None] if n > ALL_PAIRS else _alike(line[rows], many[some], threshold)
    on = line != group
    key = key[on] | bucket << KEY_BITS
    own = (V.mix(key.astype(np.uint64)) ^ group[on].astype(np.uint64)).view(np.int64) & LAST  # a key's groups are apart
    _, which, times = np.unique(own, return_inverse=True, return_counts=True)
    own = np.where(times[which] == 1, ~own, own)
    return _pairs(np.where(many[on], key, own), line[on], group[on])


def _alike(lines: np.ndarray, all_of: np.ndarray, threshold: int) -> np.ndarray:
    """For each row of lines that share a key: the first line that each is connected with by pairs whose parities of words
    let them be near (all with the first, where all_of says so)."""
    bits, edits = lines & 0xFFFFFFFF, lines >> 32 & 31
    most = np.maximum(edits[:, :, None], edits[:, None, :])
    # an edit of characters is three of words at most, beside a wide character
    most = np.maximum(most, 3 * threshold)
    near = (np.bitwise_count(bits[:, :, None] ^ bits[:, None, :]) <= 2 * most) | (most == 31) | all_of[:, None, None]
    n = lines.shape[1]
    label = np.broadcast_to(np.arange(n), lines.shape)
    while True:
        least = np.where(near, label[:, None, :], n).min(2)
        if (least == label).all():
            return np.take_along_axis(lines, label, 1)
        label = least


def _pairs(key: np.ndarray, h: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(h), pa.array(r)], ["key", "h", "r"])


def _stars(threshold: int):
    """A function from packed rows in order of their bucket to pairs of lines (key, h, r)."""

    def run(batches):
        held, keys, lines = None, [], []
        for batch in batches:
            for bucket, k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket < 0:
                    both = np.frombuffer(h, np.int64).reshape(-1, 2)
                    yield _pairs(np.frombuffer(k, np.int64), both[:, 0].copy(), both[:, 1].copy())
                    continue
                if bucket != held and keys:
                    yield _star(held, keys, lines, threshold)
                    keys, lines = [], []
                held = bucket
                keys.append(k)
                lines.append(h)
        if keys:
            yield _star(held, keys, lines, threshold)

    return run


# texts of candidates

#: What tells most lines apart without their texts: numbers of characters and words, and sketches of both.
SHAPE = ["chars", "words", "s0", "s1", "s2", "s3", "s4"]
#: Bits of the bitmap for each wanted line, and at most.
BITS_PER_LINE, MOST_BITS = 16, 27


def bitmap(wanted: DataFrame) -> np.ndarray:
    """One bit for each value of the first bits of a wanted h; at most 2**MOST_BITS bits, made by sums over tasks."""
    bits = int(min(MOST_BITS, max(12, np.ceil(np.log2(BITS_PER_LINE * max(1, wanted.count()))))))
    slot = F.call_function("shiftright", F.col("h"), F.lit(61 - bits))
    word = F.call_function("shiftright", slot, F.lit(6)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    found = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _let_through(filled: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether the bitmap has a bit for an h that begins with the same 24 bits of the hash; e: digests' first halves."""
    bits = int(np.log2(len(filled) * 64))
    more = max(0, bits - 24)
    slot = e >> np.uint64(64 - bits + more) << np.uint64(more)
    return filled[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64((1 << (1 << more)) - 1) != 0


def _texts(held, share: int):
    """(h, g, e, the shape, line) of the lines that the bitmap lets through; e, g: the digest."""

    def run(batches):
        filled = held.value
        for lines in _long_lines(batches):
            both = digests(lines)
            on = np.flatnonzero(_let_through(filled, both[:, 0]))
            if len(on):
                some, both = [lines[k] for k in on.tolist()], both[on]
                own = Lines(some)
                h, g = line_ids(some, own, share, both)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(both[:, 0].view(np.int64)), pa.array(np.diff(own.at)), pa.array(np.diff(own.first)), *(pa.array(x.view(np.int64)) for x in own.sketches()), pa.array(some, pa.string())], ["h", "g", "e", *SHAPE, "line"])

    return run


def _verify(threshold: int, share: int):
    def run(batches):
        for batch in (whole.slice(k, 4096) for whole in batches for k in range(0, len(whole), 4096)):
            if len(batch):
                x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                words = {t: words_of(t) for t in {*x, *y}}  # a line is in many pairs
                ok = np.array([near_word_lists(words[a], words[b], share) for a, b in zip(x, y, strict=True)], bool)
                few = [k for k in np.flatnonzero(~ok).tolist() if abs(len(x[k]) - len(y[k])) <= threshold and all(len(words[t]) < WORDS_SUFFICE for t in (x[k], y[k]))]
                ok[few] = within([x[k] for k in few], [y[k] for k in few], threshold)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

    return run


def _hashed(df: DataFrame) -> DataFrame:
    """df as the side of a join that is looked up, part by part, so that the other is not sorted: few rows of it have one key."""
    return df.hint("shuffle_hash")


def _checked(pairs: DataFrame, lines: DataFrame, threshold: int, share: int) -> DataFrame:
    """The pairs (a, b; ids of lines) whose texts are near."""
    side = lambda k, t: _hashed(lines.select(F.col("id").alias(k), F.col("line").alias(t)))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return cut(mapped(both, _verify(threshold, share), "a long, b long"))


def _alike_shapes(threshold: int, share: int, x: str = "", y: str = "r_") -> Column:
    """Whether lengths and sketches of two lines (columns of SHAPE under either prefix) let them be near."""
    apart = lambda k: F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}")))
    off = lambda c: F.abs(F.col(f"{x}{c}") - F.col(f"{y}{c}"))
    longer = F.greatest(f"{x}words", f"{y}words")
    letters = (longer < WORDS_SUFFICE) & (off("chars") <= threshold) & (apart(0) <= 2 * threshold)
    most = F.floor(longer / share)
    return letters | ((off("words") <= most) & (apart(1) + apart(2) + apart(3) + apart(4) <= 2 * most))


def _named(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in names))


#: A class's members times this, and its label: one number, as structs would be sorted to be added up.
RANK = Decimal(10**19)


def _rank(members: str, label: str) -> Column:
    return (F.col(members).cast("decimal(18,0)") * F.lit(RANK) + F.col(label)).cast("decimal(38,0)")


def _label_of(rank: Column) -> Column:
    return (rank % F.lit(RANK)).cast("long")


def _open_groups(met: DataFrame) -> DataFrame:
    """(key, main, id, label): members of groups of lines that share a key and are of different classes so far.

    met: (key, id, label, rank of the class by its size, and the same of the line that they were paired with under r_ names)."""
    names = ["id", "label"]
    # a group may have been paired in parts: whoever is not of its largest class is compared with others
    main = met.groupBy("key").agg(F.count("*").alias("n"), _label_of(F.max(F.greatest("rank", "r_rank"))).alias("main"), F.bool_or(F.col("label") != F.col("r_label")).alias("a"), (F.min("r_label") != F.max("r_label")).alias("b"))
    main = main.filter("n > 1 and (a or b)").select("key", "main")
    ends = F.array(F.struct(*names), F.struct(*(F.col(f"r_{c}").alias(c) for c in names)))
    return met.join(_hashed(main), "key").select("key", "main", F.inline(ends)).distinct()


#: Lines of a main class's groups that are not of it, and lines in all, that one unit of work holds.
MOST_LATE, MOST_MEMBERS, UNIT_ROWS = 2_000, 20_000, 20_000
#: Pairs of lines that are compared by characters together.
TOGETHER = 256


class _Classes:
    """Union-find over a unit's lines, from the classes that they have."""

    def __init__(self, label: np.ndarray):
        known, self.of = np.unique(label, return_inverse=True)  # of: each line's class
        self.up = np.arange(len(known))

    def root(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = c = self.up[self.up[c]]
        return int(c)

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(self.of[x]), self.root(self.of[y])
        self.up[max(a, b)] = min(a, b)
        return a != b

    def apart(self, x: int, y: int) -> bool:
        return self.root(self.of[x]) != self.root(self.of[y])

    def roots(self, lines: np.ndarray) -> np.ndarray:
        own = self.up[self.of[lines]]
        while ((up := self.up[own]) != own).any():
            own = up
        return own


def _settle(key: np.ndarray, who: np.ndarray, mine: np.ndarray, other: np.ndarray, label: np.ndarray, shape: np.ndarray, lines: list[str], threshold: int, share: int) -> list[tuple[int, int]]:
    """Pairs of lines whose texts are near and that join classes: all that the members' pairs connect, each class once.

    key, who, mine, other: a row for each member of a group: its place among the lines, whether it is compared with
    others, and whether others are with it. label, shape, lines: of each line."""
    classes, words, out, few = _Classes(label), {}, [], []
    done: set[bytes] = set()
    tested: set[int] = set()
    order = np.lexsort((who, key))
    who, mine, other, cuts = who[order], mine[order], other[order], _runs(key[order])

    def near_by_words(x: int, y: int, most: int) -> bool:
        for k in (x, y):
            if k not in words:
                own = words_of(lines[k])
                words[k] = own, Counter(own)
        (a, of_a), (b, of_b) = words[x], words[y]
        return not _more_apart(of_a, of_b, most) and word_distance(a, b, most) <= most

    def by_letters() -> None:
        open_ = [(x, y) for x, y in few if classes.apart(x, y)]
        few.clear()
        near = within([lines[x] for x, _ in open_], [lines[y] for _, y in open_], threshold) if open_ else ()
        out.extend((x, y) for (x, y), ok in zip(open_, near) if ok and classes.join(x, y))

    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        on = slice(first, end)
        late, rest = who[on][mine[on]], who[on][other[on]]
        form = late.tobytes() + b"|" + rest.tobytes()
        if not len(late) or form in done:  # keys beside each other mostly have the same lines
            continue
        done.add(form)
        root_of = classes.roots(rest)
        step = max(1, 200_000 // max(1, len(rest)))
        for some in (late[k : k + step] for k in range(0, len(late), step)):
            open_ = classes.roots(some)[:, None] != root_of
            if not open_.any():
                continue
            n_chars, n_words, sketch = (shape[some, 0], shape[some, 1], shape[some, 2:].view(np.uint64))
            apart = lambda k: np.bitwise_count(sketch[:, None, k] ^ shape[rest, 2 + k].view(np.uint64)).astype(np.int64)
            longer = np.maximum(n_words[:, None], shape[rest, 1])
            letters = open_ & (longer < WORDS_SUFFICE) & (np.abs(n_chars[:, None] - shape[rest, 0]) <= threshold) & (apart(0) <= 2 * threshold)
            most = longer // share
            by_words = open_ & (np.abs(n_words[:, None] - shape[rest, 1]) <= most)
            if by_words.any():
                by_words &= sum(apart(k) for k in (1, 2, 3, 4)) <= 2 * most
            rows = np.flatnonzero(letters | by_words)
            i, j = np.divmod(rows, len(rest))
            both = np.sort(np.stack([some[i], rest[j]]), 0)
            code = both[0] * len(lines) + both[1]
            if len(rows) > 1:  # a pair may stand either way round
                new = np.sort(np.unique(code, return_index=True)[1])
                rows, both, code = rows[new], both[:, new], code[new]
            for row, x, y, pair in zip(rows.tolist(), *both.tolist(), code.tolist()):
                if pair in tested or not classes.apart(x, y):
                    continue
                tested.add(pair)
                if by_words.flat[row] and near_by_words(x, y, int(most.flat[row])):
                    classes.join(x, y)
                    out.append((x, y))
                elif letters.flat[row]:
                    few.append((x, y))
            if len(few) >= TOGETHER:
                by_letters()
    by_letters()
    return out


def _settled(groups: DataFrame, lines: DataFrame, threshold: int, share: int) -> DataFrame:
    """(a, b): labels of classes that near lines of a group join; every pair of lines of a group that may be near and is not
    connected otherwise has its texts compared.

    Groups with one main class mostly have the same lines, and go to one unit of work, or, where they are large, are dealt to
    units by squares of their pairs: a pair of lines is met once there, however many keys it shares."""
    spark = groups.sparkSession
    late = F.col("label") != F.col("main")
    sizes = groups.select("main", "id", "label").distinct().groupBy("main").agg(F.count(F.when(late, 1)).alias("n_late"), F.count("*").alias("n"))
    sizes = sizes.select("main", F.ceil(F.col("n_late") / MOST_LATE).cast("int").alias("across"), F.ceil(F.col("n") / MOST_MEMBERS).cast("int").alias("down"))
    cells = groups.join(_hashed(sizes), "main").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("across") * F.col("down") - 1)))
    cells = cells.withColumn("mine", late & (F.col("id") % F.col("across") == F.floor(F.col("cell") / F.col("down")))).withColumn("other", F.col("id") % F.col("down") == F.col("cell") % F.col("down"))
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups.count() // UNIT_ROWS)
    cells = cells.filter("mine or other").withColumn("unit", F.pmod(F.xxhash64("main", "cell"), F.lit(units)).cast("int"))
    members = cells.select(F.col("unit").alias("place"), F.col("id").alias("own"), F.col("label").alias("own_label")).distinct()
    members = _hashed(members).join(lines.select(F.col("id").alias("own"), *(F.col(c).alias(f"own_{c}") for c in SHAPE), "line"), "own")

    def run(unit, table: pa.Table, members: pa.Table) -> pa.Table:
        ids = members["own"].to_numpy()
        order = np.argsort(ids)
        who = order[np.searchsorted(ids, table["id"].to_numpy(), sorter=order)]
        label = members["own_label"].to_numpy()
        shape = np.stack([members[f"own_{c}"].to_numpy() for c in SHAPE], 1)
        mine, other = (table[c].to_numpy() for c in ("mine", "other"))
        found = _settle(table["key"].to_numpy(), who, mine, other, label, shape, members["line"].to_pylist(), threshold, share)
        both = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(label[both[:, 0]]), "b": pa.array(label[both[:, 1]])})

    found = cells.select("unit", "key", "id", "mine", "other").groupBy("unit").cogroup(members.groupBy("place"))
    return cut(found.applyInArrow(run, "a long, b long"))


def near_classes(rows: DataFrame, n_lines: int = 0, threshold: int = THRESHOLD, share: int = SHARE) -> DataFrame:
    """(h, g, e, label, members): the lines that have near ones, their class and how many lines it has; e, g: the digest.

    rows: d, text; n_lines: about how many lines they have, from which the number of buckets follows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_lines // 50_000)
    bits = int(np.ceil(np.log2(4 * parts)))
    keys = mapped(rows, _packed(threshold, share, bits), PACKED)
    edges = stash(mapped(keys.repartition(parts, "bucket").sortWithinPartitions("bucket"), _stars(threshold), "key long, h long, r long"), "line-pairs")
    wanted = cut(edges.select(F.explode(F.array("h", "r")).alias("h")).distinct())
    held = spark.sparkContext.broadcast(bitmap(wanted))
    texts = mapped(rows, _texts(held, share), "h long, g long, e long, " + "".join(f"{c} long, " for c in SHAPE) + "line string").join(_hashed(wanted), "h", "left_semi")
    lines = texts.groupBy("h", "g", "e").agg(*(F.min(c).alias(c) for c in (*SHAPE, "line")))
    lines = stash(lines.withColumn("id", F.monotonically_increasing_id()), "line-texts")
    # lines with one h, should there be any, are all compared
    place = lines.select("h", "id", *SHAPE)
    both = edges.select("h", "r").distinct().join(_hashed(place), "h").join(_hashed(_named(place.withColumnRenamed("h", "r"), "r_", "r", "id", *SHAPE).withColumnRenamed("r_r", "r")), "r")
    tested = cut(both.filter(_alike_shapes(threshold, share)).select(F.least("id", "r_id").alias("a"), F.greatest("id", "r_id").alias("b")).distinct())
    links = _checked(tested, lines, threshold, share)

    first = cut(components(links))
    known = lines.select("h", "g", "e", "id").join(_hashed(first.withColumnRenamed("node", "id")), "id", "left")
    known = known.withColumn("label", F.coalesce("least", "id")).drop("least")
    known = stash(known.join(_hashed(known.groupBy("label").agg(F.count("*").alias("members"))), "label"), "line-classes")
    side = known.select("h", "id", "label", _rank("members", "label").alias("rank"))
    # two lines alone have been compared, unless more lines have their h
    met = edges.filter("key >= 0") if lines.count() == wanted.count() else edges
    met = met.join(_hashed(side), "h").join(_hashed(_named(side.withColumnRenamed("h", "r"), "r_", "r", "id", "label", "rank").withColumnRenamed("r_r", "r")), "r")
    groups = cut(_open_groups(stash(met.drop("h", "r"), "line-met")))
    joined = components(_settled(groups, lines, threshold, share))
    found = known.select("h", "g", "e", "label").join(_hashed(joined.withColumnRenamed("node", "label")), "label", "left").select("h", "g", "e", F.coalesce("least", "label").alias("label"))
    return found.join(_hashed(found.groupBy("label").agg(F.count("*").alias("members")).filter("members > 1")), "label").select("h", "g", "e", "label", "members")


# documents


def _occurrences(batches):
    for batch in batches:
        for first in range(0, len(batch), 512):
            some = batch.slice(first, 512)
            found = [distinct_lines(t) for t in some.column(1).to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            at = pa.array([k for x in found for k, _ in x], pa.int32())
            both = digests([line for x in found for _, line in x]).view(np.int64)
            yield pa.RecordBatch.from_arrays([some.column(0).take(owner), some.column(2).take(owner), at, *(pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1))], ["d", "w", "at", "e", "g"])


def owned(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), "text", F.xxhash64("text").alias("w"))


def fates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(d, w, ats, exact, near, n_links) for each document that loses a line or has a near line: positions dropped, and counts."""
    rows = owned(docs)
    seen = stash(mapped(rows, _occurrences, "d long, w long, at int, e long, g long"), "lines")
    near = near_classes(rows, seen.count(), threshold).drop("h")
    # most lines occur once and have no near ones: they are done before anything is sorted
    again = stash(seen.groupBy("e", "g").agg(F.count("*").alias("k")).join(_hashed(near), ["e", "g"], "left").filter("k > 1 or label is not null").drop("k"), "line-again")
    seen = stash(seen.join(_hashed(again.select("e", "g")), ["e", "g"]), "line-places")
    firsts = stash(seen.groupBy("e", "g").agg(F.min(F.struct("d", "w", "at")).alias("f")).join(_hashed(again), ["e", "g"]), "line-firsts")
    best = firsts.filter("label is not null").groupBy("label").agg(F.min(F.struct("f", "e", "g")).alias("best"))
    flags = firsts.join(_hashed(best), "label", "left").select("e", "g", F.col("f.d").alias("d0"), F.col("f.w").alias("w0"), F.coalesce(F.struct("f", "e", "g") != F.col("best"), F.lit(False)).alias("near"), F.coalesce(F.col("members") - 1, F.lit(0)).alias("links"))
    hit = seen.join(_hashed(flags), ["e", "g"]).select("d", "w", "at", (F.struct("d", "w") > F.struct(F.col("d0").alias("d"), F.col("w0").alias("w"))).alias("exact"), "near", "links")
    hit = hit.filter("exact or near or links > 0").distinct()
    return hit.groupBy("d", "w").agg(
        F.collect_set(F.when(F.col("exact") | F.col("near"), F.col("at"))).alias("ats"), F.sum(F.col("exact").cast("long")).alias("exact"),
        F.sum((F.col("near") & ~F.col("exact")).cast("long")).alias("near"), F.sum("links").alias("n_links"),
    )


def rewrite(text: str | None, drop) -> tuple[str | None, int, int, int]:
    """The text without the lines at `drop` and without repeats within itself; lines, lines repeated within, lines left."""
    if text is None:
        return None, 0, 0, 0
    lines, gone, seen, kept, own = text.split("\n"), set(drop if drop is not None else ()), set(), [], 0
    for k, line in enumerate(lines):
        if WORDY.search(line):
            if line in seen:
                own += 1
                continue
            seen.add(line)
            if k in gone:
                continue
        kept.append(line)
    return "\n".join(kept), len(lines), own, len(kept)


def _few(found: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """The fates with a broadcast hint if their summed size is small."""
    size = found.agg(F.sum(40 + 4 * F.size("ats"))).first()[0] or 0
    return F.broadcast(found) if size <= most_bytes else found


def _with_fates(docs: DataFrame, threshold: int) -> tuple[DataFrame, list[str]]:
    names = docs.columns
    held = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(docs["text"]).alias("w"), docs["text"].alias("quire_text"), *(docs[f"`{c}`"].alias(f"quire_{k}") for k, c in enumerate(names)))
    return held.join(_few(stash(fates(docs, threshold), "line-fates")), ["d", "w"], "left"), names


def report(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_lines, n_exact (repeats of lines elsewhere or within), n_near (other lines dropped), n_links (other
    lines in the classes of its lines), n_kept, kept_sha256."""
    rows = docs.select("doc_id", "text")
    joined, _ = _with_fates(rows, threshold)

    def run(batches):
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, len(whole), 1024)):
            out = [rewrite(t, a) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            exact = np.array([x[2] for x in out], np.int64) + batch.column(3).to_numpy(zero_copy_only=False)
            sha = [None if x[0] is None else hashlib.sha256(x[0].encode("utf-8", "surrogatepass")).hexdigest() for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in out], pa.int64()), pa.array(exact), batch.column(4), batch.column(5), pa.array([x[3] for x in out], pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_lines", "n_exact", "n_near", "n_links", "n_kept", "kept_sha256"],
            )

    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    own = joined.select(F.col("quire_0").cast("long").alias("doc_id"), "quire_text", "ats", zero("exact"), zero("near"), zero("n_links"))
    return mapped(own, run, "doc_id long, n_lines long, n_exact long, n_near long, n_links long, n_kept long, kept_sha256 string")


def clean(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with the lines dropped; a document that loses all its text goes, all columns stay."""
    joined, names = _with_fates(docs, threshold)
    kinds = dict(docs.dtypes)
    where = names.index("text")

    def run(batches):
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, len(whole), 1024)):
            texts = batch.column(where).to_pylist()
            new = [rewrite(t, a)[0] for t, a in zip(texts, batch.column(len(names)).to_pylist(), strict=True)]
            cols = [pa.array(new, pa.string()) if k == where else batch.column(k) for k in range(len(names))]
            keep = pa.array([n is None or bool(n.strip()) or not t.strip() for t, n in zip(texts, new, strict=True)])
            yield pa.RecordBatch.from_arrays(cols, [f"quire_{k}" for k in range(len(names))]).filter(keep)

    out = mapped(joined.select(*(f"quire_{k}" for k in range(len(names))), "ats"), run, ", ".join(f"quire_{k} {kinds[c]}" for k, c in enumerate(names)))
    return out.select(*(F.col(f"quire_{k}").alias(c) for k, c in enumerate(names)))
