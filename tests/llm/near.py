"""Near lines by brute force over all pairs."""

import re
from collections import Counter

from quire.llm import linededup


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def words(line):
    return re.findall(r"[^\x00-\x20⺀-\U0010ffff]+|[⺀-\U0010ffff]", line)


def pairs_near(lines, share=linededup.SHARE, t=linededup.THRESHOLD):
    """All pairs of lines; how often characters and words occur bounds the distance from below."""
    out = set()
    split = [words(x) for x in lines]
    letters, tokens = [Counter(x) for x in lines], [Counter(x) for x in split]
    for i, x in enumerate(lines):
        for j in range(i + 1, len(lines)):
            y, most = lines[j], max(len(split[i]), len(split[j])) // share
            alike = max(len(split[i]), len(split[j])) < linededup.WORDS_SUFFICE and abs(len(x) - len(y)) <= t and (letters[i] - letters[j]).total() <= t and distance(x, y) <= t
            if not alike and most and abs(len(split[i]) - len(split[j])) <= most and len(tokens[i].keys() - tokens[j].keys()) <= most:
                alike = distance(split[i], split[j]) <= most
            if alike:
                out.add(frozenset((x, y)))
    return out


def classes_of(lines):
    """The set of lines that near ones connect with each, of those that have any."""
    own = {}
    for x, y in map(tuple, pairs_near(lines)):
        both = own.get(x, {x}) | own.get(y, {y})
        own.update(dict.fromkeys(both, both))
    return {x: frozenset(c) for x, c in own.items()}
