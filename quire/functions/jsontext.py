"""Text out of JSON of any shape: by a key path, by well-known keys, or from recognizer output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that hold a text, and keys that hold a line of recognizer output, in order of preference.
TEXT_KEYS = ("full_text", "full_page_text", "text", "markdown", "md", "content", "prediction", "output", "transcription", "ocr_text", "result", "document")
LINE_KEYS = ("rec_text", "text", "transcription", "content", "txt")
#: Labels of layout items whose text belongs to the page.
TEXT_LABELS = ("text", "section_header", "page_footer", "caption", "list_item", "formula")
DEEPEST = 24


def at_path(c: Column, path: str) -> Column:
    """The value at a dotted path ("pages.0.body") of a JSON string, as text; null where there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".") if p)
    return F.get_json_object(c, "$" + steps)


def filled(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


def lines_in(items: list) -> Iterator[str]:
    """The first filled line key of each object of a list, stripped; other items have none."""
    for item in items:
        if isinstance(item, dict):
            yield from [item[k].strip() for k in LINE_KEYS if filled(item.get(k))][:1]


def guess(value) -> str | None:
    """A text by well-known keys, in their order and depth first; lists count as lines, or as their only item."""
    if isinstance(value, list):
        lines = list(lines_in(value))
        return "\n".join(lines) if lines else guess(value[0]) if len(value) == 1 else None
    if isinstance(value, dict):
        tried = (value[k] if filled(value[k]) else guess(value[k]) for k in TEXT_KEYS if isinstance(value.get(k), (str, list, dict)))
        return next(filter(None, tried), None)
    return value if filled(value) else None


def walk(value, depth: int = 0) -> Iterator[tuple[str, object]]:
    """(key, value) of every member, parents first."""
    if depth <= DEEPEST:
        for k, v in value.items() if isinstance(value, dict) else (("", v) for v in value) if isinstance(value, list) else ():
            yield k, v
            yield from walk(v, depth + 1)


def recognized(value) -> list[str]:
    """The first list of strings under rec_texts that is not empty."""
    found = (v for k, v in walk(value) if k == "rec_texts" and isinstance(v, list) and v and all(isinstance(x, str) for x in v))
    return next(found, [])


def is_boxes(value) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], list) and len(value[0]) == 4


def lines_and_boxes(raw: str) -> tuple[list[str], list[list[float]]]:
    """The recognizer lines of a JSON text and their boxes, wherever they stand; of a large text only the end is searched."""
    if len(raw) <= LARGE:
        root = json.loads(raw)
        texts, boxes = recognized(root), next((v for k, v in walk(root) if k == "rec_boxes" and is_boxes(v)), None)
        if not texts or boxes is None:
            raise ValueError("no rec_texts and rec_boxes found")
    else:
        found, at = [], max(0, len(raw) - TAIL)
        for name in ('"rec_texts"', '"rec_boxes"'):
            at = raw.find(name, at)
            if at < 0:
                raise ValueError(f"{name} not found in the tail of the file")
            value, at = json.JSONDecoder().raw_decode(raw, raw.find("[", at))
            found.append(value)
        texts, boxes = found
    boxes = [[float(v) for v in row] for row in boxes]
    if len(texts) != len(boxes) or any(len(row) != 4 for row in boxes):
        raise ValueError(f"{len(texts)} rec_texts and {len(boxes)} rec_boxes do not belong together")
    return texts, boxes


def pointer(root, ref) -> object:
    """What a "#/a/0/b" points at, or None."""
    if not isinstance(ref, str) or not ref.startswith("#/"):
        return None
    for step in ref[2:].split("/"):
        try:
            root = root[int(step) if step.isdigit() else step]
        except (KeyError, IndexError, TypeError):
            return None
    return root


def layout_lines(root: dict) -> list[str]:
    """The texts of a layout document's body tree in reading order; children are references only."""
    out: list[str] = []
    stack = list(reversed(root["body"].get("children") or []))
    while stack:
        child = stack.pop()
        item = pointer(root, child.get("$ref")) if isinstance(child, dict) else None
        if isinstance(item, dict):
            if item.get("label") in TEXT_LABELS and filled(item.get("text")):
                out.append(item["text"].strip())
            stack += reversed(item.get("children") or [])
    return out


def by_path(value, path: str):
    """The value at a dotted path; numbers are places in lists. A path that leads nowhere is an error."""
    for step in filter(None, map(str.strip, path.split("."))):
        if not step.isdigit() and not isinstance(value, dict):
            raise KeyError(step)
        value = value[int(step) if step.isdigit() else step]
    return value


# File names whose content is read by its own form.
NATIVE_FILES = {"paddleocr_predict.json": "lines", "docling_document.json": "layout"}
LARGE, TAIL = 50 << 20, 55 << 20


def lines_of_file(raw: str) -> str:
    """The recognizer lines of a JSON text; of a large one only its end is searched, where the lines stand."""
    if len(raw) <= LARGE:
        found = recognized(json.loads(raw))
        if not found:
            raise ValueError("no rec_texts list found")
        return "\n".join(found)
    at = raw.find('"rec_texts"', max(0, len(raw) - TAIL))
    start = raw.find("[", at) if at >= 0 else -1
    if start < 0:
        raise ValueError('"rec_texts" not found in the tail of the file')
    found, _ = json.JSONDecoder().raw_decode(raw, start)
    if not all(isinstance(x, str) for x in found):
        raise ValueError("rec_texts is not a list of strings")
    return "\n".join(found)


def layout_text(raw: str) -> str:
    root = json.loads(raw)
    if not isinstance(root, dict) or not isinstance(root.get("body"), dict):
        raise ValueError("a layout document is an object with a body")
    return "\n".join(layout_lines(root))


def guessed_text(raw: str) -> str:
    found = guess(json.loads(raw))
    if found is None:
        raise ValueError("no text could be inferred from the JSON; name a key")
    return found


def keyed_text(raw: str, key: str) -> str:
    found = by_path(json.loads(raw), key)
    found = found if isinstance(found, str) else guess(found) if isinstance(found, (list, dict)) else None
    if not found and found != "":
        raise ValueError(f"the key {key!r} does not lead to a text")
    return found


def file_text(name: str, raw: str, form: str = "auto", key: str | None = None, native: bool = True) -> str:
    """The text of a prediction file: as it stands, or out of JSON by a key, by the form of its name, or by guessing."""
    name = name.lower()
    form = form.strip().lower()
    if form == "text" or (form == "auto" and not name.endswith(".json")):
        return raw
    if key is None and native and name in NATIVE_FILES:
        return {"lines": lines_of_file, "layout": layout_text}[NATIVE_FILES[name]](raw)
    if NATIVE_FILES.get(name) == "lines" and len(raw) > LARGE:
        raise ValueError("a recognizer file of this size is only read by its own form: name no key")
    return keyed_text(raw, key) if key else guessed_text(raw)


def file_texts(name: Column, raw: Column, form: str = "auto", key: str | None = None, native: bool = True) -> Column:
    """struct(text, error) of prediction files."""

    @F.pandas_udf("text string, error string")
    def run(names: pd.Series, raws: pd.Series) -> pd.DataFrame:
        out = []
        for n, r in zip(names, raws, strict=True):
            try:
                out.append((file_text(n or "", r or "", form, key, native), None))
            except (ValueError, KeyError, IndexError, TypeError) as problem:
                out.append((None, f"{type(problem).__name__}: {problem}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return run(name, raw)


READERS = {"guess": guess, "lines": lambda v: "\n".join(recognized(v)) or None, "layout": lambda v: "\n".join(layout_lines(v[0] if isinstance(v, list) and v else v)) or None}


def text_of(c: Column, how: str = "guess") -> Column:
    """The text of a JSON string; null where it is no JSON or holds none. how: guess, lines, layout."""
    reader = READERS[how]

    def one(raw: str | None) -> str | None:
        try:
            return None if raw is None else reader(json.loads(raw))
        except (ValueError, AttributeError, TypeError, KeyError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(c)
