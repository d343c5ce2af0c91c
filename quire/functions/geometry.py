"""Boxes and polygons on a page, as Column builders over structs; the origin is the top left corner.

A box is struct<x0,y0,x1,y1: double> in shares of the page; a polygon is array<struct<x,y: double>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.base import let

EPS = 1e-12
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """With the corners put in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def center(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def overlap(a: Column, b: Column) -> Column:
    side = lambda p, q: F.greatest(F.least(a[q], b[q]) - F.greatest(a[p], b[p]), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def iou(a: Column, b: Column) -> Column:
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def from_percent(p: Column) -> Column:
    """The box of struct(x, y, width, height) in percent; null where a part is missing or no number."""
    x, y, w, h = (p[k].try_cast("double") for k in ("x", "y", "width", "height"))
    there = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    return F.when(there, box(x / 100, y / 100, (x + w) / 100, (y + h) / 100))


def from_document(b: Column, page_width: Column, page_height: Column) -> Column:
    """The box of struct(l, t, r, b), whose y runs upwards: pixels where some coordinate exceeds 1.5, else shares.
    Null where a coordinate is missing or the page has no size. Boxes beyond the page stay as they are."""
    pixels = F.greatest(*(F.abs(b[k]) for k in "ltrb")) > 1.5
    x = lambda k: F.when(pixels, b[k] / page_width).otherwise(b[k])
    y = lambda k: F.when(pixels, (page_height - b[k]) / page_height).otherwise(1 - b[k])
    there = F.lit(True)
    for k in "ltrb":
        there = there & b[k].isNotNull()
    return F.when(there & (page_width > 0) & (page_height > 0), box(x("l"), y("t"), x("r"), y("b")))


def polygon(p: Column) -> Column:
    """The corners of struct(x, y, width, height, rotation) in percent, turned about its centre by rotation degrees."""
    x, y, w, h = (p[k].try_cast("double") / 100 for k in ("x", "y", "width", "height"))
    turn = F.radians(F.coalesce(p["rotation"].try_cast("double"), F.lit(0.0)))
    cx, cy, c, s = x + w / 2, y + h / 2, F.cos(turn), F.sin(turn)
    corner = lambda dx, dy: F.struct((cx + dx * c - dy * s).alias("x"), (cy + dx * s + dy * c).alias("y"))
    corners = F.array(corner(-w / 2, -h / 2), corner(w / 2, -h / 2), corner(w / 2, h / 2), corner(-w / 2, h / 2))
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), corners)


def _edges(poly: Column) -> Column:
    """(p, q) of neighbouring corners, the last with the first."""
    turned = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))
    return F.zip_with(poly, turned, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _signed_double_area(poly: Column) -> Column:
    step = lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    return F.aggregate(_edges(poly), F.lit(0.0), step)


def polygon_area(poly: Column) -> Column:
    return F.when(F.size(poly) < 3, 0.0).otherwise(F.abs(_signed_double_area(poly)) / 2)


def inside_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd rule; points on the boundary are inside."""

    def on_edge(e: Column) -> Column:
        p, q = e["p"], e["q"]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        within = lambda v, a, b: (v >= F.least(a, b) - EPS) & (v <= F.greatest(a, b) + EPS)
        return (F.abs(cross) <= EPS) & within(x, p["x"], q["x"]) & within(y, p["y"], q["y"])

    def crossed(odd: Column, e: Column) -> Column:
        p, q = e["p"], e["q"]
        straddles = (p["y"] > y) != (q["y"] > y)
        rise = F.when(straddles, q["y"] - p["y"]).otherwise(F.lit(1.0))
        return odd != (straddles & (x < (q["x"] - p["x"]) * (y - p["y"]) / rise + p["x"]))

    edges = _edges(poly)
    return (F.size(poly) >= 3) & (F.exists(edges, on_edge) | F.aggregate(edges, F.lit(False), crossed))


POLYGON = "array<struct<x:double,y:double>>"


def clip_to_box(poly: Column, b: Column) -> Column:
    """The part of a convex polygon in a box: cut by four half-planes (u x + v y + w >= 0), one after the other."""
    plane = lambda u, v, w: F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), w.alias("w"))
    planes = F.array(plane(1.0, 0.0, -b["x0"]), plane(-1.0, 0.0, b["x1"]), plane(0.0, 1.0, -b["y0"]), plane(0.0, -1.0, b["y1"]))

    def cut(e: Column) -> Column:
        p, q, dp, dq = e["p"], e["q"], e["dp"], e["dq"]
        at = dp / F.when(dp != dq, dp - dq).otherwise(F.lit(1.0))
        met = F.struct((p["x"] + at * (q["x"] - p["x"])).alias("x"), (p["y"] + at * (q["y"] - p["y"])).alias("y"))
        return F.array_compact(F.array(F.when((dp >= 0) != (dq >= 0), met), F.when(dq >= 0, q)))

    def half_plane(points: Column, h: Column) -> Column:
        depth = lambda p: h["u"] * p["x"] + h["v"] * p["y"] + h["w"]
        deep = F.transform(_edges(points), lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), depth(e["p"]).alias("dp"), depth(e["q"]).alias("dq")))
        return F.flatten(F.transform(deep, cut)).cast(POLYGON)

    return F.aggregate(planes, poly.cast(POLYGON), half_plane)


def iou_polygon_box(poly: Column, b: Column) -> Column:
    """Of a convex polygon (either orientation) and a box."""

    def share(shared: Column) -> Column:
        union = polygon_area(poly) + area(b) - shared
        return F.when(union > 0, shared / union).otherwise(0.0)

    return let(let(clip_to_box(poly, b), polygon_area), share)


def reading_row(b: Column) -> Column:
    """The middle of the box's height to one decimal, halves as Python rounds the double: by its exact binary value.

    Below 64 pages, twenty times the double is compared with the odd number of halves in whole 2**-57ths, so nothing
    is lost; beyond, where no page reaches, the shortest decimal decides."""
    mid = (b["y0"] + b["y1"]) / 2
    tenths = F.floor(mid * 10).cast("decimal(12,0)")
    twentieths = (mid * float(2**57)).cast("long").cast("decimal(19,0)") * F.lit(20).cast("decimal(2,0)")
    half = (tenths * 2 + 1).cast("decimal(14,0)") * F.lit(2**57).cast("decimal(18,0)")
    up = (twentieths > half) | ((twentieths == half) & (tenths % 2 != 0))
    near = (tenths + F.when(up, 1).otherwise(0)).cast("double") / 10
    return F.when(F.abs(mid) < 64, near).otherwise(F.bround(mid, 1))
