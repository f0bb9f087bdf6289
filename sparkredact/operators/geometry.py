"""Boxes: from polygons, from word boxes, and kept inside the image. All are expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, width, height) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def box_ok(b: Column) -> Column:
    """Whether a box is one: no negative corner, a positive extent."""
    return (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] > 0) & (b["height"] > 0)


def _span(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """Both ends inside 0..size, rounded half to even, a pixel apart at least."""
    inside = lambda v: F.rint(F.least(F.greatest(v, F.lit(0.0)), size.cast("double"))).cast("int")
    a, b = inside(low), inside(high)
    flat = b <= a
    room = a + 1 <= size
    return F.when(flat & ~room, size - 1).otherwise(a), F.when(flat, F.when(room, a + 1).otherwise(size)).otherwise(b)


def quad_to_box(quad: Column, width: Column, height: Column) -> Column:
    """The smallest box around a polygon of structs (x, y); null without vertices or with an image that has no size."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    left, right = _span(F.array_min(xs), F.array_max(xs), width)
    top, bottom = _span(F.array_min(ys), F.array_max(ys), height)
    sound = (F.size(quad) > 0) & ~F.exists(quad, lambda p: p["x"].isNull() | p["y"].isNull()) & (width > 0) & (height > 0)
    return F.when(sound, box(left, top, right - left, bottom - top))


def words_to_box(words: Column) -> Column:
    """The box around word boxes (left, top, width, height), moved inside but not shrunk; null without a positive extent."""
    good = F.filter(words, lambda w: w["left"].isNotNull() & w["top"].isNotNull() & w["width"].isNotNull() & w["height"].isNotNull())
    left, top = F.array_min(F.transform(good, lambda w: w["left"])), F.array_min(F.transform(good, lambda w: w["top"]))
    right = F.array_max(F.transform(good, lambda w: w["left"] + w["width"]))
    bottom = F.array_max(F.transform(good, lambda w: w["top"] + w["height"]))
    return F.when((right > left) & (bottom > top), box(F.greatest(left, F.lit(0)), F.greatest(top, F.lit(0)), right - left, bottom - top))


def confidence(c: Column) -> Column:
    """c between 0 and 1; null and NaN are 0."""
    c = c.try_cast("double")
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share a pixel."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])
