"""Box geometry as expressions. A box is a struct or four columns x1, y1, x2, y2; a polygon an array of points x, y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def box_polygon(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))))


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; areas are 1 at least."""
    shared = overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    area = [F.greatest(F.lit(1.0), (k["x2"] - k["x1"]) * (k["y2"] - k["y1"])) for k in (a, b)]
    return shared / (area[0] + area[1] - shared)


def same_line(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Two boxes on one text line: centres close in height, and most of the narrower one's width shared."""
    h = F.least(a["y2"] - a["y1"], b["y2"] - b["y1"])
    w = F.least(a["x2"] - a["x1"], b["x2"] - b["x1"])
    dy = F.abs((a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2)
    return (dy <= 0.3 * h) & (overlap(a["x1"], a["x2"], b["x1"], b["x2"]) >= 0.65 * w)


def quad_confidence(points: Column, width: Column, height: Column) -> Column:
    """Half of the area covered, half of how well the polygon fills its box."""

    def area(p: Column) -> Column:
        after = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
        crossed = F.zip_with(p, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.abs(F.aggregate(crossed, F.lit(0.0), lambda s, x: s + x)) / 2

    box = polygon_box(points)
    whole = F.greatest((box["x2"] - box["x1"]) * (box["y2"] - box["y1"]), F.lit(1.0))
    covered = F.least(area(points) / F.greatest(width * height, F.lit(1.0)), F.lit(1.0))
    return 0.5 * covered + 0.5 * F.least(area(points) / whole, F.lit(1.0))


def corner_order(points: Column) -> Column:
    """Four corners from the top left, clockwise: least sum, least difference, most sum, most difference of y and x."""

    def pick(value, most: bool) -> Column:
        best = F.array_max if most else F.array_min
        values = F.transform(points, value)
        return F.element_at(points, F.array_position(values, best(values)).cast("int"))

    return F.array(
        pick(lambda p: p["x"] + p["y"], False),
        pick(lambda p: p["y"] - p["x"], False),
        pick(lambda p: p["x"] + p["y"], True),
        pick(lambda p: p["y"] - p["x"], True),
    )


def mapped_box(h: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box carried by a 3x3 homography (nine numbers, row by row): the box of its four corners."""

    def at(x: Column, y: Column) -> Column:
        w = F.get(h, F.lit(6)) * x + F.get(h, F.lit(7)) * y + F.get(h, F.lit(8))
        return F.struct(
            ((F.get(h, F.lit(0)) * x + F.get(h, F.lit(1)) * y + F.get(h, F.lit(2))) / w).alias("x"),
            ((F.get(h, F.lit(3)) * x + F.get(h, F.lit(4)) * y + F.get(h, F.lit(5))) / w).alias("y"),
        )

    return polygon_box(F.array(at(x1, y1), at(x2, y1), at(x2, y2), at(x1, y2)))


def padding(height: Column, width: Column) -> Column:
    """Padding by a line's size: top, bottom and side, each within fixed limits."""

    def clip(x: Column, low: int, high: int) -> Column:
        return F.bround(F.greatest(F.lit(low), F.least(F.lit(high), x)), 0).cast("int")

    return F.struct(clip(0.15 * height, 2, 18).alias("top"), clip(0.25 * height, 2, 24).alias("bottom"), clip(0.02 * width, 1, 12).alias("side"))


def candidate_score(confidence: Column, occupancy: Column, blank: Column, bonus: Column) -> Column:
    """How good a crop is: with a recogniser's confidence, or by ink alone where there is none (null)."""
    return F.when(confidence.isNull(), 0.25 * occupancy).otherwise(confidence + 0.18 * occupancy) - 0.10 * blank + bonus


def split_wins(split_mean: Column, parts: Column, full: Column) -> Column:
    """Whether reading a band as several lines beats reading it as one."""
    return split_mean + F.least(parts, F.lit(3)) * 0.02 >= full + 0.05
