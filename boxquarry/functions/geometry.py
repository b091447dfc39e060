"""Box geometry as plain column expressions; every function stays inside whole-stage codegen."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Corners of a box, in pixels."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    """The box in columns ``{prefix}x1`` to ``{prefix}y2``."""
    return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def box_in(struct: Column) -> Box:
    return Box(*(struct[c] for c in ("x1", "y1", "x2", "y2")))


def area(b: Box) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0)) * F.greatest(b.y2 - b.y1, F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    return area(Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def rounded(value: Column, digits: int) -> Column:
    """To so many decimals as SQL engines round doubles: the product with 10^digits, halves away from 0.

    Spark's own round goes by the shortest decimal form instead, so it rounds 0.1251953125 otherwise where the product falls short of the half.
    """
    scaled = F.abs(value.cast("double") * F.lit(10.0**digits))
    whole = F.floor(scaled).cast("double")
    up = (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)
    return F.when(value < 0, -up).otherwise(up)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    return iou_of_areas(intersection(a, b), area(a), area(b))


def iou_of_areas(both: Column, a: Column, b: Column) -> Column:
    """``iou`` from the area of the intersection and those of both boxes, where they are at hand: written out, an IoU repeats each corner many times."""
    return _ratio(both, a + b - both)


def coverage(a: Box, b: Box) -> Column:
    """The share of ``a`` that ``b`` covers."""
    return _ratio(intersection(a, b), area(a))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def gap(a: Box, b: Box) -> Column:
    """Distance between the nearest points of two boxes."""
    dx = F.greatest(a.x1 - b.x2, b.x1 - a.x2, F.lit(0))
    dy = F.greatest(a.y1 - b.y2, b.y1 - a.y2, F.lit(0))
    return F.hypot(dx.cast("double"), dy.cast("double"))


def clamp(b: Box, width: Column, height: Column) -> Box:
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    return Box(inside(b.x1, width), inside(b.y1, height), inside(b.x2, width), inside(b.y2, height))


def area_ratio(b: Box, width: Column, height: Column) -> Column:
    """Area inside the image over the image's area, of at least one pixel."""
    return area(clamp(b, width, height)).cast("double") / F.greatest(width * height, F.lit(1))


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """Pixels from a normalised centre and size."""
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def to_centre(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Normalised centre and size, without clipping."""
    return (b.x1 + b.x2) / 2.0 / width, (b.y1 + b.y2) / 2.0 / height, (b.x2 - b.x1).cast("double") / width, (b.y2 - b.y1).cast("double") / height


def label_line(class_id: Column, b: Box, width: Column, height: Column) -> Column:
    """A label file's line: class, centre and size with six decimals, ties to even."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id.cast("int"), *[F.bround(v, 6) for v in to_centre(b, width, height)])


def edge_margin(b: Box, width: Column, height: Column) -> Column:
    """Smallest normalised distance to an edge of the image."""
    return F.least(b.x1.cast("double") / width, b.y1.cast("double") / height, 1 - b.x2.cast("double") / width, 1 - b.y2.cast("double") / height)


def touches_edge(b: Box, width: Column, height: Column, margin: int = 0) -> Column:
    return (b.x1 <= margin) | (b.y1 <= margin) | (b.x2 >= width - margin) | (b.y2 >= height - margin)


def crop_box(b: Box, width: Column, height: Column, pad: float) -> Column:
    """Struct of padded whole-pixel corners inside the image, or null if nothing is left."""
    dx, dy = (b.x2 - b.x1) * pad, (b.y2 - b.y1) * pad
    whole = lambda v: F.bround(v.cast("double")).cast("long")
    c = Box(F.greatest(whole(b.x1 - dx), F.lit(0)), F.greatest(whole(b.y1 - dy), F.lit(0)), F.least(whole(b.x2 + dx), width), F.least(whole(b.y2 + dy), height))
    return F.when((c.x2 > c.x1) & (c.y2 > c.y1), F.struct(*[v.alias(n) for n, v in zip(c._fields, c, strict=True)]))


def iou_bucket(best: Column, threshold: float) -> Column:
    return (
        F.when(best.isNull(), "no_prediction")
        .when(best >= threshold, "matched_range")
        .when(best >= 0.3, "near_miss")
        .when(best >= 0.1, "weak_overlap")
        .when(best > 0, "touching")
        .otherwise("disjoint")
    )


def softmax(scores: Column) -> Column:
    """Shares of an array of scores, shifted by the largest."""
    raised = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda t, v: t + v)
    return F.transform(raised, lambda v: v / total)


def argmax(scores: Column) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of x, y, x, y, ..."""
    n = F.size(points) / 2
    at = lambda k: F.element_at(points, (k + 1).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: at(2 * i) * at(2 * F.pmod(i + 1, n) + 1) - at(2 * F.pmod(i + 1, n)) * at(2 * i + 1))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda t, v: t + v)) / 2
