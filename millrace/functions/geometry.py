"""Intervals, boxes and angles as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """Of a value that an expression needs in many places, computed once: Spark repeats what stands twice in a lambda."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou_enclosing(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common length over the length from the first start to the last end; 0 if that is 0."""
    return F.coalesce(F.try_divide(overlap(s1, e1, s2, e2).cast("double"), F.greatest(e1, e2) - F.least(s1, s2)), F.lit(0.0))


def iou_inclusive(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Of integer ranges whose ends both count."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    return F.coalesce(F.try_divide(both.cast("double"), (e1 - s1 + 1) + (e2 - s2 + 1) - both), F.lit(0.0))


def box_iou(a: Column, b: Column, least_area: float = 0.0) -> Column:
    """Of boxes (x1, y1, x2, y2)."""
    x = lambda c, i: F.get(c, i)
    common = overlap(x(a, 0), x(a, 2), x(b, 0), x(b, 2)) * overlap(x(a, 1), x(a, 3), x(b, 1), x(b, 3))
    area = lambda c: F.greatest(F.lit(least_area), (x(c, 2) - x(c, 0)) * (x(c, 3) - x(c, 1)))
    return F.coalesce(F.try_divide(common.cast("double"), area(a) + area(b) - common), F.lit(0.0))


def from_xywh(c: Column) -> Column:
    return F.array(F.get(c, 0), F.get(c, 1), F.get(c, 0) + F.get(c, 2), F.get(c, 1) + F.get(c, 3))


def contained(a: Column, b: Column) -> Column:
    """Share of box a that lies in box b."""
    x = lambda c, i: F.get(c, i)
    common = overlap(x(a, 0), x(a, 2), x(b, 0), x(b, 2)) * overlap(x(a, 1), x(a, 3), x(b, 1), x(b, 3))
    return F.coalesce(F.try_divide(common.cast("double"), (x(a, 2) - x(a, 0)) * (x(a, 3) - x(a, 1))), F.lit(0.0))


def unit_box(c: Column) -> Column:
    """Sides in order and within 0 and 1; a box with a coordinate beyond 1.5 is in thousandths. Null without four numbers, or without area."""

    def scaled(c: Column) -> Column:
        scale = F.when(F.array_max(F.transform(c, F.abs)) > 1.5, 1000.0).otherwise(1.0)
        return _let(scale, lambda by: F.transform(c, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / by))))

    def box(u: Column) -> Column:
        lo, hi = (lambda i, j: F.least(F.get(u, i), F.get(u, j))), (lambda i, j: F.greatest(F.get(u, i), F.get(u, j)))
        return F.when((hi(0, 2) > lo(0, 2)) & (hi(1, 3) > lo(1, 3)), F.array(lo(0, 2), lo(1, 3), hi(0, 2), hi(1, 3)))

    return _let(c, lambda c: F.when((F.size(c) == 4) & ~F.exists(c, lambda v: v.isNull()), _let(scaled(c), box)))


def union_area(boxes: Column) -> Column:
    """Area that any of the boxes covers: between neighbouring x of their sides, the merged y spans."""

    def covered(boxes: Column, xs: Column) -> Column:
        def slab(x: Column, i: Column) -> Column:
            right = F.get(xs, i + 1)
            spans = F.array_sort(F.transform(F.filter(boxes, lambda b: (F.get(b, 0) < right) & (F.get(b, 2) > x)), lambda b: F.struct(F.get(b, 1).alias("lo"), F.get(b, 3).alias("hi"))))
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))
            add = lambda a, s: F.struct((a["sum"] + F.greatest(F.lit(0.0), s["hi"] - F.greatest(s["lo"], a["end"]))).alias("sum"), F.greatest(a["end"], s["hi"]).alias("end"))
            return F.coalesce((right - x) * F.aggregate(spans, start, add)["sum"], F.lit(0.0))

        return F.aggregate(F.transform(xs, slab), F.lit(0.0), lambda a, x: a + x)

    sides = lambda boxes: F.array_sort(F.array_distinct(F.flatten(F.transform(boxes, lambda b: F.array(F.get(b, 0), F.get(b, 2))))))
    return _let(boxes, lambda boxes: _let(sides(boxes), lambda xs: covered(boxes, xs)))


def union_iou(a: Column, b: Column) -> Column:
    """Of what two sets of boxes cover; 0 if either is empty."""
    own = union_area(a) + union_area(b)
    share = _let(union_area(F.concat(a, b)), lambda both: F.coalesce(F.try_divide(F.greatest(F.lit(0.0), own - both), both), F.lit(0.0)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def angle_between(azimuth1: Column, elevation1: Column, azimuth2: Column, elevation2: Column) -> Column:
    """Degrees between two directions given in degrees."""
    r = F.radians
    cos = F.sin(r(elevation1)) * F.sin(r(elevation2)) + F.cos(r(elevation1)) * F.cos(r(elevation2)) * F.cos(r(azimuth1 - azimuth2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def credit(value: Column, threshold: Column, higher_is_better: Column) -> Column:
    """Value over threshold, or threshold over value, between 0 and 1."""
    share = F.when(higher_is_better, F.try_divide(value, threshold)).otherwise(F.try_divide(threshold, value))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(1.0))))
