"""Column expressions on axis-aligned boxes given as four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four columns of one box, for example box("a_") or box("d.")."""
    return tuple(F.col(prefix + name) for name in BOX)


def area(b) -> Column:
    x1, y1, x2, y2 = b
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def intersection(a, b) -> Column:
    zero = F.lit(0.0)
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(zero, width) * F.greatest(zero, height)


def iou(a, b) -> Column:
    """Intersection over union; 0 when both boxes are empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union == 0, 0.0).otherwise(inter / union)


def is_valid(b) -> Column:
    """All four numbers present and a positive extent on both axes."""
    x1, y1, x2, y2 = b
    return F.coalesce((x2 > x1) & (y2 > y1), F.lit(False))


def expand(b, ratio: float):
    """Grow by ratio of the side length on every side."""
    x1, y1, x2, y2 = b
    dx, dy = (x2 - x1) * ratio, (y2 - y1) * ratio
    return x1 - dx, y1 - dy, x2 + dx, y2 + dy


def overlaps(a, b) -> Column:
    """Strict overlap: touching edges do not count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def meets(a, b) -> Column:
    """Overlap where touching edges count."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def touches_edge(b, width: float, height: float, margin: float = 0.0) -> Column:
    x1, y1, x2, y2 = b
    return (x1 <= margin) | (y1 <= margin) | (x2 >= width - margin) | (y2 >= height - margin)


def short_side(b) -> Column:
    return F.least(b[2] - b[0], b[3] - b[1])


def center_to_corners(cx: Column, cy: Column, w: Column, h: Column, width=1.0, height=1.0):
    """A normalised centre box as corners, scaled to width x height."""
    return (
        (cx - w / 2) * width,
        (cy - h / 2) * height,
        (cx + w / 2) * width,
        (cy + h / 2) * height,
    )


def padded_crop(b, pad: float, width: int, height: int, minimum: int = 4):
    """A whole-pixel crop rectangle: pad by a share of each side (negative shrinks), clamp to the
    image and keep at least `minimum` pixels on each side."""
    x1, y1, x2, y2 = b
    dx, dy = (x2 - x1) * pad, (y2 - y1) * pad
    left = F.greatest(F.lit(0), F.floor(x1 - dx))
    top = F.greatest(F.lit(0), F.floor(y1 - dy))
    right = F.least(F.lit(width), F.ceil(x2 + dx))
    bottom = F.least(F.lit(height), F.ceil(y2 + dy))
    right = F.greatest(right, F.least(F.lit(width), left + minimum))
    bottom = F.greatest(bottom, F.least(F.lit(height), top + minimum))
    left = F.least(left, right - minimum)
    top = F.least(top, bottom - minimum)
    return left, top, right, bottom
