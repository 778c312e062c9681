"""Boxes as columns: four numbers x0, y0, x1, y1 in a struct or as plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a full page.
FULL_RATIO, FULL_SPAN, FULL_SPAN_RATIO = 0.80, 0.95, 0.30
NATIVE_CHARS = 50


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Area that both cover."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return w * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def covered_fraction(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` covers."""
    return overlap(a, b) / F.greatest(area(a), F.lit(1e-6))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return overlap(a, b) / F.least(F.greatest(area(a), F.lit(1e-6)), F.greatest(area(b), F.lit(1e-6)))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-9))


def rescaled(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def from_relative(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corners in pixels from a corner and sides between 0 and 1."""
    return box(x * width, y * height, (x + w) * width, (y + h) * height)


def whole(b: Column) -> Column:
    """Coordinates cut to whole numbers towards zero."""
    return F.struct(*(b[c].cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))


def padded(b: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """Grown by a margin, inside the page."""
    zero = F.lit(0.0)
    return box(F.greatest(zero, b["x0"] - dx), F.greatest(zero, b["y0"] - dy), F.least(width, b["x1"] + dx), F.least(height, b["y1"] + dy))


def is_valid(b: Column) -> Column:
    return (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & (b["x0"] >= 0) & (b["y0"] >= 0)


def effective_dpi(pixels: Column, points: Column) -> Column:
    """Pixels by inch of a placed image; null for a width of a point or less."""
    return F.when(points > 1, F.round(pixels / (points / 72.0), 1))


def is_full_page(ratio: Column, span_w: Column, span_h: Column) -> Column:
    return (ratio >= FULL_RATIO) | ((F.greatest(span_w, span_h) >= FULL_SPAN) & (ratio >= FULL_SPAN_RATIO))


def composition(n_full: Column, n_images: Column, n_chars: Column, n_drawings: Column) -> Column:
    """How a page is made up."""
    text = n_chars >= NATIVE_CHARS
    return (
        F.when((n_full > 0) & ~text, "scanned")
        .when(n_full > 0, "scanned_with_text_layer")
        .when(text | (n_drawings > 0), "native")
        .when(n_images > 0, "image_only")
        .otherwise("empty")
    )
