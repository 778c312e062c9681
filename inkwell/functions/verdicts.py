"""Labels and verdicts as columns. Their wording is a fixed value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence_level(score: Column) -> Column:
    """Strictly above the bounds."""
    return F.when(score > 0.8, "High").when(score > 0.6, "Medium").otherwise("Low")


def quality_band(score: Column, bounds: tuple[float, float, float] = (0.8, 0.6, 0.4)) -> Column:
    """Bounds included: 3 for the best of four bands."""
    return F.when(score >= bounds[0], 3).when(score >= bounds[1], 2).when(score >= bounds[2], 1).otherwise(0)


def relationship_strength(common: Column) -> Column:
    return F.when(common > 2, "High").when(common > 1, "Medium").otherwise("Low")


def shape_distance(aspect_a: Column, aspect_b: Column) -> Column:
    return F.abs(F.ln(aspect_a) - F.ln(aspect_b))


def pair_type(a: Column, b: Column) -> Column:
    """What a pair of roles can be used for."""
    roles = F.array_join(F.array_sort(F.array_distinct(F.array(a, b))), "+")
    return (
        F.when(roles == "reference", "ref-ref (same writer)")
        .when(roles == "control+reference", "ref-control (diff writer)")
        .when(roles == "questioned+reference", "ref-questioned (THE QUESTION)")
        .when(roles == "questioned", "q-q")
        .when(roles == "control+questioned", "q-control (diff writer)")
        .otherwise("control-control (diff writer)")
    )


def purpose(kind: Column) -> Column:
    """Ceiling: same writer; floor: reference against control only."""
    return (
        F.when(kind.startswith("ref-ref"), "ceiling")
        .when(kind.startswith("ref-control"), "floor")
        .when(kind.startswith("ref-questioned"), "questioned")
        .when(kind == "q-q", "q-q")
        .otherwise("context")
    )


def band(score: Column, ceil_lo: Column, floor_hi: Column, have_ceiling: Column, have_floor: Column, separated: Column) -> Column:
    """A score against the calibrated bands; without both bands, or if they overlap, there is no verdict."""
    return (
        F.when(~(have_ceiling & have_floor), "NO VERDICT (uncalibrated)")
        .when(~separated, "NOT DIAGNOSTIC (bands overlap)")
        .when(score >= ceil_lo, "in same-writer band")
        .when(score <= floor_hi, "in diff-writer band")
        .otherwise("between bands")
    )


def placement(observed: Column, same_min: Column, unrelated_max: Column) -> Column:
    """struct(place, fraction): the fraction of the way only between the ranges."""
    low, high = observed <= unrelated_max, observed >= same_min
    place = F.when(low & high, "both").when(low, "unrelated").when(high, "same").otherwise("between")
    fraction = F.when(place == "between", (observed - unrelated_max) / (same_min - unrelated_max))
    return F.struct(place.alias("place"), fraction.alias("fraction"))
