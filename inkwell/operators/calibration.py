"""Bands from known pairs, baselines and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.verdicts import band, placement, purpose


def long_scores(pairs: DataFrame, scorers: list[str], keep: list[str]) -> DataFrame:
    """(keep, scorer, s): one row for each scorer."""
    parts = ", ".join(f"'{s}', {s}" for s in scorers)
    return pairs.select(*keep, F.expr(f"stack({len(scorers)}, {parts}) as (scorer, s)"))


def bands(scores: DataFrame) -> DataFrame:
    """By scorer: range and mean of ceiling and floor, whether both exist and are apart.

    ``scores``: (kind, scorer, s); what is neither ceiling nor floor is left out.
    """
    use = scores.withColumn("use", purpose(F.col("kind")))
    of = lambda f, u: f(F.when(F.col("use") == u, F.col("s")))
    out = use.groupBy("scorer").agg(
        of(F.min, "ceiling").alias("ceil_lo"), of(F.avg, "ceiling").alias("ceil_mean"), of(F.max, "ceiling").alias("ceil_hi"),
        of(F.min, "floor").alias("floor_lo"), of(F.avg, "floor").alias("floor_mean"), of(F.max, "floor").alias("floor_hi"),
    )
    return out.select(
        "*", F.coalesce(F.col("ceil_lo") > F.col("floor_hi"), F.lit(False)).alias("separated"),
        F.col("floor_lo").isNotNull().alias("have_floor"), F.col("ceil_lo").isNotNull().alias("have_ceiling"),
    )


def verdicts(scores: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Each score with its place against the bands of its scorer; a row for each scorer goes to all tasks."""
    b = calibrated.select("scorer", "ceil_lo", "floor_hi", "have_ceiling", "have_floor", "separated")
    place = band(F.col("s"), F.col("ceil_lo"), F.col("floor_hi"), F.col("have_ceiling"), F.col("have_floor"), F.col("separated"))
    return scores.join(F.broadcast(b), "scorer").withColumn("verdict", place).drop("ceil_lo", "floor_hi", "have_ceiling", "have_floor", "separated")


def against_baseline(pairs: DataFrame, scorers: list[str], kind: str = "type", baseline: str = "ref-ref") -> DataFrame:
    """Ratios to the mean of the baseline pairs: NaN at a mean of 1e-6 or less, no columns without such pairs."""
    base = pairs.where(F.col(kind) == baseline).agg(F.count("*").alias("_n"), *(F.avg(s).alias(f"_{s}") for s in scorers))
    if not base.first()["_n"]:
        return pairs
    ratio = lambda s: F.when(F.col(f"_{s}") > 1e-6, F.col(s) / F.col(f"_{s}")).otherwise(F.lit(float("nan")))
    return pairs.join(F.broadcast(base)).select(pairs.columns + [ratio(s).alias(f"{s}_vs_baseline") for s in scorers])


def correlation(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, n, r): Pearson's r, null below 3 rows or without variance."""
    out = rows.groupBy(*keys).agg(F.count(F.col(x) + F.col(y)).alias("n"), F.corr(x, y).alias("r"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"))
    return out.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("_x") > 0) & (F.col("_y") > 0), F.col("r")).alias("r"))


def histogram(rows: DataFrame, value: str, keys: list[str], low: float, high: float, bins: int = 15) -> DataFrame:
    """(keys, bin, n) over equal bins from ``low``; the last one holds ``high`` too."""
    at = F.floor((F.col(value) - low) / ((high - low) / bins))
    inside = rows.where((F.col(value) >= low) & (F.col(value) <= high))
    return inside.groupBy(*keys, F.least(at, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


#: What a place of an observed score says, as the last line of a scorer's summary.
PLACES = {
    "both": "inside both ranges: this scorer does not tell them apart",
    "unrelated": "within the range of unrelated pairs",
    "same": "within the range of the same writer's pairs",
    "between": "between the ranges",
}


def summary_lines(scores: DataFrame, observed: DataFrame) -> DataFrame:
    """(scorer, line, text): the calibration as text, five lines for each scorer.

    ``scores``: (scorer, use, s) with the uses ceiling and floor; ``observed``: (scorer, observed). Scorers
    without either range have no summary.
    """
    of = lambda f, u: f(F.when(F.col("use") == u, F.col("s")))
    stats = scores.groupBy("scorer").agg(*(of(f, u).alias(f"{u}_{n}") for u in ("ceiling", "floor") for f, n in ((F.count, "n"), (F.avg, "mean"), (F.min, "low"), (F.max, "high"))))
    rows = stats.where("ceiling_n > 0 and floor_n > 0").join(observed, "scorer")
    p = placement(F.col("observed"), F.col("ceiling_low"), F.col("floor_high"))
    told = F.element_at(F.create_map(*(F.lit(x) for pair in PLACES.items() for x in pair)), p["place"])
    ranged = lambda name, u: F.format_string(f"  {name} (n=%d): mean %.3f, range [%.3f, %.3f]", *(F.col(f"{u}_{c}") for c in ("n", "mean", "low", "high")))
    way = F.when(p["place"] == "between", F.format_string(", %.0f%% of the way up", F.bround(p["fraction"] * 100))).otherwise("")
    lines = F.array(F.upper("scorer"), ranged("same writer", "ceiling"), ranged("unrelated", "floor"), F.format_string("  observed: %.3f", F.col("observed")), F.concat(F.lit("  placement: "), told, way))
    return rows.select("scorer", F.posexplode(lines).alias("line", "text"))
