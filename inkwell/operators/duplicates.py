"""Duplicate marks by level: equal streams, equal pixels, near-equal hashes, equal paths; and what each finding means."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.vectors import dot
from inkwell.operators.staging import materialised

#: Members of a band beyond which its key takes a part of the other bits in as well.
HOT_BAND = 1000
#: What an equal stream or equal pixels mean by the classes of both marks, and if that is to be looked into.
READINGS = {
    ("scanned_wet_ink", "scanned_wet_ink"): ("anomalous", True),
    ("pasted_image", "scanned_wet_ink"): ("lifted", True),
    ("pasted_image", "pasted_image"): ("reused", False),
}
BENIGN = "crypto_signature"
#: Path coordinates are compared in steps of this size, in two grids half a step apart.
STEP = 1e-4


def pixels(v: Column, greys: int = 16) -> Column:
    """A vector as whole greys between its least and its greatest value."""
    low, high = F.array_min(v), F.array_max(v)
    return F.transform(v, lambda x: F.floor((x - low) / (high - low) * (greys - 1) + 0.5))


def centred(v: Column) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.transform(v, lambda x: x - mean)


def sign_hash(v: Column) -> Column:
    """64 bits: which of the first 64 values are positive."""
    bits = F.array_join(F.transform(F.slice(v, 1, 64), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.rpad(bits, 64, "0")


def firsts(marks: DataFrame, content: Column) -> DataFrame:
    """``marks`` with ``first``: the smallest id that has the same content."""
    keyed = marks.withColumn("_key", F.sha2(F.to_json(F.struct(content.alias("c"))), 256))
    first = keyed.groupBy("_key").agg(F.min("sig_id").alias("first"))
    return keyed.join(first, "_key").drop("_key")


def levels(marks: DataFrame, most_bits: int = 2, least_correlation: float = 0.99) -> DataFrame:
    """(level, sig_a, sig_b): L0 equal streams, L1 equal pixels, L2 hashes within ``most_bits`` and correlated."""
    raw = materialised(firsts(marks.select("sig_id", "v"), F.col("v")))
    pix = materialised(firsts(raw.where("sig_id = first").drop("first"), pixels(F.col("v"))))
    copies = lambda df, name: df.where("sig_id <> first").select(F.lit(name).alias("level"), F.col("first").alias("sig_a"), F.col("sig_id").alias("sig_b"))
    rows = pix.where("sig_id = first").select("sig_id", bits_of(F.transform(F.slice("v", 1, 64), lambda x: x > 0)).alias("bits"), centred(F.col("v")).alias("z"))
    near = correlated(near_hashes(rows, most_bits), rows, least_correlation)
    return copies(raw, "L0").union(copies(pix, "L1")).union(near.select(F.lit("L2").alias("level"), "sig_a", "sig_b"))


def bits_of(flags: Column) -> Column:
    """At most 64 booleans as one number."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda n, x: F.shiftleft(n, 1).bitwiseOR(x.cast("long")))


def field(bits: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))


def near_hashes(rows: DataFrame, most_bits: int = 2, hot: int = HOT_BAND) -> DataFrame:
    """(sig_a, sig_b) of rows (sig_id, bits) whose 64 bits differ in at most ``most_bits`` places.

    Such hashes agree in one of ``most_bits`` + 1 bands, and what is left of them in one of as
    many parts: bands with many members are split by these.
    """
    n = most_bits + 1
    edges = [64 * k // n for k in range(n + 1)]
    rows = materialised(rows.select("sig_id", "bits"))
    bands = F.array(*(F.struct(F.lit(k).alias("k"), field(F.col("bits"), a, b - a).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    banded = rows.select("sig_id", "bits", F.explode(bands).alias("band")).select("sig_id", "bits", "band.k", "band.value")
    sizes = materialised(banded.groupBy("k", "value").agg(F.count("*").alias("n")).where("n > 1"))
    light = banded.join(sizes.where(F.col("n") <= hot), ["k", "value"], "left_semi").withColumn("part", F.lit(-1)).withColumn("other", F.lit(0).cast("long"))
    heavy = banded.join(sizes.where(F.col("n") > hot), ["k", "value"], "left_semi")
    rest = F.lit(0).cast("long")
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        above = F.shiftleft(F.shiftrightunsigned("bits", b), a) if b < 64 else F.lit(0).cast("long")
        rest = F.when(F.col("k") == k, above.bitwiseOR(field(F.col("bits"), 0, a) if a else F.lit(0).cast("long"))).otherwise(rest)
    size = 64 - min(b - a for a, b in zip(edges, edges[1:], strict=False))
    cuts = [size * k // n for k in range(n + 1)]
    parts = F.array(*(F.struct(F.lit(j).alias("part"), field(rest, a, b - a).alias("other")) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))
    split = heavy.withColumn("p", F.explode(parts)).select("sig_id", "bits", "k", "value", "p.part", "p.other")
    keyed = materialised(light.select(*split.columns).unionByName(split))
    on = ["k", "value", "part", "other"]
    pairs = keyed.withColumnsRenamed({"sig_id": "sig_a", "bits": "x"}).join(keyed.withColumnsRenamed({"sig_id": "sig_b", "bits": "y"}), on)
    return pairs.where((F.col("sig_a") < F.col("sig_b")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most_bits)).select("sig_a", "sig_b").distinct()


def correlated(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Pairs whose centred values (sig_id, z) correlate by ``least`` at least."""
    for s in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("sig_id").alias(f"sig_{s}"), F.col("z").alias(f"z{s}")), f"sig_{s}")
    alike = dot(F.col("za"), F.col("zb")) / F.sqrt(dot(F.col("za"), F.col("za")) * dot(F.col("zb"), F.col("zb"))) >= least
    return pairs.where(alike).select("sig_a", "sig_b")


def cosine_basis(side: int = 8) -> np.ndarray:
    """A row for each frequency of pictures of ``side`` by ``side``."""
    k = np.arange(side)
    one = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * side))
    return np.einsum("ac,bd->abcd", one, one).reshape(side * side, side * side)


@F.pandas_udf(T.LongType())
def dct_hash(pictures: pd.Series) -> pd.Series:
    """64 bits of a picture of 8 by 8 values: which frequencies lie above the median of all but the mean."""
    table = np.array(pictures.tolist(), float).reshape(len(pictures), 64) @ cosine_basis().T
    bits = table > np.median(table[:, 1:], axis=1, keepdims=True)
    return pd.Series(np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64))


def canonical_path(points: Column) -> Column:
    """Points (x, y) in a form that affine maps don't change; null where all lie on a line.

    They are centred and made of unit spread in every direction, then turned so that the
    first lies on the right-hand axis, and mirrored so that the next off it lies above.
    """
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p))
    n = F.size(points)
    mean = F.struct((total(lambda p: p["x"]) / n).alias("x"), (total(lambda p: p["y"]) / n).alias("y"))
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  a value that is used more than once
    moved = let(mean, lambda m: F.transform(points, lambda p: F.struct((p["x"] - m["x"]).alias("x"), (p["y"] - m["y"]).alias("y"))))

    def spread(ps):
        sums = lambda f: F.aggregate(ps, F.lit(0.0), lambda s, p: s + f(p))
        moments = F.struct(sums(lambda p: p["x"] * p["x"]).alias("a"), sums(lambda p: p["x"] * p["y"]).alias("b"), sums(lambda p: p["y"] * p["y"]).alias("c"))
        return let(moments, lambda m: F.when((m["a"] > 0) & (m["a"] * m["c"] - m["b"] * m["b"] > 1e-12 * m["a"] * m["c"]), F.transform(ps, lambda p: F.struct(
            (p["x"] / F.sqrt(m["a"])).alias("x"), ((p["y"] - m["b"] / m["a"] * p["x"]) / F.sqrt(m["c"] - m["b"] * m["b"] / m["a"])).alias("y"),
        ))))

    def turned(ps):
        far = F.filter(ps, lambda p: p["x"] * p["x"] + p["y"] * p["y"] > 1e-9)
        first = let(F.element_at(far, 1), lambda p: F.struct((p["x"] / F.hypot(p["x"], p["y"])).alias("c"), (p["y"] / F.hypot(p["x"], p["y"])).alias("s")))
        return let(first, lambda t: F.transform(ps, lambda p: F.struct((p["x"] * t["c"] + p["y"] * t["s"]).alias("x"), (p["y"] * t["c"] - p["x"] * t["s"]).alias("y"))))

    def mirrored(ps):
        up = F.signum(F.element_at(F.filter(ps, lambda p: F.abs(p["y"]) > 1e-6), 1)["y"])
        return let(up, lambda u: F.transform(ps, lambda p: F.struct(p["x"].alias("x"), (p["y"] * u).alias("y"))))

    return let(let(let(moved, spread), turned), mirrored)


def same_paths(marks: DataFrame) -> DataFrame:
    """(sig_a, sig_b): marks (sig_id, path) paired with the first whose path is the same but for an affine map.

    Canonical forms are compared in two grids, so that a coordinate on the border of one lies
    within a cell of the other.
    """
    rows = materialised(marks.select("sig_id", canonical_path(F.col("path")).alias("form")).where("form is not null"))
    pairs = []
    for shift in (0.0, 0.5):
        cells = F.transform("form", lambda p: F.struct(*(F.floor(p[c] / STEP + shift).alias(c) for c in ("x", "y"))))  # noqa: B023
        keyed = rows.select("sig_id", F.sha2(F.to_json(cells), 256).alias("key"))
        first = keyed.groupBy("key").agg(F.min("sig_id").alias("first"))
        pairs.append(keyed.join(first, "key").where("sig_id <> first").select(F.col("first").alias("sig_a"), F.col("sig_id").alias("sig_b")))
    return reduce(DataFrame.union, pairs).distinct()


def reading(level: Column, a: Column, b: Column) -> Column:
    """struct(reading, escalate) of an equal stream or equal pixels, by both marks' classes in any order; null for other levels."""
    low, high = F.least(a, b), F.greatest(a, b)
    kind, escalate = F.lit("unclassified"), F.lit(False)
    for (x, y), (name, look) in READINGS.items():
        kind, escalate = F.when((low == x) & (high == y), name).otherwise(kind), F.when((low == x) & (high == y), look).otherwise(escalate)
    benign = (a == BENIGN) | (b == BENIGN)
    found = F.struct(F.when(benign, "benign").otherwise(kind).alias("reading"), F.when(benign, False).otherwise(escalate).alias("escalate"))
    return F.when(level.isin("L0", "L1"), found)


def findings(marks: DataFrame, most_bits: int = 2, least_correlation: float = 0.99) -> DataFrame:
    """(level, sig_a, sig_b, class_a, class_b, reading, escalate, same_page_context) of all levels.

    ``marks`` has sig_id, v (64 values, a picture of 8 by 8), path (points x, y), class, and page_hash, a
    digest of what else is on the page. L0 and L1 pair a copy with the first of its class; only
    firsts go on to L2, whose hashes are those of the pictures' frequencies, and L3, the same path but
    for an affine map, of marks that are on no lower level together.
    """
    raw = materialised(firsts(marks.select("sig_id", "v"), F.col("v")))
    pix = materialised(firsts(raw.where("sig_id = first").drop("first"), pixels(F.col("v"))))
    copies = lambda df, name: df.where("sig_id <> first").select(F.lit(name).alias("level"), F.col("first").alias("sig_a"), F.col("sig_id").alias("sig_b"))
    rows = materialised(pix.where("sig_id = first").select("sig_id", dct_hash("v").alias("bits"), centred(F.col("v")).alias("z")))
    near = correlated(near_hashes(rows, most_bits), rows, least_correlation).select(F.lit("L2").alias("level"), "sig_a", "sig_b")
    lower = materialised(copies(raw, "L0").union(copies(pix, "L1")).union(near))
    paths = same_paths(marks.join(rows.select("sig_id"), "sig_id", "left_semi")).join(lower, ["sig_a", "sig_b"], "left_anti")
    found = lower.unionByName(paths.withColumn("level", F.lit("L3")))
    for s in ("a", "b"):
        found = found.join(marks.select(F.col("sig_id").alias(f"sig_{s}"), F.col("class").alias(f"class_{s}"), F.col("page_hash").alias(f"page_{s}")), f"sig_{s}")
    r = reading(F.col("level"), F.col("class_a"), F.col("class_b"))
    return found.withColumn("r", r).select("level", "sig_a", "sig_b", "class_a", "class_b", "r.reading", "r.escalate", (F.col("page_a") == F.col("page_b")).alias("same_page_context"))
