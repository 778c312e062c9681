"""Duplicate findings of every level, hooks by name, and merged sketches."""

import io
import itertools
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import duplicates, sketches
from inkwell.sources import archives, hooks


def affine(points, m, t):
    return np.asarray(points) @ np.asarray(m).T + np.asarray(t)


def test_near_hashes_with_hot_bands(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    bits = []
    for k in range(160):
        x = base[k % 4] if k % 3 else base[0] ^ (int(rng.integers(0, 2**40)) << 23)  # a third shares the lowest band
        for _ in range(int(rng.integers(0, 4))):
            x ^= 1 << int(rng.integers(0, 64))
        bits.append(x if x < 2**63 else x - 2**64)
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "sig_id long, bits long")
    want = {(i, j) for i, j in itertools.combinations(range(160), 2) if bin((bits[i] ^ bits[j]) & (2**64 - 1)).count("1") <= 2}
    for hot in (5, 1000):
        assert {tuple(r) for r in duplicates.near_hashes(df, 2, hot).collect()} == want


def test_dct_hash_against_a_loop(spark):
    rng = np.random.default_rng(2)
    pictures = rng.normal(size=(20, 64))
    got = {r["i"]: r["h"] for r in spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pictures)], "i long, v array<double>").select("i", duplicates.dct_hash("v").alias("h")).collect()}
    for i, p in enumerate(pictures):
        grid = p.reshape(8, 8)
        table = [sum(grid[r, c] * np.cos(np.pi * (2 * r + 1) * a / 16) * np.cos(np.pi * (2 * c + 1) * b / 16) for r in range(8) for c in range(8)) for a in range(8) for b in range(8)]
        want = int("".join("1" if t > np.median(table[1:]) else "0" for t in table), 2)
        assert got[i] % 2**64 == want


def test_paths_but_for_an_affine_map(spark):
    rng = np.random.default_rng(3)
    shapes = [rng.normal(size=(9, 2)) for _ in range(5)]
    rows = [(k, s) for k, s in enumerate(shapes)]
    rows += [(10 + k, affine(s, m, (k, -3.0))) for k, s in enumerate(shapes) for m in ([[2, 0.5], [-1, 3]],)]  # sheared and turned
    rows += [(20, affine(shapes[0], [[1, 0], [0, -1]], (5, 5))), (21, shapes[1] + rng.normal(scale=0.01, size=(9, 2)))]  # mirrored; nearly the same
    rows += [(30, np.column_stack([np.arange(9.0), 2 * np.arange(9.0)])), (31, np.column_stack([np.arange(9.0), 3 * np.arange(9.0)]))]  # on a line
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in rows], "sig_id long, path array<struct<x:double,y:double>>")
    assert sorted(map(tuple, duplicates.same_paths(df).collect())) == [(0, 10), (0, 20), (1, 11), (2, 12), (3, 13), (4, 14)]


def test_readings(spark):
    rows = [("L0", "scanned_wet_ink", "scanned_wet_ink"), ("L1", "scanned_wet_ink", "pasted_image"), ("L1", "pasted_image", "scanned_wet_ink"), ("L0", "pasted_image", "pasted_image"), ("L0", "crypto_signature", "scanned_wet_ink"), ("L0", "vector_ink", "crypto_signature"), ("L0", "vector_ink", "pasted_image"), ("L2", "pasted_image", "pasted_image")]
    df = spark.createDataFrame(rows, "level string, a string, b string")
    got = [r["r"] and tuple(r["r"]) for r in df.select(duplicates.reading(F.col("level"), F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [("anomalous", True), ("lifted", True), ("lifted", True), ("reused", False), ("benign", False), ("benign", False), ("unclassified", False), None]


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def test_extractor_by_a_column(spark):
    df = spark.createDataFrame([("a.zip", "zip", zipped(x="1", y="22")), ("b.zip", "zip", zipped(z="333"))], "rel_path string, kind string, content binary")
    whole = hooks.extracted(df)
    assert whole.columns == ["rel_path", "kind", "member", "status", "size_bytes", "content"]
    want = sorted((r["archive"], r["member"], r["size_bytes"], bytes(r["content"])) for r in archives.unpacked(df, 0, 100).collect())
    assert sorted((r["rel_path"], r["member"], r["size_bytes"], bytes(r["content"])) for r in whole.collect()) == want
    slim = hooks.extracted(df, with_content=False)
    assert slim.columns == ["rel_path", "kind", "member", "status", "size_bytes"] and slim.count() == 3
    hooks.register(spark)
    assert spark.sql("SELECT m.member FROM VALUES ('zip', X'00') AS a(kind, content), LATERAL extract_archive(a.kind, a.content, false, 10) m WHERE m.status = 'bad'").count() == 1


def test_unknown_names_are_errors(spark):
    df = spark.createDataFrame([("a", "arc", bytearray(b"x"))], "rel_path string, kind string, content binary")
    with pytest.raises(Exception, match="no extractor of the name 'arc'"):
        hooks.extracted(df).collect()
    pairs = spark.createDataFrame([("cosine", [1.0, 0.0], [1.0, 1.0]), ("odd", [1.0, 0.0], [1.0, 1.0])], "s string, a array<double>, b array<double>")
    first = pairs.where("s = 'cosine'")
    assert abs(first.select(hooks.scored(first, "s", "a", "b")).first()[0] - 0.5**0.5) < 1e-12
    with pytest.raises(Exception, match="no scorer of the name odd"):
        pairs.select(hooks.scored(pairs, "s", "a", "b")).collect()


def test_sketches_within_their_error(spark):
    rows = spark.range(60_000).selectExpr("id % 4 AS folder", "id % 2 AS half", "id % 9000 AS v")
    parts = sketches.distinct_sketches(rows, ["folder", "half"], "v")
    for r in sketches.estimates(parts, ["half"]).collect():
        exact = rows.where(F.col("half") == r["half"]).select("v").distinct().count()
        assert abs(r["n_distinct"] - exact) <= 5 * sketches.relative_error() * exact and r["n_rows"] == 30_000
    again = sketches.estimates(parts.unionByName(parts), ["half"])  # sketches of a part may come twice
    assert {r["half"]: r["n_distinct"] for r in again.collect()} == {r["half"]: r["n_distinct"] for r in sketches.estimates(parts, ["half"]).collect()}
