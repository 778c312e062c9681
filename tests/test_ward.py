"""Ward's clustering in rounds against the same in one task, and against a plain loop."""

import numpy as np
import pytest

from inkwell.operators import clusters, ward
from tests.test_operators import parted

SHAPE = "pdf long, sig_id long, v array<double>"


def marks_of(spark, groups):
    """Marks of (group, vectors); their ids don't follow their order."""
    rng = np.random.default_rng(0)
    rows, vectors, begin = [], {}, 0
    for pdf, x in groups:
        ids = begin + rng.permutation(len(x))
        begin += len(x)
        vectors[pdf] = dict(zip(ids.tolist(), x))
        rows += [(pdf, int(i), v.tolist()) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, SHAPE), vectors


def blobs(rng, n, centres, spread):
    middle = rng.normal(size=(centres, 6)) * 2
    return middle[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, 6))


@pytest.mark.parametrize("block", [12])
def test_rounds_equal_one_task(spark, block):
    rng = np.random.default_rng(1)
    groups = [(0, blobs(rng, 80, 5, 0.5)), (1, rng.normal(size=(40, 6))), (2, rng.normal(size=(3, 6))), (3, blobs(rng, 20, 2, 0.01)), (4, rng.normal(size=(1, 6)))]
    df, vectors = marks_of(spark, groups)
    got = ward.ward_labels(df, ["pdf"], 8, block).collect()
    for pdf, own in vectors.items():
        ids = sorted(own)
        cuts = clusters.ward_cuts(np.array([own[i] for i in ids]), 8)
        for k in range(2, min(8, len(ids)) + 1):
            labels = {r["sig_id"]: r["label"] for r in got if r["pdf"] == pdf and r["cut"] == k}
            want = dict(zip(ids, cuts[k])) if k in cuts else dict(zip(ids, range(len(ids))))
            assert parted(labels) == parted(want)
            assert all(label == min(i for i in labels if labels[i] == label) for label in labels.values())


def test_heights_are_wards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 5))
    df, vectors = marks_of(spark, [(0, x)])
    tree = ward.ward_tree(df, ["pdf"], 6).orderBy("d").collect()
    assert len(tree) == 19 and len({r["b"] for r in tree}) == 19 and all(r["a"] < r["b"] for r in tree)
    unit = {i: v / np.linalg.norm(v) for i, v in vectors[0].items()}
    groups = {i: [i] for i in unit}
    square = lambda a, b: np.mean([(1 - unit[i] @ unit[j]) ** 2 for i in a for j in b])
    for r in sorted(tree, key=lambda r: (r["step"], r["d"])):
        a, b = groups[r["a"]], groups.pop(r["b"])
        height = 2 * len(a) * len(b) / (len(a) + len(b)) * (square(a, b) - square(a, a) / 2 - square(b, b) / 2)
        assert abs(height - r["d"]) < 1e-9
        groups[r["a"]] = a + b


def test_equal_marks_in_rounds(spark):
    x = np.repeat(np.eye(6)[:3], 10, axis=0)
    df, vectors = marks_of(spark, [(0, x)])
    labels = {r["sig_id"]: r["label"] for r in ward.ward_labels(df, ["pdf"], 3, 10).collect() if r["cut"] == 3}
    assert parted(labels) == parted({i: v.argmax() for i, v in vectors[0].items()})


def test_clusters_beyond_a_block_are_those_within(spark):
    rng = np.random.default_rng(3)
    df, _ = marks_of(spark, [(0, blobs(rng, 50, 4, 0.4)), (1, blobs(rng, 12, 3, 0.2)), (2, rng.normal(size=(2, 6)))])
    whole, rounds = (sorted(map(tuple, clusters.hierarchical_clusters(df, ["pdf"], block_rows=b).collect())) for b in (1000, 15))
    assert [r[:3] for r in whole] == [r[:3] for r in rounds]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(whole, rounds))


def test_blocks_are_counted_by_key(spark):
    rng = np.random.default_rng(4)
    df, vectors = marks_of(spark, [(g, rng.normal(size=(n, 6))) for g, n in enumerate((30, 1, 7))])
    labelled = df.selectExpr("pdf", "sig_id", "v", "sig_id % 3 AS label")
    for r in clusters.silhouette(labelled, by=["pdf"]).collect():
        unit = {i: v / np.linalg.norm(v) for i, v in vectors[r["pdf"]].items()}
        far = {c: [1 - unit[r["sig_id"]] @ unit[i] for i in unit if i % 3 == c and i != r["sig_id"]] for c in {i % 3 for i in unit}}
        own, others = far[r["label"]], [np.mean(d) for c, d in far.items() if c != r["label"]]
        a, b = (np.mean(own) if own else None), min(others, default=None)
        assert abs(r["s"] - (0 if a is None or b is None else (b - a) / max(a, b))) < 1e-9
