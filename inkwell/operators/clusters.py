"""Clustering of marks into signers.

Order-dependent folds are rounds over a neighbour graph: a mark leads if no smaller mark in
reach leads, which a few joins settle for all marks at once. Distances to clusters come from
the clusters' sums. Ward's clustering of a group beyond a block is done in rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.operators.pairs import MOST_BLOCKS, block_cells, blocked_pairs, in_blocks, pairs_in_groups, sides, unit_vectors
from inkwell.operators.staging import discarded, leading_values, materialised
from inkwell.operators.ward import BLOCK_ROWS, ward_labels

#: What the adaptive clustering tries.
LEADER, SIMPLE, EPS, SAMPLES = 0.85, 0.8, (0.1, 0.15, 0.2, 0.25, 0.3), (2, 3)


def neighbours(marks: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """(keys, a, b, cosine) of pairs a < b of at least ``floor`` that share ``keys``, written."""
    if not keys:
        found = blocked_pairs(marks, floor).select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"), "cosine")
        return materialised(found)
    found = pairs_in_groups(marks, keys, {"cosine": (0, None)}, floor)
    return materialised(found.select(*keys, F.col("sig_a").alias("a"), F.col("sig_b").alias("b"), "cosine"))


def leading(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, sig_id): nodes that no smaller leading node reaches by an edge (by, a, b), a < b.

    A node without a smaller neighbour that is still open leads, and closes its neighbours;
    that is repeated until none is open.
    """
    open_, live, found = nodes.select(*by, "sig_id"), edges.select(*by, "a", "b"), None
    while True:
        waiting = live.select(*by, F.col("b").alias("sig_id")).distinct()
        new = materialised(open_.join(waiting, [*by, "sig_id"], "left_anti"))
        found = new if found is None else found.union(new)
        if not new.limit(1).count():
            return found
        shut = live.join(new.withColumnRenamed("sig_id", "a"), [*by, "a"], "left_semi").select(*by, F.col("b").alias("sig_id"))
        gone = materialised(new.union(shut).distinct())
        old = open_, live, gone
        open_ = materialised(open_.join(gone, [*by, "sig_id"], "left_anti"))
        for end in ("a", "b"):
            live = live.join(gone.withColumnRenamed("sig_id", end), [*by, end], "left_anti")
        live = materialised(live)
        discarded(*old)


def leader_labels(nodes: DataFrame, edges: DataFrame, by: list[str], assign: str = "last") -> DataFrame:
    """(by, sig_id, label): the id of the last or first leader in reach; a leader's is its own."""
    lead = materialised(leading(nodes, edges, by).withColumn("own", F.col("sig_id")))
    near = edges.select(*by, "a", F.col("b").alias("sig_id")).join(lead.select(*by, F.col("sig_id").alias("a")), [*by, "a"])
    near = near.groupBy(*by, "sig_id").agg((F.max if assign == "last" else F.min)("a").alias("near"))
    found = nodes.select(*by, "sig_id").join(lead, [*by, "sig_id"], "left").join(near, [*by, "sig_id"], "left")
    return found.select(*by, "sig_id", F.coalesce("own", "near").alias("label"))


def leader_clusters(marks: DataFrame, keys: list[str], threshold: float, assign: str = "last") -> DataFrame:
    """(keys, sig_id, label): label is the number of the last or first leader in reach, in id order, within ``keys``."""
    edges = neighbours(marks, keys, threshold)
    found = materialised(leader_labels(marks, edges, keys, assign))
    leads = found.where("sig_id = label").select(*keys, "label", (F.row_number().over(W.partitionBy(*keys).orderBy("label")) - 1).alias("number"))
    return found.join(leads, [*keys, "label"]).select(*keys, "sig_id", F.col("number").alias("label"))


def cluster_sums(marks: DataFrame, by: list[str], unit: bool = False) -> DataFrame:
    """(by, n, total): how many unit vectors a cluster has, and their sum; ``unit``: they are of that length already."""
    u = marks if unit else unit_vectors(marks)
    sums = u.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return sums.groupBy(*by).agg(F.max("n").alias("n"), total.alias("total"))


def confidence(marks: DataFrame, by: list[str]) -> DataFrame:
    """(by, confidence): mean cosine of all of a cluster's pairs, 0.5 for single members.

    The squared length of the summed unit vectors is their number plus twice the pairs' cosines.
    """
    square = F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x)
    pairs = F.col("n") * (F.col("n") - 1)
    return cluster_sums(marks, by).select(*by, F.when(F.col("n") > 1, (square - F.col("n")) / pairs).otherwise(0.5).alias("confidence"))


def silhouette(marks: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by, sig_id, label, a, b, s) with cosine distances; members of single clusters have s = 0.

    The mean cosine to a cluster is the product with its summed unit vectors, so that no
    pairs are made; blocks of marks meet blocks of clusters.
    """
    by = by or []
    u = unit_vectors(marks).select(*by, "sig_id", F.col(label).alias("label"), "v")
    sums = cluster_sums(u, [*by, "label"], unit=True)
    kinds = dict(u.dtypes)
    columns = [*by, "sig_id", "label"]

    def distances(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[columns].assign(a=np.nan, b=np.nan)
        if not len(left) or not len(right):
            return out
        v, n, total = np.array(left["v"].tolist()), right["n"].to_numpy(float), np.array(right["total"].tolist()).T
        label, labels = left["label"].to_numpy(), right["label"].to_numpy()
        a, b = np.full(len(v), -1.0), np.empty(len(v))
        for begin in range(0, len(v), 250):  # a table of a few MB at a time
            at = slice(begin, begin + 250)
            product = v[at] @ total
            i, j = np.nonzero(label[at, None] == labels[None])
            some = n[j] > 1
            i, j, own = i[some], j[some], (i, j)
            a[begin + i] = np.nan_to_num(1 - (product[i, j] - (v[begin + i] ** 2).sum(1)) / (n[j] - 1), nan=-1.0)
            far = 1 - product / n
            far[own] = np.inf
            b[at] = far.min(1)
        return out.assign(a=a, b=b)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", a double, b double"
    cells = in_blocks(u, materialised(sums), by, ("sig_id", "label"), distances, schema)
    # -1 and infinity stand for what a cell doesn't hold
    a, b = F.max(F.when(F.col("a") > -1, F.col("a"))), F.min(F.when(F.col("b") < float("inf"), F.col("b")))
    scored = cells.groupBy(*columns).agg(a.alias("a"), b.alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (top <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return scored.withColumn("s", s)


def density_clusters(marks: DataFrame, edges: DataFrame, min_samples, by: list[str] | None = None) -> DataFrame:
    """(by, sig_id, label): DBSCAN over neighbour graphs (by, a, b) without loops; label -1 is noise.

    A core mark has ``min_samples`` (a number, or a column of ``marks``) marks in
    reach, itself included. Components of core marks are named by their smallest id; border
    marks join the lowest in reach.
    """
    by = by or []
    need = F.lit(min_samples) if isinstance(min_samples, int) else F.col(min_samples)
    both = edges.select(*by, "a", "b").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = marks.withColumn("_need", need).select(*by, F.col("sig_id").alias("a"), "_need").join(both.groupBy(*by, "a").agg(F.count("*").alias("n")), [*by, "a"], "left")
    core = materialised(degree.where(F.coalesce("n", F.lit(0)) + 1 >= F.col("_need")).select(*by, "a"))
    inner = materialised(both.join(core, [*by, "a"], "left_semi").join(core.withColumnRenamed("a", "b"), [*by, "b"], "left_semi"))
    state = core.select(*by, "a", F.col("a").alias("root"))
    state = materialised(state)
    while True:
        step = inner.join(state.select(*by, F.col("a").alias("b"), F.col("root").alias("r")), [*by, "b"]).groupBy(*by, "a").agg(F.min("r").alias("r"))
        new = state.join(step, [*by, "a"], "left").select(*by, "a", F.least("root", F.coalesce("r", "root")).alias("root"))
        up = new.select(*by, F.col("a").alias("root"), F.col("root").alias("up"))
        jumped = materialised(new.join(up, [*by, "root"], "left").select(*by, "a", F.least("root", F.coalesce("up", "root")).alias("root")))
        moved = jumped.join(state.withColumnRenamed("root", "old"), [*by, "a"]).where("root <> old").limit(1).count()
        discarded(state)
        state = jumped
        if not moved:
            break
    border = both.join(state.withColumnRenamed("a", "b"), [*by, "b"]).groupBy(*by, "a").agg(F.min("root").alias("near"))
    found = marks.select(*by, F.col("sig_id").alias("a")).join(state, [*by, "a"], "left").join(border, [*by, "a"], "left")
    return found.select(*by, F.col("a").alias("sig_id"), F.coalesce("root", "near", F.lit(-1)).alias("label"))


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` after edges between ``a`` and ``b``: each component goes by its smallest place."""
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def blocked_density(marks: DataFrame, floor: float, min_samples: int, block_rows: int = 2000) -> DataFrame:
    """(sig_id, label): DBSCAN of all marks, those of a cosine of at least ``floor`` in reach, without a table of their pairs.

    Cells of blocks count what is in reach of a mark; cells of core marks send a forest each,
    at most a row for each of their marks, and border marks ask for the lowest label in reach.
    """

    def near(x, y, mask) -> np.ndarray:
        found = x.v @ y.v.T >= floor
        return found if mask is None else found & mask

    def degrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = pd.Series(dtype="int64")
        for x, y, mask in sides(batches):
            reach = near(x, y, mask)
            total = total.add(pd.Series(reach.sum(1), x.ids), fill_value=0).add(pd.Series(reach.sum(0), y.ids), fill_value=0)
        yield pd.DataFrame({"sig_id": total.index.to_numpy(np.int64), "n": total.to_numpy(np.int64)})

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = list(sides(batches))
        ids = np.unique(np.concatenate([m.ids for x, y, _ in cell for m in (x, y)]))
        root = np.arange(len(ids))
        for x, y, mask in cell:
            a, b = np.searchsorted(ids, x.ids), np.searchsorted(ids, y.ids)
            i, j = np.nonzero(near(x, y, mask) & (root[a][:, None] != root[b][None]))
            root = joined(root, a[i], b[j])
        own = root != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[root[own]], "b": ids[own]})

    def lowest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"sig_id": [], "near": []}).astype("int64")
        right = right.sort_values("root", ignore_index=True)
        x, y, found = np.array(left["v"].tolist()), np.array(right["v"].tolist()).T, []
        for i in range(0, len(x), 250):
            reach = x[i : i + 250] @ y >= floor
            some = reach.any(1)
            found.append(pd.DataFrame({"sig_id": left["sig_id"].to_numpy()[i : i + 250][some], "near": right["root"].to_numpy()[reach.argmax(1)[some]]}))
        return pd.concat(found)

    marks = materialised(marks.select(F.col("sig_id").cast("long").alias("sig_id"), "v"))
    reached = block_cells(marks, block_rows, "v", []).groupBy("lo", "hi").applyInPandas(degrees, "sig_id long, n long").groupBy("sig_id").agg(F.sum("n").alias("n"))
    core = materialised(reached.where(F.col("n") + 1 >= min_samples).select("sig_id"))
    inner = materialised(marks.join(core, "sig_id"))
    edges = materialised(block_cells(inner, block_rows, "v", []).groupBy("lo", "hi").applyInPandas(forest, "a long, b long"))
    roots = materialised(density_clusters(inner, edges, 1))
    outer = materialised(unit_vectors(marks.join(core, "sig_id", "left_anti")))
    found = marks.select("sig_id").join(roots, "sig_id", "left")
    rows = max(4000, math.ceil(max(outer.count(), inner.count()) / MOST_BLOCKS))
    named = unit_vectors(inner.join(roots, "sig_id")).select(F.col("sig_id").alias("core"), "v", F.col("label").alias("root"))
    border = in_blocks(outer, named, [], ("sig_id", "core"), lowest, "sig_id long, near long", rows).groupBy("sig_id").agg(F.min("near").alias("near"))
    return found.join(border, "sig_id", "left").select("sig_id", F.coalesce("label", "near", F.lit(-1)).alias("label"))


def ward_cuts(vectors: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """By number of clusters up to ``most``: labels of Ward's clustering on cosine distances, ties to the lowest pair."""
    n = len(vectors)
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, label, found = np.ones(n), np.arange(n), {}
    near = d.argmin(1)  # by row its nearest, the first of ties
    alive = np.ones(n, bool)
    for k in range(n, 1, -1):
        if k <= most:
            found[k] = np.unique(label, return_inverse=True)[1]
        best = np.where(alive, d[np.arange(n), near], np.inf)
        i = int(best.argmin())
        i, j = sorted((i, int(near[i])))
        s = size + size[i] + size[j]
        merged = np.sqrt(np.maximum(((size + size[i]) * d[i] ** 2 + (size + size[j]) * d[j] ** 2 - size * d[i, j] ** 2) / s, 0))
        alive[j] = False
        merged[~alive] = np.inf
        merged[i] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
        near[i] = d[i].argmin()
        for r in np.flatnonzero(alive & ((near == i) | (near == j) | (merged <= d[np.arange(n), near]))):
            near[r] = d[r].argmin()
    return found


def mean_silhouette(vectors: np.ndarray, labels: np.ndarray) -> float:
    """Of cosine distances; single clusters count 0."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    names, at, n = np.unique(labels, return_inverse=True, return_counts=True)
    sums = np.zeros((len(names), x.shape[1]))
    np.add.at(sums, at, x)
    product, rows = x @ sums.T, np.arange(len(x))
    a = 1 - (product[rows, at] - (x * x).sum(1)) / np.maximum(n[at] - 1, 1)
    other = 1 - product / n
    other[rows, at] = np.inf
    b = other.min(1)
    top = np.maximum(a, b)
    return float(np.where((n[at] > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def hierarchical_clusters(marks: DataFrame, keys: list[str], max_k: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, sig_id, label, score): Ward clusters of each group, the number of clusters by silhouette.

    Groups of at most ``block_rows`` marks are done by a task each, larger ones in rounds; both
    give the same clusters.
    """
    kinds = dict(marks.dtypes)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sig_id", ignore_index=True)
        x = np.array(part["v"].tolist())
        best = (-2.0, np.zeros(len(x), int))
        if len(x) == 2:
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            best = (0.0, np.array([0, 0 if unit[0] @ unit[1] >= 0.85 else 1]))
        cuts = ward_cuts(x, min(len(x) - 1, max_k)) if len(x) > 2 else {}
        for k, labels in sorted(cuts.items()):
            score = mean_silhouette(x, labels)
            if score > best[0] + 1e-12:
                best = (score, labels)
        return part[[*keys, "sig_id"]].assign(label=best[1].astype("int32"), score=float(max(best[0], -1.0)))

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "sig_id"]) + ", label int, score double"
    sizes = materialised(marks.groupBy(*keys).agg(F.count("*").alias("_n")))
    small = marks.join(sizes.where(F.col("_n") <= block_rows), keys, "left_semi")
    found = small.select(*keys, "sig_id", "v").groupBy(*keys).applyInPandas(block, schema)
    if not sizes.where(F.col("_n") > block_rows).limit(1).count():
        return found
    large = materialised(marks.join(sizes.where(F.col("_n") > block_rows), keys, "left_semi").select(*keys, "sig_id", "v"))
    cuts = materialised(ward_labels(large, keys, max_k, block_rows))
    judged = materialised(scored(cuts, large, keys, ["cut"]).withColumn("score", F.round("score", 12)))
    best = cuts.join(first_best(judged, keys, ["cut"]), [*keys, "cut"])
    numbers = best.select(*keys, "label").distinct().withColumn("_no", F.row_number().over(W.partitionBy(*keys).orderBy("label")) - 1)  # max_k rows a group
    own = best.join(numbers, [*keys, "label"]).select(*keys, F.col("sig_id").cast(kinds["sig_id"]).alias("sig_id"), F.col("_no").cast("int").alias("label"), "score")
    return found.unionByName(own)


def scored(labelled: DataFrame, marks: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """(keep, by, score, k): mean silhouette and clusters of label tables (keep, by, sig_id, label)."""
    keys = [*keep, *by]
    s = silhouette(labelled.join(marks.select("sig_id", "v"), "sig_id"), by=keys)
    return s.groupBy(*keys).agg(F.avg("s").alias("score"), F.countDistinct("label").alias("k"))


def first_best(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each group the row of the highest score above -1, the first in ``order`` where scores tie."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *order))
    return rows.where("score > -1").withColumn("_r", place).where("_r = 1").drop("_r")


def adaptive_clusters(marks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, sig_id, label, method): of hierarchical, leader and density clustering the best by silhouette.

    Chosen for each group of ``by`` (none: the whole corpus). Density clustering is tried with
    all of ``EPS`` and ``SAMPLES`` and judged without its noise. A method counts if it finds
    at least two clusters and fewer than marks; if none does, first leaders at ``SIMPLE`` are
    taken. One mark is one cluster, two are one from ``LEADER`` on.
    """
    by = by or ["_all"]
    whole = by == ["_all"]
    marks = materialised((marks.withColumn("_all", F.lit(0)) if whole else marks).select(*by, F.col("sig_id").cast("long").alias("sig_id"), "v"))
    edges = neighbours(marks, [] if whole else by, 1 - max(EPS))
    edges = edges.withColumn("_all", F.lit(0)) if whole else edges
    sizes = materialised(marks.groupBy(*by).agg(F.count("*").alias("n")))
    large = marks.join(sizes.where("n > 2"), by, "left_semi")
    labels = [leader_labels(large, edges.where(F.col("cosine") >= LEADER), by).withColumn("method", F.lit(1))]
    ward = hierarchical_clusters(large, by).drop("score")
    labels.append(ward.withColumn("label", F.col("label").cast("long")).withColumn("method", F.lit(0)))
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.lit(1 - e).alias("floor"), F.lit(m).alias("need")) for i, (e, m) in enumerate((e, m) for e in EPS for m in SAMPLES))))
    tried = large.select(*by, "sig_id", grid.alias("g")).select(*by, "sig_id", F.col("g.no").alias("no"), F.col("g.need").alias("need"))
    links = edges.withColumn("g", grid).where(F.col("cosine") >= F.col("g.floor") - 1e-12).select(*by, "a", "b", F.col("g.no").alias("no"))
    dense = materialised(density_clusters(tried, links, "need", [*by, "no"]))
    best = first_best(scored(dense.where("label >= 0"), large, [*by, "no"], []).where("k > 1"), by, ["no"]).select(*by, "no")
    own = large.select(*by, "sig_id", F.col("sig_id").alias("label")).join(best, by, "left_anti")
    labels.append(dense.join(best, [*by, "no"], "left_semi").select(*by, "sig_id", "label").unionByName(own).withColumn("method", F.lit(2)))
    every = labels[0].unionByName(labels[1]).unionByName(labels[2])
    every = materialised(every.select(*by, "sig_id", F.col("label").cast("long").alias("label"), "method"))
    valid = scored(every, large, by, ["method"]).join(sizes, by).where("k >= 2 and k < n")
    chosen = materialised(first_best(valid, by, ["method"]).select(*by, "method"))
    names = F.element_at(F.array(*map(F.lit, ("hierarchical", "threshold", "dbscan"))), F.col("method") + 1)
    found = every.join(chosen, [*by, "method"], "left_semi").select(*by, "sig_id", "label", names.alias("method"))
    simple = leader_labels(large.join(chosen, by, "left_anti"), edges.where(F.col("cosine") >= SIMPLE), by, "first").withColumn("method", F.lit("similarity"))
    few = marks.join(sizes.where("n <= 2"), by, "left_semi")
    few = leader_labels(few, edges.where(F.col("cosine") >= LEADER), by).withColumn("method", F.lit("few"))
    out = found.unionByName(simple).unionByName(few)
    return out.drop("_all") if whole else out


def two_level_clusters(marks: DataFrame) -> DataFrame:
    """(sig_id, level1, label, confidence): adaptive clusters, and again inside each of them.

    Confidence is 1.0 for a group of one mark, 0.8 for a group that was clustered again.
    """
    first = materialised(adaptive_clusters(marks).select("sig_id", F.col("label").alias("level1")))
    second = adaptive_clusters(marks.join(first, "sig_id"), ["level1"])
    alone = F.count("*").over(W.partitionBy("level1")) == 1
    return second.select("sig_id", "level1", "label", F.when(alone, 1.0).otherwise(0.8).alias("confidence"))


def signer_profiles(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n_signatures, n_documents, documents, representative, confidence) of clusters (sig_id, label).

    ``documents`` holds the first of their names, 500 characters at most.
    """
    rows = materialised(marks.join(labels.select("sig_id", "label"), "sig_id").select("sig_id", "pdf", "label", "v"))
    names = rows.select("label", "pdf").distinct().groupBy("label").agg(F.count("*").alias("n_documents"))
    first = leading_values(rows, ["label"], "pdf").select("label", F.substring(F.array_join("first", ","), 1, 500).alias("documents"))
    names = names.join(first, "label")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n_signatures"), F.min("sig_id").alias("representative"))
    return sizes.join(names, "label").join(confidence(rows, ["label"]), "label")


def numbered(label: Column, prefix: str = "Signer") -> Column:
    return F.format_string(prefix + "_%03d", label)
