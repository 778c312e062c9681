"""Near-duplicate vectors by a robust-pruned flat graph (operator 8).

Vectors of one label are compared by cosine in double precision. Equal vectors form a
class, of which one goes on. A label of more than ``SHARD`` classes is cut into cells around
centroids (k-means on a bounded sample of the label), a cell of many members into blocks;
each is a shard. Every class is a node of its own shard and of one of its second nearest
cell, so that shards overlap.

1. Each shard builds a flat graph by insertion: a node searches the graph so far, greedily
   from the medoid, and robust pruning picks its neighbours from what the search met.
2. A node's lists from all its shards are united.
3. Every class searches each shard in which something that links with it can have its
   place: the own cell, and all cells whose border with the own cell is no farther than a
   link is long (a bound that is exact, see ``reachable``), with all their blocks. The search
   is greedy from the shard's medoid with a beam, then expands over all nodes in range
   until none is new; what it finds is verified. A link counts in the other's own shard, so
   that counts add up without writing pairs.
4. A sample of each task's searches is audited against a scan of the shard; where one misses
   anything, all of that task's searches are scans.

Defined cases: a vector that is null, empty, zero or has a null or non-finite component, or
has no label, links with nothing and is kept; vectors of unequal length never link; rows
that repeat an id with one vector count each, with several vectors they share their
component; a group of near copies larger than a shard is dealt to blocks, each of which
all its members search; a null id takes no part (component null, kept); with no rows there
are none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import components, join_salted, map_arrow, written

#: Classes of a cell, about; nodes of a block and queries of a task at most, about.
SHARD, BLOCK, QUERIES = 8000, 16_000, 8000
#: Centroids of a label at most (beyond, cells grow and fall into more blocks); sample rows for each.
MAX_CELLS, SAMPLE = 2048, 16
#: Rows that are placed in one task, about.
PLACED = 5000
DEGREE, ALPHA, BEAM, POOL = 16, 1.2, 32, 64
#: Searches leave the range by so much cosine, so that in-range nodes stay connected.
SLACK = 0.06
AUDIT, BATCH = 64, 128


def unit(values: np.ndarray) -> np.ndarray:
    return values / np.linalg.norm(values, axis=-1, keepdims=True)


def usable(vector) -> bytes | None:
    """The vector's doubles as bytes; None where it links with nothing."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    if not 1e-100 < top < 1e100:
        v = np.ldexp(v, -np.frexp(top)[1])  # by a power of two: squares neither vanish nor overflow
    return (v + 0.0).tobytes()  # -0.0 and 0.0 are one value


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dims, key, values) of every row; key and values are null where nothing links.

    The key is a digest of label and vector: rows of one key are one class.
    """

    def step(batches):
        for batch in batches:
            labels = batch.column(1).to_pylist()
            raw = [None if label is None else usable(v) for v, label in zip(batch.column(2).to_pylist(), labels, strict=True)]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16, key=hashlib.sha256(label.encode()).digest()).digest() for r, label in zip(raw, labels, strict=True)]
            dims = pa.array([0 if r is None else len(r) // 8 for r in raw], pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), dims, pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dims", "key", "values"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(rows, step, "vec_id long, label string, dims int, key binary, values binary")


def matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values)).reshape(len(values), -1)


def centroids_of(sample: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        for at in range(0, len(sample), 4096):
            part = sample[at : at + 4096]
            np.add.at(sums, (part @ centres.T).argmax(1), part)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def reachable(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By unit vector: its nearest cell, the second one, and a row of booleans over the cells it must search.

    A vector v of cell j has v.j >= v.h for every other centroid h. If u links with v they
    lie at most d = sqrt(2 - 2 threshold) apart, so that u.j >= u.h - d |j - h| for u's own h:
    no other cell can hold a link.
    """
    sims = x @ centres.T
    home = sims.argmax(1)
    best = sims[np.arange(len(x)), home]
    square = (centres**2).sum(1)
    apart = np.sqrt(np.maximum(square[home][:, None] + square[None] - 2 * centres[home] @ centres.T, 0.0))
    reach = best[:, None] - sims <= math.sqrt(max(2 - 2 * threshold, 0.0)) * apart + 1e-9
    sims[np.arange(len(x)), home] = -np.inf
    return home, sims.argmax(1) if len(centres) > 1 else home, reach


def placed(firsts: DataFrame, threshold: float) -> DataFrame:
    """(label, dims, node, rep, n, values, near, reach): the cells of each class as a node, and those it searches."""
    sizes = firsts.groupBy("label", "dims").count().where(F.col("count") > SHARD)
    sizes = written(sizes.select("label", "dims", "count", F.least(F.lit(MAX_CELLS), F.ceil(F.col("count") / SHARD)).cast("int").alias("k")), "labels")
    place = "label string, dims int, node long, rep long, n long, values binary, near array<int>, reach array<int>"
    small = firsts.join(sizes, ["label", "dims"], "left_anti")
    small = small.select("label", "dims", "node", "rep", "n", "values", F.array(F.lit(0)).alias("near"), F.array(F.lit(0)).alias("reach"))
    if not sizes.limit(1).count():
        return small
    large = firsts.join(sizes, ["label", "dims"])
    draw = F.shiftrightunsigned(F.xxhash64("node", F.lit(5)), 11) / F.lit(float(2**53))
    sample = large.where(draw < F.col("k") * SAMPLE / F.col("count"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        centres = centroids_of(unit(matrix(list(part["values"]))), int(part["k"].iloc[0]), 11)
        return pd.DataFrame({"label": part["label"].iloc[0], "dims": part["dims"].iloc[0], "cell": range(len(centres)), "centre": [c.tobytes() for c in centres]})

    centres = written(sample.groupBy("label", "dims").applyInPandas(fit, "label string, dims int, cell int, centre binary"), "centres")
    parts = F.ceil(F.col("count") / PLACED).cast("int")
    rows = large.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")).drop("k", "count")
    dealt = centres.join(sizes, ["label", "dims"]).select(*(F.col(c).alias(c) for c in ("label", "dims", "cell", "centre")), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    def locate(part: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        out = part[["label", "dims", "node", "rep", "n", "values"]]
        if not len(part):
            return out.assign(near=[], reach=[])
        # a label whose sample came out empty is one cell
        c = matrix(list(centres.sort_values("cell")["centre"])) if len(centres) else np.zeros((1, int(part["dims"].iloc[0])))
        near, reach = [], []
        for at in range(0, len(part), 1024):
            home, second, cells = reachable(unit(matrix(list(part["values"].iloc[at : at + 1024]))), c, threshold)
            near += [[int(a), int(b)] if a != b else [int(a)] for a, b in zip(home, second, strict=True)]
            reach += [np.flatnonzero(r).tolist() for r in cells]
        return out.assign(near=near, reach=reach)

    keys = ["label", "dims", "part"]
    return small.unionByName(rows.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(locate, place))


def sharded(firsts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (shard, node, rep, n, own, values) and queries (shard, node, rep, values).

    ``own``: the shard that a class counts in. A node has one row for each of its cells, a
    query one for each block of every cell in reach.
    """
    where = written(placed(firsts, threshold), "placed")
    cell = F.concat_ws("/", "dims", "cell", "label")
    nodes = where.select("label", "dims", "node", "rep", "n", "values", F.posexplode("near").alias("rank", "cell")).withColumn("cell", cell)
    blocks = nodes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = written(blocks, "blocks")
    shard = F.concat_ws("/", "block", "cell").alias("shard")
    nodes = join_salted(nodes, blocks, "cell", "node", "inner").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")))
    nodes = nodes.select(shard, "node", "rep", "n", (F.col("rank") == 0).alias("own"), "values")
    asked = where.select("label", "dims", "node", "rep", "values", F.explode("reach").alias("cell")).withColumn("cell", cell)
    asked = join_salted(asked, blocks, "cell", "node", "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return written(nodes, "nodes"), asked.select(shard, "node", "rep", "values")


class Flat:
    """A flat graph over unit vectors; ``lists`` has the neighbours of each row, -1 where there is none."""

    def __init__(self, x: np.ndarray, lists: np.ndarray):
        self.x, self.lists = x, lists
        self.medoid = int((x @ x.mean(0)).argmax()) if len(x) else 0

    def beam(self, q: np.ndarray, width: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy search for rows of ``q``: numbers and cosines of the best ``width`` nodes met (-1: none), and all that were met."""
        b, x = len(q), self.x
        met = np.zeros((b, len(x)), bool)
        ids, sims = np.full((b, width), -1), np.full((b, width), -np.inf)
        ids[:, 0], sims[:, 0] = start, q @ x[start]
        met[:, start] = True
        open_ = ids >= 0
        rows = np.arange(b)
        while len(rows):
            # the best unopened node of each query that has one
            at = np.where(open_[rows], sims[rows], -np.inf).argmax(1)
            live = open_[rows, at]
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            open_[rows, at] = False
            near = self.lists[ids[rows, at]]
            fresh = (near >= 0) & ~met[rows[:, None], near]
            met[np.broadcast_to(rows[:, None], near.shape)[fresh], near[fresh]] = True
            new = np.where(fresh, np.einsum("brd,bd->br", x[near], q[rows]), -np.inf)
            both_ids, both_sims = np.hstack([ids[rows], np.where(fresh, near, -1)]), np.hstack([sims[rows], new])
            both_open = np.hstack([open_[rows], fresh])
            best = np.argpartition(-both_sims, width - 1, axis=1)[:, :width]
            ids[rows], sims[rows], open_[rows] = (np.take_along_axis(v, best, 1) for v in (both_ids, both_sims, both_open))
        return ids, sims, met

    def pruned(self, p: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """Neighbours of rows ``p`` from a pool (-1: none): the nearest first, unless a nearer one covers it."""
        x = self.x
        pool = np.where(pool == p[:, None], -1, pool)
        sims = np.where(pool >= 0, np.einsum("bcd,bd->bc", x[pool], x[p]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :POOL]
        pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
        alive, far = pool >= 0, 1 - sims
        y = x[pool]
        found, taken = np.full((len(p), DEGREE), -1), np.zeros(len(p), int)
        for i in range(pool.shape[1]):
            keep = np.flatnonzero(alive[:, i] & (taken < DEGREE))
            if not len(keep):
                continue
            found[keep, taken[keep]] = pool[keep, i]
            taken[keep] += 1
            between = 1 - np.einsum("bcd,bd->bc", y[keep], y[keep, i])
            alive[keep] &= (ALPHA * between > far[keep]) & (np.arange(pool.shape[1]) > i)
        return found


def built(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Neighbour lists of all rows, inserted in ``order`` by batches that double."""
    graph = Flat(x, np.full((len(x), DEGREE), -1))
    order = np.concatenate([[graph.medoid], order[order != graph.medoid]]).astype(int)
    at, size = 1, 1
    while at < len(order):
        p = order[at : at + size]
        pool = graph.beam(x[p], BEAM, graph.medoid)[0]
        if len(p) > 1:  # members of one batch don't find each other in the graph
            sims = x[p] @ x[p].T
            np.fill_diagonal(sims, -np.inf)
            k = min(DEGREE, len(p) - 1)
            pool = np.hstack([pool, p[np.argpartition(-sims, k - 1, axis=1)[:, :k]]])
        found = graph.pruned(p, pool)
        graph.lists[p] = found
        # the way back: each new neighbour hears of the node, and prunes if it has no room
        back, source = found[found >= 0], np.broadcast_to(p[:, None], found.shape)[found >= 0]
        by = np.lexsort((source, back))
        back, source = back[by], source[by]
        hubs, first, n = np.unique(back, return_index=True, return_counts=True)
        for lo in range(0, len(hubs), BATCH):
            h, f, c = hubs[lo : lo + BATCH], first[lo : lo + BATCH], n[lo : lo + BATCH]
            wide = np.full((len(h), int(c.max())), -1)
            for r, (a, k) in enumerate(zip(f, c, strict=True)):
                wide[r, :k] = source[a : a + k]
            known = (wide[:, :, None] == graph.lists[h][:, None, :]).any(2)
            pool = np.hstack([graph.lists[h], np.where(known, -1, wide)])
            full = (pool >= 0).sum(1) > DEGREE
            packed = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
            if full.any():
                packed[full] = graph.pruned(h[full], pool[full])
            graph.lists[h] = packed
        at += len(p)
        size = min(2 * size, BATCH)
    return graph.lists


def build_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """(node, near): neighbour lists of one shard."""
    shard = shard.sort_values("node", ignore_index=True)
    nodes = shard["node"].to_numpy()
    lists = built(unit(matrix(list(shard["values"]))), np.random.default_rng(len(nodes)).permutation(len(nodes)))
    return pd.DataFrame({"node": nodes, "near": [nodes[near[near >= 0]].tolist() for near in lists]})


def in_range(graph: Flat, q: np.ndarray, own: np.ndarray, floor: float) -> np.ndarray:
    """Booleans (query, node): nodes found whose cosine reaches ``floor``, from a beam search and expansion.

    ``own``: the query's number where it is a node as well, else -1.
    """
    x, b, m = graph.x, len(q), len(graph.x)
    ids, sims, _ = graph.beam(q, BEAM, graph.medoid)
    found, tested = np.zeros((b, m), bool), np.zeros((b, m), bool)
    r, c = np.nonzero((ids >= 0) & (sims >= floor))
    found[r, ids[r, c]] = True
    known = np.flatnonzero(own >= 0)
    found[known, own[known]] = True
    tested |= found
    r, j = np.nonzero(found)
    product = None
    while len(r):
        near = graph.lists[j]
        new = np.zeros((b, m), bool)
        ok = near >= 0
        new[np.broadcast_to(r[:, None], near.shape)[ok], near[ok]] = True
        new &= ~tested
        tested |= new
        r, j = np.nonzero(new)
        if product is None and 8 * len(r) > b * m:  # the range covers much of the shard: one product is less work
            product = q @ x.T
        keep = (np.einsum("pd,pd->p", x[j], q[r]) if product is None else product[r, j]) >= floor
        r, j = r[keep], j[keep]
        found[r, j] = True
    return found


def search_shard(nodes: pd.DataFrame, asked: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(node, links, a, b): links of a query that count here, and (a, b) ids that links join, null for none."""
    out = {"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
    if not len(nodes) or not len(asked):
        return pd.DataFrame(out)
    nodes, asked = nodes.sort_values("node", ignore_index=True), asked.sort_values("node", ignore_index=True)
    raw, wanted = matrix(list(nodes["values"])), matrix(list(asked["values"]))
    norms, lengths = np.linalg.norm(raw, axis=1), np.linalg.norm(wanted, axis=1)
    names = nodes["node"].to_numpy()
    number = pd.Series(np.arange(len(names)), index=names)
    width = max(1, max(map(len, nodes["near"])))
    lists = np.full((len(names), width), -1)
    for i, near in enumerate(nodes["near"]):
        here = number.reindex(near).dropna().to_numpy(int)
        lists[i, : len(here)] = here
    graph = Flat(raw / norms[:, None], lists)
    own = number.reindex(asked["node"]).fillna(-1).to_numpy(int)
    counted = np.where(nodes["own"].to_numpy(bool), nodes["n"].to_numpy(np.int64), 0)

    def scanned(rows: np.ndarray) -> np.ndarray:
        near = (wanted[rows] @ raw.T) / (lengths[rows, None] * norms) >= threshold
        near[np.flatnonzero(own[rows] >= 0), own[rows][own[rows] >= 0]] = False
        return near

    def searched(rows: np.ndarray) -> np.ndarray:
        near = in_range(graph, wanted[rows] / lengths[rows, None], own[rows], threshold - SLACK)
        if 8 * near.sum() > near.size:  # the verification
            near &= (wanted[rows] @ raw.T) / (lengths[rows, None] * norms) >= threshold
        else:
            i, k = np.nonzero(near)
            near[i, k] = np.einsum("pd,pd->p", wanted[rows[i]], raw[k]) / (lengths[rows[i]] * norms[k]) >= threshold
        near[np.flatnonzero(own[rows] >= 0), own[rows][own[rows] >= 0]] = False
        return near

    links, root, first = np.zeros(len(asked), np.int64), np.arange(len(names)), np.full(len(asked), -1)

    def settle(find) -> None:
        for at in range(0, len(asked), BATCH):
            rows = np.arange(at, min(at + BATCH, len(asked)))
            near = find(rows)
            links[rows] = near @ counted
            for i in rows[near.any(1)]:
                ends = near[i - at]
                tops = np.unique(root[ends])
                if len(tops) > 1:
                    root[np.isin(root, tops)] = tops[0]
                first[i] = np.flatnonzero(ends)[0]

    settle(searched)
    # half of the sample are searches that found something: their surroundings are where links are missed
    some = np.flatnonzero(first >= 0)
    pick = lambda rows: rows[np.unique(np.linspace(0, len(rows) - 1, min(AUDIT // 2, len(rows))).astype(int))] if len(rows) else rows
    sample = np.union1d(pick(some), pick(np.arange(len(asked))))
    if ((scanned(sample) @ counted) > links[sample]).any():
        settle(scanned)
    reps, ids = nodes["rep"].to_numpy(), asked["rep"].to_numpy()
    joined = np.flatnonzero(root != np.arange(len(names)))
    ends = np.where(first >= 0, reps[root[np.maximum(first, 0)]], ids)
    none = np.zeros(len(joined), np.int64)
    return pd.DataFrame({"node": np.append(asked["node"].to_numpy(), names[joined]), "links": np.append(links, none), "a": np.append(ids, reps[joined]), "b": np.append(ends, reps[root[joined]])})


def vector_dedup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = written(keyed(vectors), "vectors")
    known = rows.where("key is not null and vec_id is not null")
    classes = written(known.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    firsts = known.join(classes, (known.key == classes.key) & (known.vec_id == classes.rep)).select(known.key, "label", "dims", "rep", "n", "values")
    firsts = firsts.dropDuplicates(["key", "rep"]).withColumn("node", F.xxhash64("key"))
    nodes, asked = sharded(firsts, threshold)
    lists = nodes.groupBy("shard").applyInPandas(build_shard, "node long, near array<long>")
    united = written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    asked = written(asked, "queries")
    parts = written(asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "parts")
    graph = nodes.join(united, "node").join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = join_salted(asked, parts, "shard", "node", "inner").withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")).cast("int"))
    cells = graph.select("shard", "part", "node", "rep", "n", "own", "values", "near").groupBy("shard", "part").cogroup(dealt.select("shard", "part", "node", "rep", "values").groupBy("shard", "part"))
    found = written(cells.applyInPandas(lambda n, q: search_shard(n, q, threshold), "node long, links long, a long, b long"), "found")
    joined = components(found.where("a <> b").select("a", "b"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = classes.withColumn("node", F.xxhash64("key")).join(counted, "node", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    groups = written(groups.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "groups")
    out = join_salted(rows.select("vec_id", "key"), groups, "key", "vec_id")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit_recall(vectors: DataFrame, threshold: float = 0.98, every: int = 50) -> float:
    """Share of brute-force links found, for the vectors whose id ``every`` divides.

    The stated queries are dealt out in blocks against all rows; only counts are returned.
    """
    rows = keyed(vectors).where("key is not null and vec_id is not null").select("vec_id", "label", "dims", "values")
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16)))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "n": []}).astype("int64")
        q, x = matrix(list(left["values"])), matrix(list(right["values"]))
        near = (q @ x.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)) >= threshold
        near &= left["vec_id"].to_numpy()[:, None] != right["vec_id"].to_numpy()[None]
        return pd.DataFrame({"vec_id": left["vec_id"], "n": near.sum(1)}).astype("int64")

    parts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part")
    left = asked.select("*", parts).groupBy("label", "dims", "part")
    exact = left.cogroup(dealt.groupBy("label", "dims", "part")).applyInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    both = exact.join(vector_dedup(vectors, threshold), "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return 1.0 if not both[0] else both[1] / both[0]
