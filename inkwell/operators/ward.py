"""Ward's clustering of groups of any size, by reciprocal nearest neighbours in rounds.

Ward's distance of two clusters follows from the mean squared distance of their marks, within
and between. A squared cosine distance is 1 - 2 u.w + (u.w)^2, so that its sum over all pairs
of two clusters is a product of what each cluster knows of itself: its size, the sum of its
unit vectors and the sum of their outer products. No table of distances is kept or
updated; blocks of clusters meet in matrix products.

A round finds each cluster's nearest one and merges those that are each other's. Ward's
distance is reducible: such pairs merge in any order of merging, so that the rounds give the
tree that merging the nearest pair of all, one after the other, gives. Where no more than
``LAST`` blocks of a group's clusters are left, one task merges the rest.

A cluster goes by its smallest mark, so that every mark but a group's smallest is merged into a
smaller one exactly once: the tree is a pointer and a height for each mark. The highest
merges are cut; each mark's cluster is where its pointers end.

A cluster's nearest one stays so until it is merged itself, as what others merge into comes no
nearer; a round asks only for clusters whose nearest one is gone. Equal vectors are merged
first, without a round. Clusters of few marks keep the marks' unit vectors, others the sums of
outer products, of d (d + 1) / 2 numbers each for vectors of length d.

The mean of the squares of some products is no less than the square of their mean. So the
product of two clusters' mean vectors bounds their distance from below, and a cluster's nearest
one is among the few whose bound is not above the least distance found; only these are compared
in full. Bounds are taken in single precision with room for its error, distances in double.

A group falls into at most ``MOST_BLOCKS`` blocks, so that what is sent grows with the group, not
with its square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.operators.pairs import unit_vectors
from inkwell.operators.staging import discarded, materialised

BLOCK_ROWS = 2000
#: Parts of a group whose highest merges are found apart.
PARTS = 64
#: A cluster of so many marks at most keeps their unit vectors.
MEMBERS = 32
#: Blocks of a group at most; up to ``SPREAD`` blocks hold ``BLOCK_ROWS`` clusters, more of them ``WIDE``. Blocks of clusters that one task merges to the end.
MOST_BLOCKS, SPREAD, WIDE, LAST = 16, 8, 10_000, 4
STATE = "id long, n long, within double, w array<double>, s array<double>, m array<double>"
#: What a product of two marks costs, in products of single numbers.
PRODUCT = 100
#: Rows and columns of a table of bounds that are made at a time; pairs that are compared in full at a time.
ROWS, COLUMNS, COMPARED = 256, 4096, 4000
#: Room for the error of single precision, in a product of unit vectors and in a squared distance.
ROOM, SQUARE_ROOM = 4e-6, 5e-7


def outer_products(v: np.ndarray) -> np.ndarray:
    """Each row's outer product as its upper triangle, weighted so that products of rows are those of whole matrices."""
    i, j = np.triu_indices(v.shape[1])
    return v[:, i] * v[:, j] * np.where(i == j, 1.0, np.sqrt(2.0))


def stretches(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of stretches of ``size`` from ``starts``, one after the other, and where each begins among them."""
    begins = np.cumsum(size) - size
    return np.repeat(starts - begins, size) + np.arange(size.sum()), begins


class Clusters:
    """Ids in order, sizes, mean squared distances within (halved), sums of vectors, and what gives those of outer products."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("id")
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        size = rows["n"].to_numpy()
        self.id, self.n = rows["id"].to_numpy(), size.astype(float)
        self.half = rows["within"].to_numpy() / self.n**2 / 2
        self.few = rows["m"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        w, s = flat("w"), flat("s")
        dims = len(w) // size[self.few].sum() if self.few.any() else len(s) // len(size)
        self.u, self.m = w.reshape(-1, dims), flat("m").reshape(-1, dims * (dims + 1) // 2)
        # where a cluster's marks begin, or its sums stand
        self.size = np.where(self.few, size, 1)
        self.at = np.where(self.few, np.cumsum(np.where(self.few, size, 0)) - size, np.cumsum(~self.few) - 1)
        self.starts = self.at[self.few]
        self.s = np.empty((len(size), dims))
        self.s[self.few] = self.added(self.u)
        self.s[~self.few] = s.reshape(-1, dims)

    def added(self, x: np.ndarray, axis: int = 0) -> np.ndarray:
        """Marks' rows or columns added up by cluster of few marks."""
        return x if len(self.starts) == x.shape[axis] else np.add.reduceat(x, self.starts, axis)

    def marks(self, i: int) -> np.ndarray:
        return self.u[self.at[i] : self.at[i] + self.size[i]]

    def outer(self, i: int) -> np.ndarray:
        """The sum of a cluster's outer products."""
        return outer_products(self.marks(i)).sum(0) if self.few[i] else self.m[self.at[i]]

    def full(self, i: int) -> np.ndarray:
        """The same of a cluster of many marks, as a matrix."""
        dims = self.s.shape[1]
        found, (a, b) = np.empty((dims, dims)), np.triu_indices(dims)
        found[a, b] = found[b, a] = self.m[self.at[i]] / np.where(a == b, 1.0, np.sqrt(2.0))
        return found

    def squares(self, other: Clusters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sums of squared products of the marks of the clusters ``i`` with those of another block's ``j``; ``i`` ascends."""
        found = np.empty(len(i))
        single = (self.n[i] == 1) & self.few[i] & other.few[j]
        if single.any():
            places, begins = stretches(other.at[j[single]], other.size[j[single]])
            p = np.einsum("ij,ij->i", self.u[np.repeat(self.at[i[single]], other.size[j[single]])], other.u[places])
            found[single] = np.add.reduceat(p * p, begins)
        rest = np.flatnonzero(~single)
        for row in np.split(rest, np.flatnonzero(np.diff(i[rest])) + 1) if len(rest) else ():
            x, few = i[row[0]], other.few[j[row]]
            if few.any():
                places, begins = stretches(other.at[j[row[few]]], other.size[j[row[few]]])
                w = other.u[places]
                p = (w @ self.marks(x).T) ** 2 if self.few[x] else (w @ self.full(x)) * w
                found[row[few]] = np.add.reduceat(p.sum(1), begins)
            if not few.all():
                found[row[~few]] = other.m[other.at[j[row[~few]]]] @ self.outer(x)
        return found

    def compared(self, other: Clusters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared Ward distances of the clusters ``i`` to another block's ``j``; ``i`` ascends."""
        found = np.empty(len(i))
        for begin in range(0, len(i), COMPARED):
            at = slice(begin, begin + COMPARED)
            a, b = i[at], j[at]
            n, k = self.n[a], other.n[b]
            d = self.squares(other, a, b) - 2 * np.einsum("ij,ij->i", self.s[a], other.s[b])
            found[at] = (d / (n * k) + 1 - self.half[a] - other.half[b]) * 2 * n * k / (n + k)
        return np.maximum(found, 0.0)

    def nearest(self, other: Clusters) -> tuple[np.ndarray, np.ndarray]:
        """Each cluster's least squared Ward distance to another block's, itself left out, and the id of that one, the smallest of ties; infinite without any."""
        mean, means = ((z.s / z.n[:, None]).astype(np.float32) for z in (self, other))
        sizes, halves = (1 / other.n / 2).astype(np.float32), other.half.astype(np.float32)
        own = np.minimum(np.searchsorted(other.id, self.id), len(other.id) - 1)
        best, ids = np.full(len(self.id), np.inf), np.full(len(self.id), -1)
        table = np.empty((ROWS, len(other.id)), np.float32)
        part, part_size = (np.empty((ROWS, COLUMNS), np.float32) for _ in range(2))
        for begin in range(0, len(self.id), ROWS):
            rows = np.arange(begin, min(begin + ROWS, len(self.id)))
            bound, of = table[: len(rows)], np.arange(len(rows))
            half = (self.half[rows] + SQUARE_ROOM).astype(np.float32)[:, None]
            size = (1 / self.n[rows] / 2).astype(np.float32)[:, None]
            for first in range(0, len(other.id), COLUMNS):
                at = slice(first, min(first + COLUMNS, len(other.id)))
                d, f = (x.ravel()[: len(rows) * (at.stop - first)].reshape(len(rows), -1) for x in (part, part_size))
                np.matmul(mean[rows], means[at].T, out=d)
                np.subtract(np.float32(1 - ROOM), d, out=d)
                np.multiply(d, d, out=d)
                np.subtract(d, halves[at], out=d)
                np.subtract(d, half, out=d)
                np.divide(d, np.add(size, sizes[at], out=f), out=bound[:, at])
            same = other.id[own[rows]] == self.id[rows]
            bound[of[same], own[rows][same]] = np.inf
            low = bound.argmin(1)
            some = np.isfinite(bound[of, low])
            rows, of, low = rows[some], of[some], low[some]
            least = np.full(len(bound), -np.inf)
            least[some] = d = self.compared(other, rows, low)
            bound[of, low] = np.inf
            i, j = np.divmod(np.flatnonzero(bound <= np.nextafter(least.astype(np.float32), np.float32(np.inf))[:, None]), len(other.id))
            i, j, d = np.append(of, i), np.append(low, j), np.append(d, self.compared(other, begin + i, j))
            order = np.lexsort((j, d, i))
            order = order[np.unique(i[order], return_index=True)[1]]
            best[begin + i[order]], ids[begin + i[order]] = d[order], other.id[j[order]]
        return best, ids

    def distances(self) -> np.ndarray:
        """Squared Ward distances of all clusters to all."""
        count, dims = self.s.shape
        found, ends = np.empty((count, count)), np.append(self.starts, len(self.u))
        if by_mark := self.few.all() and len(self.u) ** 2 * PRODUCT < count**2 * dims * (dims + 1) // 2:
            step = max(1, ROWS * count // len(self.u))
        else:
            step, sums = ROWS, np.array([self.outer(i) for i in range(count)])
        for i in range(0, count, step):
            j = min(i + step, count)
            d = found[i:j]
            if by_mark:
                p = self.u[ends[i] : ends[j]] @ self.u.T
                d[:] = self.added(np.add.reduceat(np.multiply(p, p, out=p), ends[i:j] - ends[i], 0), 1)
            else:
                np.matmul(sums[i:j], sums.T, out=d)
            n, k = self.n[i:j, None], self.n[None]
            d -= 2 * self.s[i:j] @ self.s.T
            d /= n * k
            d += 1 - self.half[i:j, None]
            d -= self.half[None]
            d *= 2 * n * k / (n + k)
            np.maximum(d, 0.0, out=d)
        return found


def symmetric(d: np.ndarray) -> np.ndarray:
    """The lesser of each two entries in both, in place; the diagonal is infinite."""
    for i in range(0, len(d), ROWS):
        at = slice(i, i + ROWS)
        d[at, i:] = np.minimum(d[at, i:], d[i:, at].T)
        d[i:, at] = d[at, i:].T
    np.fill_diagonal(d, np.inf)
    return d


def key_schema(clusters: DataFrame, keys: list[str]) -> str:
    kinds = dict(clusters.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def started(marks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clusters (keys, id, n, within, w, s, m) of equal unit vectors, and their merges (keys, b, a, d, step); both written."""
    u = materialised(unit_vectors(marks).select(*keys, F.col("sig_id").cast("long").alias("id"), "v"))
    same = materialised(u.groupBy(*keys, "v").agg(F.min("id").alias("id"), F.count("*").alias("n")))

    def step(batches):
        for batch in batches:
            rows = []
            for v, n in zip(batch["v"], batch["n"], strict=True):
                many = n > MEMBERS
                rows.append((n * n * (1 - v @ v) ** 2, None if many else np.tile(v, n), n * v if many else None, n * outer_products(v[None])[0] if many else None))
            yield batch[[*keys, "id", "n"]].assign(**dict(zip(("within", "w", "s", "m"), map(list, zip(*rows)), strict=True))) if rows else batch[[*keys, "id", "n"]].assign(within=0.0, w=None, s=None, m=None)

    now = materialised(same.mapInPandas(step, key_schema(u, keys) + STATE))
    several = same.where("n > 1").select(*keys, "v", F.col("id").alias("a"))
    copies = u.join(several, [*keys, "v"]).where("id <> a")
    merges = materialised(copies.select(*keys, F.col("id").alias("b"), "a", F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("step")))
    discarded(u, same)
    return now, merges


def found_rows(part: pa.Table, keys: list[str], columns: dict) -> pa.Table:
    """A group's results with its keys."""
    count = len(next(iter(columns.values())))
    own = {k: pa.array([part[k][0].as_py()] * count, part.schema.field(k).type) for k in keys}
    return pa.table(own | {c: pa.array(x) for c, x in columns.items()})


def nearest(clusters: DataFrame, open_: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """(keys, id, d, other): the nearest ones of the clusters ``open_`` in their groups, the smallest id of ties."""

    def cell(part: pa.Table) -> pa.Table:
        side = part["_side"].to_numpy()
        one, two = (part.take(np.flatnonzero(side == x)) for x in (0, 1))
        if not len(one) or not len(two):
            return found_rows(part, keys, {"id": np.zeros(0, np.int64), "d": np.zeros(0), "other": np.zeros(0, np.int64)})
        x = Clusters(one)
        d, other = x.nearest(Clusters(two))
        some = np.isfinite(d)
        return found_rows(part, keys, {"id": x.id[some], "d": d[some], "other": other[some]})

    def blocks(name):
        n = F.count("*")
        return F.least(F.ceil(n / block_rows), F.greatest(F.lit(SPREAD), F.ceil(n / WIDE)), F.lit(MOST_BLOCKS)).cast("int").alias(name)

    counts = clusters.groupBy(*keys).agg(blocks("_nr")).join(open_.groupBy(*keys).agg(blocks("_nl")), keys)
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # only groups beyond ``LAST`` blocks are here: a few rows, and a join by them alone would send a group to one task
    rows = clusters.join(F.broadcast(counts), keys)
    some = rows.join(open_.select(*keys, "id"), [*keys, "id"], "left_semi").withColumn("_lo", own(F.col("_nl"))).withColumn("_hi", every("_nr"))
    rows = rows.withColumn("_hi", own(F.col("_nr"))).withColumn("_lo", every("_nl")).withColumn("_side", F.lit(1))
    rows = rows.unionByName(some.withColumn("_side", F.lit(0))).drop("_nl", "_nr")
    cells = rows.repartition(*keys, "_lo", "_hi").groupBy(*keys, "_lo", "_hi").applyInArrow(cell, key_schema(clusters, keys) + "id long, d double, other long")
    best = cells.groupBy(*keys, "id").agg(F.min(F.struct("d", "other")).alias("best"))
    return best.select(*keys, "id", "best.d", "best.other")


def merged(clusters: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """``clusters`` after ``merges`` (keys, a, b, d): the sums of each pair under its smaller id."""
    parts = ("n", "within", "w", "s", "m")
    side = lambda end: clusters.select(*keys, F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in parts))
    pairs = merges.select(*keys, "a", "b", "d").join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])

    def sums(w, s, m):
        if m is not None:
            return np.asarray(s), np.asarray(m)
        u = np.asarray(w).reshape(-1, dims[0])
        return u.sum(0), outer_products(u).sum(0)

    dims = [0]

    def step(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                dims[0] = len(r.s_a) if r.s_a is not None else len(r.w_a) // r.n_a
                n, k = r.n_a, r.n_b
                between = r.d * (n + k) / 2 + n * k * (r.within_a / n**2 + r.within_b / k**2) / 2
                if n + k <= MEMBERS:
                    kept = np.concatenate([r.w_a, r.w_b]), None, None
                else:
                    one, two = sums(r.w_a, r.s_a, r.m_a), sums(r.w_b, r.s_b, r.m_b)
                    kept = None, one[0] + two[0], one[1] + two[1]
                rows.append((r.a, n + k, r.within_a + r.within_b + 2 * between, *kept))
            found = pd.DataFrame(rows, columns=["id", *parts])
            yield batch[[*keys]].assign(**{c: found[c].to_list() for c in found})

    new = pairs.mapInPandas(step, key_schema(clusters, keys) + STATE)
    gone = merges.select(*keys, F.explode(F.array("a", "b")).alias("id"))
    return clusters.join(gone, [*keys, "id"], "left_anti").unionByName(new)


def folded(d: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges (a, b, squared height), a < b, of clusters with the squared distances ``d``; ties go to the lowest pair."""
    n, size, found = len(d), size.astype(float).copy(), []
    alive, near = np.ones(n, bool), d.argmin(1)
    for _ in range(n - 1):
        best = np.where(alive, d[np.arange(n), near], np.inf)
        i = int(best.argmin())
        i, j = sorted((i, int(near[i])))
        found.append((i, j, float(d[i, j])))
        new = np.maximum(((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * d[i, j]) / (size + size[i] + size[j]), 0)
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        near[i] = d[i].argmin()
        for r in np.flatnonzero(alive & ((near == i) | (near == j) | (new <= d[np.arange(n), near]))):
            near[r] = d[r].argmin()
    return found


def in_one_task(keys: list[str], step: int):
    """Merges of what is left of a group; their steps begin at ``step``."""

    def merges(part: pa.Table) -> pa.Table:
        x = Clusters(part)
        found = folded(symmetric(x.distances()), x.n)
        i, j, d = (np.array([m[c] for m in found], kind) for c, kind in enumerate((np.int64, np.int64, float)))
        return found_rows(part, keys, {"b": x.id[j], "a": x.id[i], "d": d, "step": step + np.arange(len(found), dtype=np.int64)})

    return merges


def ward_tree(marks: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, b, a, d, step), written: every merge of the cluster of mark ``b`` into that of ``a``, its squared height, and when."""
    now, found = started(marks, keys)
    near, known, step = None, None, 1
    while True:
        sizes = now.groupBy(*keys).agg(F.count("*").alias("_n"))
        least, most = sizes.agg(F.min("_n"), F.max("_n")).first()
        if most is None or least <= LAST * block_rows:
            small = materialised(sizes.where(F.col("_n") <= LAST * block_rows).select(*keys))
            done = now.join(small, keys, "left_semi").groupBy(*keys).applyInArrow(in_one_task(keys, step), key_schema(now, keys) + "b long, a long, d double, step long")
            found = found.unionByName(materialised(done))
            if most is None or most <= LAST * block_rows:
                discarded(now, small, *([near] if near else []))
                return found
            before, now = now, materialised(now.join(small, keys, "left_anti"))
            known = known and known.join(small, keys, "left_anti")
            discarded(before)
        ids = now.select(*keys, "id")
        before, near = near, materialised(known.unionByName(nearest(now, ids.join(known, [*keys, "id"], "left_anti"), keys, block_rows)) if known else nearest(now, ids, keys, block_rows))
        if before:
            discarded(before)
        back = near.select(*keys, F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = near.join(back, [*keys, "id", "other"]).where("id < other").select(*keys, F.col("other").alias("b"), F.col("id").alias("a"), "d")
        # where rounding leaves no two that are each other's, the nearest two are merged
        first = F.min(F.struct("d", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).alias("x")
        alone = near.groupBy(*keys).agg(first).join(pairs.select(*keys), keys, "left_anti").select(*keys, "x.b", "x.a", "x.d")
        merges = materialised(pairs.unionByName(alone).withColumn("step", F.lit(step).cast("long")))
        found, step = found.unionByName(merges), step + 1
        before, now = now, materialised(merged(now, merges, keys))
        gone = merges.select(*keys, F.explode(F.array("a", "b")).alias("id"))
        known = near.join(gone, [*keys, "id"], "left_anti").join(gone.withColumnRenamed("id", "other"), [*keys, "other"], "left_anti").select(*keys, "id", "d", "other")
        discarded(before)


def highest(tree: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(tree columns, place): the ``k`` highest merges of each group, the later one of ties first."""
    order = [F.desc("d"), F.desc("step"), "b"]
    part = F.pmod(F.xxhash64("b"), F.lit(PARTS))
    some = tree.withColumn("_part", part).withColumn("place", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("place") <= k)
    return some.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k).drop("_part")


def ends(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b, a): where the chains of pointers b -> a end, by jumping to the pointer's pointer."""
    now, done = materialised(pointers), None
    while True:
        ahead = now.select(*keys, F.col("b").alias("a"), F.col("a").alias("_up"))
        jumped = materialised(now.join(ahead, [*keys, "a"], "left").select(*keys, "b", F.coalesce("_up", "a").alias("a"), F.col("_up").isNull().alias("_end")))
        ended = jumped.where("_end").drop("_end")
        done = ended if done is None else done.unionByName(ended)
        going = jumped.where("NOT _end").drop("_end")
        if not going.limit(1).count():
            return done
        # those that have ended serve the others as targets no more: their ends do
        now = materialised(going.join(ended.select(*keys, F.col("b").alias("a"), F.col("a").alias("_up")), [*keys, "a"], "left").select(*keys, "b", F.coalesce("_up", "a").alias("a")))


def ward_labels(marks: DataFrame, keys: list[str], max_k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, cut, sig_id, label) for cuts into 2 to ``max_k`` clusters; a label is the cluster's smallest mark."""
    tree = materialised(ward_tree(marks, keys, block_rows))
    top = materialised(highest(tree, keys, max_k - 1))
    kept = tree.select(*keys, "b", "a").join(top.select(*keys, "b"), [*keys, "b"], "left_anti")
    fine = ends(kept, keys).select(*keys, F.col("b").alias("sig_id"), F.col("a").alias("end"))
    sig = marks.select(*keys, F.col("sig_id").cast("long").alias("sig_id"))
    fine = materialised(sig.join(fine, [*keys, "sig_id"], "left").select(*keys, "sig_id", F.coalesce("end", "sig_id").alias("end")))

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        """The fine clusters' labels for every k, of a group's few highest merges."""
        rows = []
        up = dict(zip(part["b"], part["a"], strict=True))
        every = sorted({*up, *up.values()})
        # an upper end may itself have been merged below the cut
        for k in range(2, len(part) + 2):
            keep = {b: a for b, a, p in zip(part["b"], part["a"], part["place"], strict=True) if p >= k}
            for x in every:
                end = x
                while end in keep:
                    end = keep[end]
                rows.append((k, x, end))
        return pd.DataFrame(rows, columns=["cut", "end", "label"]).assign(**{c: part[c].iloc[0] for c in keys})[[*keys, "cut", "end", "label"]]

    # the ends of the kept pointers, of which those of the highest merges start or end in
    where = fine.select(*keys, F.col("sig_id").alias("a"), F.col("end").alias("_end"))
    coarse = top.join(where, [*keys, "a"], "left").select(*keys, "b", F.coalesce("_end", "a").alias("a"), "place")
    cuts = coarse.groupBy(*keys).applyInPandas(cut, key_schema(marks, keys) + "cut int, end long, label long")
    return fine.join(cuts, [*keys, "end"]).select(*keys, "cut", "sig_id", "label")
