"""Pairs of marks: within a key, over a corpus, against references, and best matches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.vectors import normalised
from inkwell.operators.staging import materialised, sent_if_small

#: Blocks of a table at most, so that what is sent grows with the table and not with its square; rows that a task takes of a block at a time.
MOST_BLOCKS, PIECE = 24, 1000
#: Pairs that a task puts in order of their cosines at a time, and those that it sends at a time.
ORDERED, SENT = 3_000_000, 200_000


def unit_vectors(marks: DataFrame, vector: str = "v") -> DataFrame:
    """Normalised once for each mark, before any pair is made."""
    return marks.withColumn(vector, normalised(F.col(vector)))


def block_cells(marks: DataFrame, block_rows: int, vector: str, keep: list[str]) -> DataFrame:
    """Rows (lo, hi, own, sig_id, keep, v): each mark once for every block that its own block meets; blocks are ranges of ids."""
    blocks = min(MOST_BLOCKS, max(1, math.ceil(marks.count() / block_rows)))
    ends = marks.approxQuantile("sig_id", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    own = sum((F.when(F.col("sig_id") > int(end), 1).otherwise(0) for end in ends), F.lit(0))
    u = unit_vectors(marks, vector).select("sig_id", *keep, F.col(vector).alias("v"), own.alias("own"))
    rows = u.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "sig_id", *keep, "v")


class Marks:
    """Ids in order, vectors and a further column of a block or a piece of it."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, by: np.ndarray | None):
        self.ids, self.v, self.by = ids, v, by

    @classmethod
    def of(cls, rows: pd.DataFrame, by: str | None) -> Marks:
        rows = rows.sort_values("sig_id")
        return cls(rows["sig_id"].to_numpy(np.int64), np.array(rows["v"].tolist()), None if by is None else rows[by].to_numpy())

    def pieces(self) -> list[Marks]:
        return [self.at(slice(i, i + PIECE)) for i in range(0, len(self.ids), PIECE)]

    def at(self, rows) -> Marks:
        return Marks(self.ids[rows], self.v[rows], None if self.by is None else self.by[rows])


def sides(batches: Iterator[pd.DataFrame], by: str | None = None) -> Iterator[tuple[Marks, Marks, np.ndarray | None]]:
    """(lower, higher, mask) pieces of a cell's two blocks: each pair once, where ``mask`` (none: all) holds."""
    cell = pd.concat(list(batches))
    lo, hi = cell["lo"].iloc[0], cell["hi"].iloc[0]
    left, right = (Marks.of(cell[cell["own"] == own], by).pieces() for own in (lo, hi))
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if lo == hi and i > j:
                continue
            if x.ids[-1] < y.ids[0]:
                yield x, y, None
            elif y.ids[-1] < x.ids[0]:
                yield y, x, None
            else:
                yield x, y, x.ids[:, None] < y.ids[None]
                if lo != hi or i != j:
                    yield y, x, y.ids[:, None] < x.ids[None]


def pairs_in_groups(marks: DataFrame, keys: list[str], scores: dict[str, tuple[int, int]], floor: float | None = None, block_rows: int = 2000) -> DataFrame:
    """(keys, sig_a, sig_b, scores) of all unordered pairs that share ``keys``, as matrix products.

    A score is the cosine of a stretch (start, end) of the vectors. Large groups fall into
    blocks, so that a task holds two of them; with ``floor`` only pairs whose first score
    reaches it are given.
    """
    kinds = dict(marks.dtypes)
    blocks = marks.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"), F.count("*").alias("_rows"))
    rows = marks.select(*keys, "sig_id", "v").join(blocks.where("_rows > 1").drop("_rows"), keys)  # one mark has no pair
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("sig_id"), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select(*keys, "sig_id", "v", "_own", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"))
    names = [*keys, "sig_a", "sig_b", *scores]

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sig_id", ignore_index=True)
        ids, x = part["sig_id"].to_numpy(), np.array(part["v"].tolist())
        one, two = (np.flatnonzero(part["_own"].to_numpy() == part[c].iloc[0]) for c in ("_lo", "_hi"))
        same, found = part["_lo"].iloc[0] == part["_hi"].iloc[0], {}
        for name, (a, b) in scores.items():
            part_of = x[:, a:b] / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-300)
            table = part_of[one] @ part_of[two].T
            if name == next(iter(scores)):
                keep = np.ones(table.shape, bool) if floor is None else table >= floor
                i, j = np.nonzero(np.triu(keep, 1) if same else keep)
            found[name] = table[i, j]
        a, b = ids[one[i]], ids[two[j]]
        return pd.DataFrame({k: part[k].iloc[0] for k in keys} | {"sig_a": np.minimum(a, b), "sig_b": np.maximum(a, b)} | found, columns=names)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"sig_a {kinds['sig_id']}", f"sig_b {kinds['sig_id']}", *(f"{s} double" for s in scores)])
    # dealt out by all three, as a join by the keys leaves a large group in one task
    return rows.repartition(*keys, "_lo", "_hi").groupBy(*keys, "_lo", "_hi").applyInPandas(cell, schema)


def blocked_pairs(marks: DataFrame, floor: float, block_rows: int = 2000, vector: str = "v") -> DataFrame:
    """(sig_a, sig_b, cosine) of all pairs of at least ``floor``, without a nested-loop join.

    Marks are dealt to blocks; each pair of blocks is one task's matrix products, and only
    pairs above the floor leave it, piece by piece. Rows are copied once for each block, not for each mark.

    Pairs leave in stretches ordered by cosine: rounded cosines then repeat, so that files of
    them hold about half the bytes where blocks are large.
    """

    def ordered(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(found[2])
        for begin in range(0, len(order), SENT):
            at = order[begin : begin + SENT]
            yield pd.DataFrame({c: x[at] for c, x in zip(("sig_a", "sig_b", "cosine"), found, strict=True)})

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for x, y, mask in sides(batches):
            sims = x.v @ y.v.T
            at = np.flatnonzero(sims >= floor if mask is None else (sims >= floor) & mask)
            i, j = np.divmod(at, len(y.ids))
            parts.append((x.ids[i], y.ids[j], sims.ravel()[at]))
            size += len(at)
            if size >= ORDERED:
                yield from ordered(parts)
                parts, size = [], 0
        if parts:
            yield from ordered(parts)

    return block_cells(marks, block_rows, vector, []).groupBy("lo", "hi").applyInPandas(cell, "sig_a long, sig_b long, cosine double")


def by_group(ufunc: np.ufunc, table: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``table`` reduced by groups of rows and columns that begin at ``rows`` and ``columns``."""
    if len(rows) > 64:
        return ufunc.reduceat(ufunc.reduceat(table, rows, 0), columns, 1)
    ends = [*rows[1:], len(table)]
    return ufunc.reduceat(np.array([ufunc.reduce(table[i:j], 0) for i, j in zip(rows, ends, strict=True)]), columns, 1)


def blocked_statistics(marks: DataFrame, by: str, block_rows: int = 2000, vector: str = "v") -> DataFrame:
    """(a, b, n, total, top) of all pairs by the value of ``by`` of the lower and the higher id.

    Each cell adds up its pairs, so that what leaves it has a row for each two values. Where all
    ids of a piece are lower than all of another, numbers and sums follow from each value's own.
    """

    def grouped(x: Marks) -> tuple[Marks, np.ndarray, np.ndarray, np.ndarray]:
        names, at = np.unique(x.by, return_inverse=True)
        x = x.at(np.argsort(at, kind="stable"))
        n = np.bincount(at, minlength=len(names))
        return x, names, n, np.cumsum(n) - n

    def summed(x: Marks, y: Marks, ordered: bool) -> pd.DataFrame:
        (x, left, n, rows), (y, right, k, columns) = grouped(x), grouped(y)
        sims = x.v @ y.v.T
        if ordered and np.isfinite(x.v).all() and np.isfinite(y.v).all():
            count, total = n[:, None] * k[None], np.add.reduceat(x.v, rows, 0) @ np.add.reduceat(y.v, columns, 0).T
        else:
            mask = ~np.isnan(sims) if ordered else (x.ids[:, None] < y.ids[None]) & ~np.isnan(sims)
            count, total = by_group(np.add, mask.astype(np.int64), rows, columns), by_group(np.add, np.where(mask, sims, 0.0), rows, columns)
            sims = np.where(mask, sims, -np.inf)
        top = by_group(np.maximum, sims, rows, columns)
        i, j = np.nonzero(count)
        return pd.DataFrame({"a": left[i], "b": right[j], "n": count[i, j], "total": total[i, j], "top": top[i, j]})

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for x, y, mask in sides(batches, by):
            parts.append(summed(x, y, mask is None))
            size += len(parts[-1])
            if size > 2_000_000:
                yield pd.concat(parts)
                parts, size = [], 0
        if parts:
            yield pd.concat(parts).groupby(["a", "b"], as_index=False, dropna=False).agg({"n": "sum", "total": "sum", "top": "max"})

    kind = dict(marks.dtypes)[by]
    parts = block_cells(marks, block_rows, vector, [by]).groupBy("lo", "hi").applyInPandas(cell, f"a {kind}, b {kind}, n long, total double, top double")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))


def blocked_top(marks: DataFrame, k: int, block_rows: int = 2000, vector: str = "v") -> DataFrame:
    """(sig_a, sig_b, cosine) of the ``k`` most alike pairs of all; ties go to the smaller ids.

    A cell sends its own ``k`` best.
    """

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"sig_a": [], "sig_b": [], "cosine": []}).astype({"sig_a": "int64", "sig_b": "int64"})
        for x, y, mask in sides(batches):
            sims = x.v @ y.v.T
            least = best["cosine"].iloc[-1] if len(best) == k else -np.inf
            near = sims >= least if least > -np.inf else np.isfinite(sims)
            near = near if mask is None else near & mask
            if np.count_nonzero(near) > 4 * k:
                near &= sims >= np.partition(sims[near], -k)[-k]
            i, j = np.nonzero(near)
            found = pd.DataFrame({"sig_a": x.ids[i], "sig_b": y.ids[j], "cosine": sims[i, j]})
            best = pd.concat([best, found]).sort_values(["cosine", "sig_a", "sig_b"], ascending=[False, True, True]).head(k)
        yield best

    cells = block_cells(marks, block_rows, vector, []).groupBy("lo", "hi")
    return cells.applyInPandas(cell, "sig_a long, sig_b long, cosine double").orderBy(F.desc("cosine"), "sig_a", "sig_b").limit(k)


#: Fixed values of the digest of a pair, which any engine with 64-bit whole numbers can follow.
PRIME, FACTORS = 2**31 - 1, (48271, 69621, 16807, 40692)


def pair_digest(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """62 bits that depend on both ids and the seed: two remainders, of seed and seed + 1, one above the other."""
    x, y = a % PRIME, b % PRIME

    def remainder(seed):
        h = (x * FACTORS[0] + y * FACTORS[1] + seed) % PRIME
        h = (h * h + x * FACTORS[2]) % PRIME
        return (h * h + y * FACTORS[3]) % PRIME

    return remainder(seed) * (PRIME + 1) + remainder(seed + 1)


def rest_of_prime(x: np.ndarray) -> np.ndarray:
    """``x`` below 2**63 and not negative, modulo ``PRIME``, in place: bits above the 31st count as those below."""
    for _ in range(2):
        high = x >> 31
        x &= PRIME
        x += high
    x[x >= PRIME] -= PRIME
    return x


def upper_digest(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """The upper part of the digest of all pairs of two lists of ids."""
    x, y = a[:, None] % PRIME, b[None] % PRIME
    h = x * FACTORS[0] % PRIME + (y * FACTORS[1] + seed) % PRIME
    rest_of_prime(h)
    h *= h
    h += x * FACTORS[2]
    rest_of_prime(h)
    h *= h
    h += y * FACTORS[3]
    return rest_of_prime(h)


def digest_sql(a: str, b: str, seed: int) -> str:
    """The same in SQL."""
    x, y = (f"((({i} % {PRIME}) + {PRIME}) % {PRIME})" for i in (a, b))

    def remainder(seed):
        h = f"(({x} * {FACTORS[0]} + {y} * {FACTORS[1]} + {seed}) % {PRIME})"
        h = f"(({h} * {h} + {x} * {FACTORS[2]}) % {PRIME})"
        return f"(({h} * {h} + {y} * {FACTORS[3]}) % {PRIME})"

    return f"({remainder(seed)} * {PRIME + 1} + {remainder(seed + 1)})"


def floor_trials(marks: DataFrame, k: int = 30, seed: int = 42, by: str = "writer", block_rows: int = 2000, vector: str = "v") -> DataFrame:
    """(sig_a, sig_b, digest, cosine) of ``k`` pairs of all that differ in ``by``: those of the least digest.

    Each cell of blocks sends its own ``k`` least on, as a sketch that merges, so that the
    pairs are neither sorted nor written. A pair whose digest's upper part is above that of the
    ``k`` least so far is looked at no further; only those that stay are scored. Marks without a
    value of ``by`` are in no trial.
    """

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, most = [], PRIME
        for x, y, mask in sides(batches, by):
            x, y = (m.at(np.isfinite(m.v).all(1)) for m in (x, y))
            for begin in range(0, len(x.ids), 128):
                part = x.at(slice(begin, begin + 128))
                i, j = np.nonzero(upper_digest(part.ids, y.ids, seed) <= most)
                keep = part.by[i] != y.by[j]
                i, j = i[keep], j[keep]
                if mask is not None:
                    keep = part.ids[i] < y.ids[j]
                    i, j = i[keep], j[keep]
                if not len(i):
                    continue
                found = pd.DataFrame({"sig_a": part.ids[i], "sig_b": y.ids[j], "digest": pair_digest(part.ids[i], y.ids[j], seed)})
                if len(found) > k:
                    least = (found["digest"] <= np.partition(found["digest"].to_numpy(), k - 1)[k - 1]).to_numpy()
                    found, i, j = found[least], i[least], j[least]
                best = pd.concat([*best, found.assign(cosine=np.einsum("ij,ij->i", part.v[i], y.v[j]))])
                best = [best.sort_values(["digest", "sig_a", "sig_b"]).head(k)]
                if len(best[0]) == k:
                    most = int(best[0]["digest"].iloc[-1]) // (PRIME + 1)
        yield from best

    cells = block_cells(marks.where(F.col(by).isNotNull()), block_rows, vector, [by]).groupBy("lo", "hi")
    return cells.applyInPandas(cell, "sig_a long, sig_b long, digest long, cosine double").orderBy("digest", "sig_a", "sig_b").limit(k)


def in_blocks(left: DataFrame, right: DataFrame, keys: list[str], sides_by: tuple[str, str], step, schema: str, block_rows: int = 4000) -> DataFrame:
    """``step(left rows, right rows)`` for every pair of blocks of two tables that share ``keys``.

    Both tables are dealt to blocks by a digest of a column of theirs, so that a task holds
    two blocks; a row is copied once for each block of the other table. A key has at most
    ``MOST_BLOCKS`` blocks of each, which ``step`` is to go through in pieces.
    """
    of = lambda c, k: F.pmod(F.xxhash64(c), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    if keys:
        counts = [t.groupBy(*keys).agg(F.least(F.ceil(F.count("*") / block_rows), F.lit(MOST_BLOCKS)).cast("int").alias(c)) for t, c in ((left, "_nl"), (right, "_nr"))]
        n = counts[0].join(counts[1], keys, "full").select(*keys, *(F.coalesce(c, F.lit(1)).alias(c) for c in ("_nl", "_nr")))
        n = sent_if_small(materialised(n))  # else a join by a few keys leaves all copies of a row to one task
        left, right, nl, nr = left.join(n, keys), right.join(n, keys), F.col("_nl"), F.col("_nr")
    else:
        nl, nr = (F.lit(max(1, math.ceil(t.count() / block_rows))) for t in (left, right))
    x = left.withColumn("_l", of(sides_by[0], nl)).withColumn("_r", every(nr))
    y = right.withColumn("_r", of(sides_by[1], nr)).withColumn("_l", every(nl))
    x, y = x.drop("_nl", "_nr"), y.drop("_nl", "_nr")  # a cogroup takes no columns that both sides have from one table
    cells = [*keys, "_l", "_r"]
    return x.groupBy(*cells).cogroup(y.groupBy(*cells)).applyInPandas(step, schema)


def best_signers(targets: DataFrame, references: DataFrame, threshold: float, block_rows: int = 4000) -> DataFrame:
    """Each target's best signer over all references: (target columns, signer, similarity, matched).

    Similarities start at 0 and the first signer wins ties; below the threshold the signer
    is null, but its similarity is reported. Blocks of targets meet blocks of references in
    matrix products; each sends a target's best signer on.
    """
    t = unit_vectors(targets)
    r = unit_vectors(references).select(F.col("writer").alias("signer"), "v")
    keys = [c for c in t.columns if c != "v"]
    kinds = dict(t.dtypes) | {"signer": dict(r.dtypes)["signer"]}

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[keys].assign(signer=None, s=0.0).head(0)
        right = right.sort_values("signer", ignore_index=True)
        x, y = np.array(left["v"].tolist()), np.array(right["v"].tolist()).T
        at, s = np.zeros(len(x), int), np.zeros(len(x))
        for i in range(0, len(x), 250):  # a table of a few MB at a time
            sims = np.maximum(x[i : i + 250] @ y, 0.0)
            at[i : i + 250] = sims.argmax(1)  # the first of ties, and so the first signer
            s[i : i + 250] = sims.max(1)
        return left[keys].assign(signer=right["signer"].to_numpy()[at], s=s)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "signer"]) + ", s double"
    cells = in_blocks(t, r, [], (keys[0], "v"), best, schema, block_rows)
    found = cells.groupBy(*keys).agg(F.min(F.struct((-F.col("s")).alias("s"), "signer")).alias("best"))
    similarity = -F.col("best.s")
    return found.select(*keys, F.when((similarity >= threshold) & (similarity > 0), F.col("best.signer")).alias("signer"), similarity.alias("similarity"))


def mutual_matches(similarities: DataFrame, floor: float = 0.5) -> DataFrame:
    """(a, b, s) that are each other's best: ties go to the lowest index; below the floor none."""
    by_a = F.row_number().over(W.partitionBy("group", "a").orderBy(F.desc("s"), "b"))
    by_b = F.row_number().over(W.partitionBy("group", "b").orderBy(F.desc("s"), "a"))
    return similarities.withColumns({"ra": by_a, "rb": by_b}).where((F.col("ra") == 1) & (F.col("rb") == 1) & (F.col("s") >= floor)).drop("ra", "rb")


def vector_batches(batches: Iterator[pd.DataFrame], model, column: str = "content") -> Iterator[pd.DataFrame]:
    """Runs a feature model over batches: the seam for external extractors in ``mapInPandas``."""
    for batch in batches:
        yield batch.assign(v=[list(map(float, x)) for x in model(batch[column])]).drop(columns=[column])
