"""Near-duplicate documents by min-max hashing (operator 1).

A document's set holds hashes of its distinct word shingles. Under each of 64 random
permutations both the minimum and the maximum are retained: 128 signature values for 64
hash evaluations, in 32 bands of four. At similarity 0.8 a pair shares no band with
probability (1 - 0.8**4)**32, below 1e-7.

Links are found without pairing up the members of a band's bucket:

1. Documents of equal sets form a class, of which the smallest id goes on.
2. In each bucket every member is compared with two hubs (the members of least and
   greatest hashed id), on full sets. Pairs of at least ``loose`` build zones, pairs of at
   least the threshold build components. What links with a member that is ``loose`` plus
   100 less the threshold near to a hub is ``loose`` near to it as well (distances of sets
   obey the triangle inequality), so that such members are done with in that bucket.
3. The others of a bucket, if several, stay open: large groups get new hubs from among
   them as long as that halves their rows, and in what is left all meet all in blocks.
4. Zones whose members don't all lie in one component are settled on full sets in blocks:
   the members outside the zone's largest component meet all members, a block of the one
   against a block of the other in a task. This finds links that no hub saw.

Defined cases: a text without words has the empty set, links with nothing and is kept; with
fewer words than a shingle the whole sequence is the one shingle; repeated rows of an id
share their verdict; a row without an id takes no part and is kept, component null; with
no rows there are none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import components, join_salted, join_weighted, map_arrow, spare, utf8, written

PERMUTATIONS = 64
ROWS_OF_BAND = 4
BANDS = 2 * PERMUTATIONS // ROWS_OF_BAND
_rng = np.random.default_rng(20240101)
MULTIPLIERS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
BAND_MIXERS = _rng.integers(0, 2**63, ROWS_OF_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a block, and hashes in it at most, in steps 3 and 4.
BLOCK_ROWS, BLOCK_HASHES = 64, 200_000
#: Rows and hashes, on average, that the cells of a pack hold together in step 3.
PACK_ROWS, PACK_HASHES = 2000, 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words, A-Z folded."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    keys = np.full(n, np.uint64(min(len(h), width)))
    for k in range(min(width, len(h))):
        keys = mix(keys * ODD + h[k : n + k])
    return np.unique(keys.view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, which holds the band's number."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), 2048):
        x = hashes[at : at + 2048, None].view(np.uint64) * MULTIPLIERS + ADDENDS
        low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    rows = mix(np.concatenate([low, high])).reshape(BANDS, ROWS_OF_BAND)
    return mix((rows * BAND_MIXERS).sum(1) + np.arange(BANDS, dtype=np.uint64) * ODD).view(np.int64)


def sketches(docs: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of every row; an empty set has neither key nor bands."""

    def step(batches):
        for batch in batches:
            n, keys, bands = [], [], []
            for text in utf8(batch, "text"):
                s = shingle_set(text, width)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(s) if len(s) else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, step, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """(node, rep, hashes) of the documents in ``wanted`` (node, rep)."""

    def step(batches):
        for batch in batches:
            found = [shingle_set(t, width) for t in utf8(batch, "text")]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["node", "rep", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text_col).alias("text")).join(wanted.hint("shuffle_hash"), "rep").select("node", "rep", "text")
    return map_arrow(rows, step, "node long, rep long, hashes array<long>")


def lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def verified(pairs: DataFrame, sets: DataFrame, threshold: int, loose: int) -> DataFrame:
    """(a, b, linked, closed) of pairs (node, hub) whose percent of similarity reaches ``loose``."""
    shut = loose + 100 - threshold
    one = sets.select("node", F.col("rep").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("hub"), F.col("rep").alias("b"), F.col("hashes").alias("y"))

    def step(batches):
        for batch in batches:
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(lists(batch, "x"), lists(batch, "y"), strict=True)]
            both = np.array(both, np.int64)
            union = np.array([len(x) for x in lists(batch, "x")], np.int64) + np.array([len(y) for y in lists(batch, "y")], np.int64) - both
            near = pa.array(100 * both >= loose * union)
            linked, closed = pa.array(100 * both >= threshold * union), pa.array(100 * both >= shut * union)
            yield pa.record_batch([batch.column(0), batch.column(1), linked, closed], names=["a", "b", "linked", "closed"]).filter(near)

    rows = pairs.join(one, "node").join(two, "hub").select("a", "b", "x", "y")
    return map_arrow(rows, step, "a long, b long, linked boolean, closed boolean")


def hub_edges(stars: DataFrame, sets: DataFrame, threshold: int, loose: int) -> DataFrame:
    """``verified`` of the members of ``stars`` (rep, node, lo, hi) with their two hubs."""
    pairs = stars.select("node", F.explode(F.array("lo", "hi")).alias("hub")).where("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")).distinct()
    return written(verified(pairs, sets, threshold, loose), "edges")


def still_open(stars: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of ``stars`` that are no hub and that neither hub closes, where a group has several."""
    shut = edges.where("closed").select(F.xxhash64("a").alias("node"), F.xxhash64("b").alias("hub"))
    shut = shut.union(shut.select("hub", "node"))
    rest = stars.where("node <> lo and node <> hi")
    for hub in ("lo", "hi"):
        rest = rest.join(shut.withColumnRenamed("hub", hub), ["node", hub], "left_anti")
    rest = written(rest.select("rep", "node", "lo", "hi"), "open")
    groups = rest.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))
    return rest.join(written(groups.where("n > 1"), "groups"), ["lo", "hi"])


def remainder(stars: DataFrame, edges: DataFrame, sets: DataFrame, threshold: int, loose: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges with those of further hubs, and the links (a, b) between members that no hub closes."""
    parts, before, found = [], None, edges
    while True:
        rest = still_open(stars, found)
        large = rest.where(F.col("n") > BLOCK_ROWS)
        now = large.count()
        if not now or (before is not None and 2 * now > before):
            parts.append(rest)
            break
        parts.append(rest.where(F.col("n") <= BLOCK_ROWS))
        stars, before = written(large.select("rep", "node", F.col("least").alias("lo"), F.col("most").alias("hi")).distinct(), "stars"), now
        found = hub_edges(stars, sets, threshold, loose)
        edges = edges.union(found)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return edges, met(rows.select("rep", "node", "lo", "hi").distinct(), sets, threshold)


def met(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame | None:
    """Links (a, b) within the groups (lo, hi) of ``rows``, all against all in blocks."""
    rows = written(rows.join(sets.select("node", F.size("hashes").alias("n_hashes")), "node"), "open")
    sizes = rows.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.sum("n_hashes").alias("h"))
    sizes = written(sizes.withColumn("n_blocks", blocks(F.col("n"), F.col("h"))), "blocks")
    total = sizes.agg(F.sum(F.col("n") * (F.col("n_blocks") + 1)), F.sum(F.col("h") * (F.col("n_blocks") + 1))).first()
    if not total[0]:
        return None
    packs = int(max(total[0] // PACK_ROWS, total[1] // PACK_HASHES, 1))
    rows = rows.join(sizes.select("lo", "hi", "n_blocks"), ["lo", "hi"]).withColumn("k", F.pmod(F.xxhash64("node", F.lit(3)), "n_blocks").cast("int"))
    members = rows.select("lo", "hi", F.col("k").alias("mb"), F.explode(F.sequence("k", F.col("n_blocks") - 1)).alias("pb"), F.lit(False).alias("probe"), "node")
    probes = rows.select("lo", "hi", F.explode(F.sequence(F.lit(0), "k")).alias("mb"), F.col("k").alias("pb"), F.lit(True).alias("probe"), "node")
    cells = members.union(probes).select(F.xxhash64("lo", "hi", "mb", "pb").alias("cell"), "probe", "node")
    cells = cells.join(sets.select("node", "rep", F.col("rep").alias("comp"), "hashes"), "node").drop("node")
    packed = cells.groupBy(F.pmod("cell", F.lit(packs)).alias("pack"))

    def links(pack: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([block_links(cell, threshold) for _, cell in pack.groupby("cell", sort=False)])

    return written(packed.applyInPandas(links, "a long, b long").distinct(), "links")


def blocks(rows, hashes):
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(hashes / BLOCK_HASHES), F.lit(1)).cast("int")


def block_links(cell: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links between the probes and the members of a cell that lie in different components."""
    members, probes = cell[~cell["probe"]], cell[cell["probe"]]
    found: list[tuple[int, int]] = []
    if len(members) and len(probes):
        sizes = np.array([len(h) for h in members["hashes"]])
        owner = np.repeat(np.arange(len(members)), sizes)
        hashes = np.concatenate(list(members["hashes"]))
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        ids, comps = members["rep"].to_numpy(), members["comp"].to_numpy()
        for rep, comp, own in zip(probes["rep"], probes["comp"], probes["hashes"], strict=True):
            left, right = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            n = right - left
            at = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(members))
            near = (100 * both >= threshold * (sizes + len(own) - both)) & (comps != comp)
            found += [(rep, ids[i]) for i in np.flatnonzero(near)]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def settled(edges: DataFrame, linked: DataFrame, sets: DataFrame, threshold: int) -> DataFrame | None:
    """Links (a, b) that no hub saw, from zones that fall into several components."""
    zones = components(edges.select("a", "b")).withColumnRenamed("component_id", "zone")
    # single documents of a zone that links with nothing so far are components of their own
    nodes = written(zones.join(linked.withColumnRenamed("component_id", "comp"), "id", "left").select("id", "zone", F.coalesce("comp", "id").alias("comp")), "zones")
    parts = nodes.groupBy("zone", "comp").agg(F.count("*").alias("n"))
    several = parts.groupBy("zone").agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.max(F.struct("n", "comp"))["comp"].alias("main")).where("k > 1 and all > 2")
    several = written(several.select("zone", "main"), "zones")
    if not several.limit(1).count():
        return None
    at_stake = nodes.join(several, "zone").join(sets.select(F.col("rep").alias("id"), F.size("hashes").alias("n_hashes")), "id")
    at_stake = written(at_stake.withColumn("outside", F.col("comp") != F.col("main")), "at-stake")

    sizes = at_stake.groupBy("zone").agg(
        F.count("*").alias("m"),
        F.sum("n_hashes").alias("mh"),
        F.sum(F.col("outside").cast("long")).alias("o"),
        F.sum(F.when(F.col("outside"), F.col("n_hashes")).otherwise(0)).alias("oh"),
    )
    sizes = written(sizes.select("zone", blocks(F.col("m"), F.col("mh")).alias("n_members"), blocks(F.col("o"), F.col("oh")).alias("n_probes")), "blocks")
    rows = at_stake.join(sizes, "zone").select("id", "zone", "comp", "outside", "n_members", "n_probes")
    rows = rows.join(sets.select(F.col("rep").alias("id"), "hashes"), "id")
    of = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("zone", of("n_members").alias("mb"), every("n_probes").alias("pb"), F.lit(False).alias("probe"), "id", "comp", "hashes")
    probes = rows.where("outside").select("zone", every("n_members").alias("mb"), of("n_probes").alias("pb"), F.lit(True).alias("probe"), "id", "comp", "hashes")
    cells = members.unionByName(probes).withColumnRenamed("id", "rep").groupBy("zone", "mb", "pb")
    return written(cells.applyInPandas(lambda cell: block_links(cell, threshold), "a long, b long"), "links")


def minhash_dedup(docs: DataFrame, width: int = 5, threshold: int = 80, loose: int = 50, text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``width``: words of a shingle; ``threshold``: percent of similarity that links.
    """
    sketch = written(sketches(docs, width, text_col), "sketches")
    known = sketch.where("set_key is not null and doc_id is not null")
    classes = written(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    firsts = known.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    banded = firsts.select(F.col("doc_id").alias("rep"), F.xxhash64("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    # one bucket may hold a third of all documents
    stars = written(join_salted(banded, written(hubs, "hubs"), "bucket", "node", "inner", salts=4).select("rep", "node", "lo", "hi").distinct(), "stars")
    wanted = stars.select("node", "rep").distinct()
    sets = written(sets_of(docs, wanted, width, text_col).dropDuplicates(["node"]), "sets")
    edges, beside = remainder(stars, hub_edges(stars, sets, threshold, loose), sets, threshold, loose)
    links = edges.where("linked").select("a", "b")
    links = links if beside is None else links.union(beside)
    linked = components(links)
    more = settled(edges, linked, sets, threshold)
    if more is not None and more.limit(1).count():
        linked = components(links.union(more))
    groups = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", "n", F.coalesce("component_id", "rep").alias("component_id"))
    found = join_weighted(sketch.select("doc_id", "n_shingles", "set_key"), written(groups, "groups"), ["set_key"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def audit_recall(docs: DataFrame, width: int = 5, threshold: int = 80, every: int = 50, text_col: str = "text") -> float:
    """Share of the links of the documents whose id ``every`` divides that lie within a component.

    These stated queries meet all documents on full sets, block against block.
    """
    found = written(minhash_dedup(docs, width, threshold, text_col=text_col).where("n_shingles > 0 and doc_id is not null").select("doc_id", "component_id").distinct(), "audit")
    sets = written(sets_of(docs, found.select(F.xxhash64("doc_id").alias("node"), F.col("doc_id").alias("rep")), width, text_col).join(found.withColumnRenamed("doc_id", "rep"), "rep"), "audit-sets")
    n_blocks = max(1, sets.count() // 1000)
    block = F.pmod(F.xxhash64("rep", F.lit(4)), F.lit(n_blocks)).cast("int")
    asked = sets.where(F.col("rep") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        linked = held = 0
        for rep, comp, x in zip(left["rep"], left["component_id"], left["hashes"], strict=True):
            for other, where, y in zip(right["rep"], right["component_id"], right["hashes"], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True)) if other != rep else 0
                if both and 100 * both >= threshold * (len(x) + len(y) - both):
                    linked, held = linked + 1, held + (comp == where)
        return pd.DataFrame({"linked": [linked], "held": [held]})

    cells = asked.groupBy("block").cogroup(sets.withColumn("block", block).groupBy("block"))
    linked, held = cells.applyInPandas(count, "linked long, held long").agg(F.sum("linked"), F.sum("held")).first()
    return held / linked if linked else 1.0


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with their columns."""
    dropped = minhash_dedup(docs, **parameters).where("not kept").select(F.col("doc_id").alias(spare(docs, "_dropped"))).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(dropped.columns[0]), "left_anti")
