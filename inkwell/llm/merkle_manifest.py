"""A Merkle manifest of documents with a proof for each, by pointer jumping (operator 12).

A document's leaf is the hash of its fields. The leaves of a source, by doc_id, are hashed in
runs of ``FANOUT`` until one node, the subroot, is left; the subroots, by source, likewise
give the root.

1. Leaves get their place in their source from ranges of (source, doc_id): a range numbers
   its own rows, and only the ranges' sizes are added up.
2. Each level is an aggregate of at most ``FANOUT`` children by (source, place div ``FANOUT``).
3. Each node above the leaves points to its parent and holds a segment: the siblings to its
   left and right on the way there. The table of nodes is joined to itself, so that a node
   takes over its ancestor's pointer and appends its segment; the distance doubles until all
   point to the root. Few nodes are ancestors at a distance, so that these are salted.
4. A leaf is the last to jump: its siblings and its parent's way to the root are one join,
   sixteen leaves a parent. A whole proof is hashed where that join makes it and never moves.

Defined cases: a null field is ``-``; null ids come first in their source and are never
tampered with, a null source is a source of its own and comes first; rows that share an id are
ordered by their leaf; a lone leaf is its subroot and a lone subroot the root, with no
siblings the proof is the hash of the empty string; with no rows there are none; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import discarded, join_salted, written

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Heights of nodes over the subroots start here.
TOP = 1000
STEP = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return hashed(*(field(F.col(c)) for c in FIELDS[:-1]), field(text))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered): a leaf's hash, and that of its text in lower case where the id's CRC says so."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = F.when(hit, leaf_of(F.translate("text", UPPER, LOWER)))
    tree = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))  # null first, then by bytes
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("digest"), changed.alias("tampered"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, written, with their ``place`` in their tree from 0 and the tree's number ``n`` of rows."""
    parts = written(rows.repartitionByRange("tree", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("tree", "_part").agg(F.count("*").alias("_n"))
    tree = W.partitionBy("tree")
    before = sizes.select("tree", "_part", (F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(tree).alias("n"))
    place = F.row_number().over(W.partitionBy("tree", "_part").orderBy(*order)) - 1 + F.col("_before")
    return written(parts.join(before, ["tree", "_part"]).withColumn("place", place.cast("long")).drop("_part", "_before"), "places")


def key(tree: Column, height: Column, place: Column) -> Column:
    return F.concat_ws("/", tree, height.cast("string"), place.cast("string"))


def levels(nodes: DataFrame, base: int) -> list[DataFrame]:
    """The nodes above ``nodes`` (tree, place, n, digest, node), level by level: with their children, written."""
    found = []
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct("place", "digest", "node")))
        groups = nodes.where("n > 1").groupBy("tree", F.expr(f"place div {FANOUT}").alias("place")).agg(children.alias("children"), F.max("n").alias("n"))
        height = F.lit(base + len(found) + 1)
        nodes = written(groups.select(
            "tree", height.alias("height"), "place", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "children",
            hashed(F.array_join("children.digest", "")).alias("digest"), key(F.col("tree"), height, F.col("place")).alias("node"),
        ), "levels")
        found.append(nodes)
        most = -(-most // FANOUT)
    return found


def edges(level: DataFrame) -> DataFrame:
    """(node, height, anc, segment): each child with its siblings on the way to its parent."""
    rows = level.select("node", F.col("height") - 1, "children.digest", F.posexplode("children")).toDF("anc", "height", "digests", "at", "child")
    left, right = F.slice("digests", F.lit(1), F.col("at")), F.slice("digests", F.col("at") + 2, F.lit(FANOUT))
    step = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
    return rows.select(F.col("child.node").alias("node"), "height", "anc", F.array(step).alias("segment"))


def ways_to_root(pointers: DataFrame, depth: int) -> DataFrame:
    """Pointers (node, height, anc, segment) to parents made pointers to the root, in rounds that double the distance."""
    now, distance = written(pointers, "pointers"), 1
    while distance < depth:
        # at this distance an ancestor stands at least so high
        ahead = now.where(F.col("height") > distance).select(F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("segment").alias("_segment"))
        jumped = join_salted(now, ahead, "anc", "node").select(
            "node", "height", F.coalesce("_anc", "anc").alias("anc"), F.concat("segment", F.coalesce("_segment", F.array().cast(STEP))).alias("segment")
        )
        before, now = now, written(jumped, "pointers")
        discarded(before)
        distance *= 2
    return now


def folded(digest: Column, way: Column) -> Column:
    """All digests from a node's own up to the root."""
    return F.aggregate(way, F.array(digest), lambda up, step: F.concat(up, F.array(hashed(step["left"], F.element_at(up, -1), step["right"]))))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves = placed(leaves_of(docs), ["doc_id", "digest"])
    lone = F.when(F.col("n") == 1, key(F.col("tree"), F.lit(0), F.col("place")))
    nodes = leaves.select("tree", F.lit(0).alias("height"), "place", "n", "digest", lone.alias("node"))
    inner = levels(nodes, 0)
    subroots = reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", "height", "digest", "node") for x in [nodes, *inner]])
    top_nodes = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "height", "digest", "node"), ["source"])
    top = levels(top_nodes, TOP)
    last = (top[-1] if top else top_nodes).where("n = 1").select("node", "height", "digest").first()
    if last is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    root = docs.sparkSession.createDataFrame([(last["node"], last["height"], last["node"], [])], f"node string, height int, anc string, segment {STEP}")
    pointers = reduce(DataFrame.unionByName, [root, *(edges(x) for x in inner[1:] + top)])
    ways = ways_to_root(pointers, len(inner) + len(top))

    # a leaf's parent with its children, or the leaf itself where it is alone
    nothing = F.array().cast("array<string>")
    above = ways.select("node", "segment")
    parents = inner[0].select("node", F.col("children.digest").alias("run")).join(above, "node") if inner else above.where("false").withColumn("run", nothing)
    alone = above.join(nodes.where("n = 1").select("node"), "node", "left_semi").withColumn("run", nothing)
    parent = F.when(F.col("n") > 1, key(F.col("tree"), F.lit(1), F.expr(f"place div {FANOUT}"))).otherwise(key(F.col("tree"), F.lit(0), F.col("place")))
    rows = leaves.withColumn("node", parent).join(parents.select("node", "run", "segment").unionByName(alone.select("node", "run", "segment")), "node")
    at = F.expr(f"int(place % {FANOUT})")
    own = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(FANOUT)), "").alias("right"))
    rows = rows.select("doc_id", "digest", "tampered", "n", F.when(F.col("n") > 1, F.concat(F.array(own), "segment")).otherwise(F.col("segment")).alias("way"))
    rows = rows.withColumn("up", folded(F.col("digest"), F.col("way")))
    steps = reduce(lambda found, k: F.when(F.col("n") > FANOUT**k, k + 1).otherwise(found), range(len(inner)), F.lit(0))
    refolded = F.when(F.col("tampered").isNull() | (F.col("tampered") == F.col("digest")), F.element_at("up", -1)).otherwise(F.element_at(folded(F.col("tampered"), F.col("way")), -1))
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), F.element_at("up", steps + 1).alias("subroot"), F.lit(last["digest"]).alias("root"),
        F.sha2(F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"), refolded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def levels_sql(name: str, first: str, n: int) -> str:
    """CTEs of ``n`` levels over ``first`` (tree, place, n, d), each with what stands left and right of a node."""
    found = f"{name}0 AS ({first})"
    for k in range(n):
        run = f"PARTITION BY tree, place // {FANOUT} ORDER BY place ROWS BETWEEN"
        found += f""",
{name}{k}s AS (SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT tree, place // {FANOUT} AS place, (max(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY place)) END AS d FROM {name}{k} GROUP BY tree, place // {FANOUT})"""
    return found


def oracle(tree_levels: int = 4, top_levels: int = 2) -> str:
    """DuckDB SQL for at most ``FANOUT ** tree_levels`` documents of a source and ``FANOUT ** top_levels`` sources."""

    def leaf(text: str) -> str:
        values = [*FIELDS[:-1], text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({v})::VARCHAR))::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"

    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
    ctes = levels_sql("a", "SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n, d, t, doc_id FROM leaf", 0)
    ctes += ",\n" + levels_sql("b", "SELECT tree, place, n, d FROM a0", tree_levels)
    ctes += ",\n" + levels_sql("c", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, d, tree AS source FROM b{tree_levels}", 0)
    ctes += ",\n" + levels_sql("e", "SELECT tree, place, n, d FROM c0", top_levels)
    joins, way = "FROM a0 JOIN c0 ON a0.tree = c0.source", "''"
    for name, own, tree, n in (("b", "a0.place", "a0.tree", tree_levels), ("e", "c0.place", "''", top_levels)):
        for k in range(n):
            s = f"{name}{k}s"
            joins += f" JOIN {s} ON {s}.tree = {tree} AND {s}.place = {own} // {FANOUT**k}"
            way += f" || CASE WHEN {s}.n = 1 THEN '' ELSE {s}.l || {s}.r END"
    steps = [("b", k) for k in range(tree_levels)] + [("e", k) for k in range(top_levels)]
    wide = ", ".join(f"{m}{k}s.{c} AS {m}{k}{c}" for m, k in steps for c in ("n", "l", "r"))
    folds = f"w AS (SELECT a0.doc_id, a0.d AS leaf, a0.t AS f, c0.d AS subroot, sha256({way}) AS proof_sha256, {wide} {joins})"
    last = "w"
    for i, (m, k) in enumerate(steps):
        folds += f",\nw{i} AS (SELECT * REPLACE (CASE WHEN {m}{k}n = 1 THEN f ELSE sha256({m}{k}l || f || {m}{k}r) END AS f) FROM {last})"
        last = f"w{i}"
    return f"""
WITH leaf AS (SELECT coalesce('1' || source, '0') AS tree, doc_id, {leaf("text")} AS d,
  CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS t FROM documents),
{ctes},
{folds}
SELECT doc_id, leaf, subroot, e{top_levels}.d AS root, proof_sha256, f AS folded_root, f = e{top_levels}.d AS verified FROM {last}, e{top_levels}
"""
