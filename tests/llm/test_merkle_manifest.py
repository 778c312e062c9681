"""Manifests against a plain build of the tree, and the defined cases."""

import hashlib
import random
import zlib

import pytest

from inkwell.llm import merkle_manifest
from tests.llm.test_operators import docs_of


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """(root, steps of each leaf): left and right siblings, level by level."""
    steps = [[] for _ in digests]
    nodes = [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for run in runs:
            for at, (_, below) in enumerate(run):
                for i in below:
                    steps[i].append(("".join(d for d, _ in run[:at]), "".join(d for d, _ in run[at + 1 :])))
        nodes = [(h(*(d for d, _ in run)), [i for _, below in run for i in below]) for run in runs]
    return nodes[0][0], steps


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs, found = [], []
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([sub for _, sub, _ in subs])
    for (own, sub, steps), top in zip(subs, tops, strict=True):
        for r, way in zip(own, steps, strict=True):
            way = way + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else leaf(r)
            for left, right in way:
                now = h(left, now, right)
            found.append((str(r[0]), leaf(r), sub, root, h(*(x + y for x, y in way)), now, now == root))
    return sorted(found)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(-5000, 100000), sum(sizes.values()))
    texts = ["Some Text", "no capitals", "", None, "ÄÖ \U0001f642 漢 É"]
    return [(ids.pop(), s, rng.choice(["en", None]), rng.choice([1, -7, None]), f"{rng.choice(texts)}{k % 7}" if k % 11 else rng.choice(texts)) for s, n in sizes.items() for k in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place int, n string, digest int, tree int"


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)
    return sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in merkle_manifest.merkle_manifest(df).collect())


@pytest.mark.parametrize("sizes", [
    {"b": 300, "a": 16, "c": 17, None: 1, "é": 15, "": 2},
    {"only": 1}, {"only": 2}, {"only": 257}, {f"s{k}": 1 + k % 3 for k in range(40)},
])
def test_equals_a_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    assert result(spark, rows) == brute(rows)


def test_null_and_shared_ids_and_repeated_rows(spark):
    rows = [(None, "a", "en", 1, "X"), (None, "a", "en", 1, "Y"), (5, "a", None, 2, "Same"), (5, "a", None, 2, "Same"), (5, "a", None, 2, "other"), (2, None, None, None, None)]
    assert result(spark, rows) == brute(rows)


def test_tampering_shows_where_letters_change(spark):
    rows = rows_of({"a": 200, "b": 30}, 3)
    found = {r[0]: r[-1] for r in result(spark, rows)}
    for i, *_, text in rows:
        changed = zlib.crc32(str(i).encode()) % 5 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert found[str(i)] is not changed


def test_no_rows(spark):
    assert merkle_manifest.merkle_manifest(docs_of(spark, [])).collect() == []
