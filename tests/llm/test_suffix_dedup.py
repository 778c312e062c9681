"""Repeated passages against a plain loop over all strings, and the defined cases."""

import collections
import hashlib
import random

import numpy as np
import pytest

from inkwell.llm import suffix_dedup
from tests.llm.test_operators import ODD, docs_of


def brute(texts, threshold):
    seen, found = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - threshold + 1):
            w = b[at : at + threshold]
            if w in seen:
                gone[at : at + threshold] = b"\1" * threshold
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone))
        found[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return found


def mixed_texts(seed):
    """Exact and near copies, passages at any offset, periods shorter and longer than a run, other scripts."""
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdefgh é漢") for _ in range(n))
    shared = [fresh(n) for n in (80, 99, 100, 101, 130, 300)]
    texts = [fresh(400) + rng.choice(shared) + fresh(rng.randrange(80)) + rng.choice(shared) for _ in range(40)]
    texts += [texts[3]] * 25 + [texts[5][:k] + "X" + texts[5][k:] for k in range(0, 600, 23)]
    texts += ["a" * 700, "ab" * 200, "abc " * 90, (fresh(75) + "\n") * 9, "a" * 99, "a" * 100, "", None, shared[4][7:]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "threshold"), [(1, 100), (2, 100), (3, 60)])
def test_equals_all_strings(spark, seed, threshold):
    texts = mixed_texts(seed)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs_of(spark, texts), threshold).collect()}
    assert found == brute(texts, threshold)


def test_one_passage_in_all_rows_over_many_ranges(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    texts = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs_of(spark, texts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute(texts, 100)


def strings_of(found):
    """By the text's row and a string's start, where its anchor stands."""
    return {(i, a - o): a for i, at, lo, hi in zip(*found[:4], strict=True) for a, o in [(int(at), o) for o in range(lo, hi + 1)]}


def test_runs_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    rng = random.Random(7)
    texts = [("".join(rng.choice("abcd") for _ in range(n)) + "z" * 400 + "xy" * 150).encode() for n in (3000, 5, 900)] + [b"a" * 99, b"a" * 100, b"q" * 130, b""]
    apart = [[np.concatenate(c) for c in zip(*([np.full(len(x[0]), i), *x] for x in suffix_dedup.Runs(100).of_long(t)), strict=True)] for i, t in enumerate(texts) if len(t) >= 100]
    whole = strings_of([np.concatenate(c) for c in zip(*apart, strict=True)])
    assert sorted(whole) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)]
    for piece, together in ((331, 10), (331, 5000), (1 << 20, 1 << 17), (1 << 20, 1500)):
        monkeypatch.setattr(suffix_dedup, "PIECE", max(piece, together))
        monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
        found = [np.concatenate(c) for c in zip(*suffix_dedup.Runs(100)(texts), strict=True)]
        assert strings_of(found) == whole


def test_defined_cases(spark):
    long = "some words that go on and on until there are over a hundred of them, which makes a string of its own kind"
    rows = [*ODD, (9, long), (9, long), (9, long), (None, long), (None, long), (8, "x" + long)]
    found = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(docs_of(spark, rows)).collect())
    n = len(long)
    assert {k: v for k, v in found.items() if k[1] in (n, n + 1)} == {(9, n, n): 3, (None, n, n): 2, (8, n + 1, 0): 1}
    assert found[4, 150000, 149995] == 1  # one word is left of its repetition
    assert sum(found.values()) == len(rows) and found[0, 0, 0] == found[1, 0, 0] == 1
    assert suffix_dedup.suffix_dedup(docs_of(spark, [])).collect() == []


def test_remaining_bytes_are_the_texts_without_the_spans(spark):
    texts = mixed_texts(4)
    whole = {i: (t or "").encode() for i, t in texts}
    for r in suffix_dedup.without_repeats(docs_of(spark, texts)).collect():
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"] and hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert r["n_removed"] or bytes(r["kept"]) == whole[r["doc_id"]]
