"""Links by parts of names, floor trials, archive kinds and shared signers against loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import strings
from inkwell.operators import crossref, links, pairs
from inkwell.operators.staging import leading_values, ranked_within
from inkwell.sources import archives


def linked_by_loops(files, records):
    """The four strategies, one after the other over all records in their order."""
    found = {}
    base = lambda p: p.rsplit("/", 1)[-1]
    for key, path in files:
        name = base(path)
        part = name.replace(".png", "").replace(".jpg", "").replace(".jpeg", "")
        tests = [
            lambda r: r[1] == path, lambda r: r[1] is not None and base(r[1]) == name,
            lambda r: bool(r[2]) and part in r[2], lambda r: r[1] is not None and any(t in name for t in base(r[1]).split("_")[:2]),
        ]
        found[key] = next(((no, r[0], r[2]) for no, test in enumerate(tests, 1) for r in records if test(r)), (0, None, part))
    return found


@pytest.mark.parametrize(("seed", "empty"), [(1, False), (2, False), (3, True)])
def test_links_against_loops(spark, seed, empty):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    files = [(k, f"f/{word(rng.randrange(1, 5))}_{word(3)}{rng.choice(['.png', '.jpg', ''])}") for k in range(60)]
    files += [(60, "f/.png"), (61, "f/zzzzzz.png"), (62, "f/q")]
    records = []
    for k in range(80):
        path = rng.choice([rng.choice(files)[1], "g/" + rng.choice(files)[1].split("/")[1], f"h/{word(rng.randrange(1, 7))}_{word(2)}_{word(3)}", f"h/x{word(9)}y_z{word(8)}", None])
        records.append((k, path, rng.choice([None, "", word(9), word(30)]), 1.0))
    if empty:
        records += [(80, "h/_a_b.png", "id", 2.0)]
    rng.shuffle(records)
    got = links.linked(spark.createDataFrame(files, "k long, path string"), spark.createDataFrame(records, "ord long, path string, unique_id string, value double"), "k").collect()
    assert {r["k"]: (r["strategy"], r["ord"], r["unique_id"]) for r in got} == linked_by_loops(files, sorted(records, key=lambda r: r[0]))
    assert len(got) == len(files)


def test_a_common_gram_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(links, "POSTINGS", 10)
    texts = [f"common{k}" for k in range(200)]
    got = links.containing(spark.createDataFrame([(p,) for p in ("common", "mon1", "x", "on", "", "common19")], "pattern string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert sorted(map(tuple, got)) == sorted((p, t) for p in ("common", "mon1", "on", "common19") for t in texts if p in t)


def test_floor_trials_are_the_least_of_all_cross_writer_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), None if i % 9 == 8 else f"w{i % 3}", rng.normal(size=4).tolist()) for i in range(-20, 60)]
    df = spark.createDataFrame(rows, "sig_id long, writer string, v array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    far = [(int(pairs.pair_digest(np.int64(a), np.int64(b), 42)), a, b) for (a, x, _), (b, y, _) in itertools.combinations(rows, 2) if x and y and x != y]
    for block in (7, 1000):
        got = [tuple(r) for r in pairs.floor_trials(df, 30, block_rows=block).collect()]
        assert [(d, a, b) for a, b, d, _ in got] == sorted(far)[:30]
        assert all(abs(c - unit[a] @ unit[b]) < 1e-12 for a, b, _, c in got)
    assert pairs.floor_trials(df.where("writer = 'w1'"), 30).collect() == []


def test_digest_in_sql(spark):
    import duckdb

    for a, b in ((1, 2), (-5, 10**15), (2**31, 2**40)):
        assert duckdb.connect().execute(f"SELECT {pairs.digest_sql(f'({a})::BIGINT', f'({b})::BIGINT', 7)}").fetchone()[0] == int(pairs.pair_digest(np.int64(a), np.int64(b), 7))


def test_archive_kinds(spark):
    zip_, rar, gz = b"PK\x03\x04....", b"Rar!\x1a\x07\x00..", b"\x1f\x8b\x08...."
    cases = {
        "a.zip": (b"", "zip"), "a.docm": (zip_, None), "a.kmz": (zip_, None), "a.whl": (zip_, None), "x.tbz": (b"BZh9", "tar"), "x.TBZ": (b"", "tar"), "bundle": (rar, "rar"), "t.part2.rar": (rar, None),
        "t.part1.rar": (rar, "rar"), "t.part01.rar": (rar, None), "t.part10.rar": (rar, None), "t.r00": (rar, None), "t.z01": (zip_, None), "logs.gz": (gz, "tar"), "b.dat": (zip_, "zip"), "c": (b"PK\x05\x06", "zip"),
        "d": (b"x" * 257 + b"ustar", "tar"), "e.7z": (b"7z\xbc\xaf\x27\x1c", "7z"), "f": (b"\xfd7zXZ\x00", "tar"), "g.txt": (b"plain", None), "h": (b"", None), "i.tar.gz": (b"", "tar"),
    }
    df = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in cases.items()], "name string, content binary")
    got = df.select("name", strings.container_kind(F.col("name"), F.col("content")).alias("k"), archives.is_archive(F.col("name"), F.col("content")).alias("is"), strings.archive_stem(F.col("name")).alias("stem")).collect()
    assert {r["name"]: r["k"] for r in got} == {n: k for n, (_, k) in cases.items()}
    assert all(r["is"] == (r["k"] is not None) for r in got)
    stems = {r["name"]: r["stem"] for r in got}
    assert (stems["i.tar.gz"], stems["x.TBZ"], stems["a.docm"], stems["h"]) == ("i", "x", "a", "h")


def test_archives_that_nothing_opens(spark):
    df = spark.createDataFrame([("a.rar", bytearray(b"Rar!\x1a\x07\x00")), ("b.7z", bytearray(b"7z\xbc\xaf\x27\x1c"))], "rel_path string, content binary")
    manifest = archives.extraction_manifest(archives.unpack_all(df)).collect()
    assert {(r["archive"], r["status"], r["files"]) for r in manifest} == {("a.rar", "unsupported", 0), ("b.7z", "unsupported", 0)}


@pytest.mark.parametrize("least", [1, 3])
def test_shared_signers_by_bitmaps(spark, least):
    rng = random.Random(4)
    sets = {d: {rng.randrange(200) for _ in range(rng.randrange(1, 40))} | ({7} if d % 3 else set()) for d in range(70)}
    df = spark.createDataFrame([(d, s, k) for d, own in sets.items() for s in own for k in range(2)], "pdf long, signer long, k int")
    want = sorted((a, b, len(sets[a] & sets[b]), ",".join(map(str, sorted(sets[a] & sets[b])))) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least)
    for block in (9, 1000):
        assert sorted(map(tuple, crossref.shared_signers(df, least=least, block_rows=block).collect())) == want


def test_targets_meet_all_parts_of_the_signers(spark, monkeypatch):
    matches = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.7), (2, None, 0.1), (3, "b", 0.9)], "pdf long, signer string, similarity double")
    signers = spark.createDataFrame([(s,) for s in "abcdefg"], "signer string")
    whole = sorted(map(tuple, crossref.by_target_and_signer(matches, signers).collect()))
    monkeypatch.setattr(crossref, "SIGNERS", 2)
    assert sorted(map(tuple, crossref.by_target_and_signer(matches, signers).collect())) == whole
    assert len(whole) == 21 and (1, "a", 2, 0.6, 0.7, 0.5) in whole and (2, "g", 0, 0.0, 0.0, 0.0) in whole


def test_leading_values(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(3000)) for k in (0, 0, 0, 1) for _ in range(800)]
    got = leading_values(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", 50, 7).collect()
    assert {r["k"]: r["first"] for r in got} == {k: sorted({v for j, v in rows if j == k})[:50] for k in (0, 1)}


def test_places_within_keys_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k) for k in rng.sample(range(10**6), 500)]
    got = ranked_within(spark.createDataFrame(rows, "s string, k long"), "s", ["k"], "rn").collect()
    want = {(s, k): n for s in ("a", "b", None) for n, k in enumerate(sorted(k for t, k in rows if t == s), 1)}
    assert {(r["s"], r["k"]): r["rn"] for r in got} == want and len(got) == 500
