"""The folder reader, and files that are emitted when their pages are complete."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inkwell.sources import folders
from inkwell.streaming import files as sf
from inkwell.streaming import pages as sp


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for path, content in {
        "a.pdf": b"x", "_b.png": b"png", "sub/_SUCCESS": b"", "sub/deep/c": b"..%PDF-1.4", "sub/d.docx": b"PK\x03\x04%PDF-", "e.tar.gz": b"\x1f\x8b", "notes.txt": b"text",
        ".hidden.pdf": b"x", ".git/f.pdf": b"x", "__pycache__/g.pdf": b"x", "_temp/h.jpeg": b"jpeg",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / "empty").mkdir()
    os.symlink(root / "a.pdf", root / "link.pdf")
    os.symlink(root / "sub", root / "linked")
    return str(root)


def test_records_and_what_was_skipped(spark, tree):
    records, skipped = folders.records_and_skipped(folders.listing(spark, tree, content=True))
    found = {r["rel_path"]: (r["grp"], r["kind"], r["how"], r["size_bytes"]) for r in records.collect()}
    assert found == {"a.pdf": (".", "pdf", "extension", 1), "_b.png": (".", "image", "extension", 3), "sub/deep/c": ("sub/deep", "pdf", "content", 10), "_temp/h.jpeg": ("_temp", "image", "extension", 4)}
    assert {r["rel_path"]: r["reason"] for r in skipped.collect()} == {
        "sub/_SUCCESS": "unknown kind", "sub/d.docx": "unknown kind", "e.tar.gz": "archive", "notes.txt": "unknown kind", "link.pdf": "link", "linked": "link",
    }


def test_a_partition_for_each_directory_and_filters_in_the_listing(spark, tree):
    reader = folders.FolderReader({"path": tree, "content": "true"})
    assert sorted(p.value for p in reader.partitions()) == ["", "_temp", "empty", "sub", "sub/deep"]
    left = list(reader.pushFilters([folders.StringEndsWith(("name",), ".pdf"), folders.GreaterThan(("size_bytes",), 0), folders.EqualTo(("directory",), "")]))
    assert [type(f) for f in left] == [folders.EqualTo]
    assert [b.column(1)[0].as_py() for p in reader.partitions() for b in reader.read(p)] == ["a.pdf", "link.pdf"]
    rows = folders.listing(spark, tree).where(F.col("name").endswith(".pdf") & (F.col("size_bytes") > 0) & ~F.col("is_link")).collect()
    assert [(r["rel_path"], r["content"]) for r in rows] == [("a.pdf", None)]


def test_content_is_unread_unless_asked_for(spark, tree):
    os.chmod(f"{tree}/notes.txt", 0)
    assert folders.listing(spark, tree).where("content is not null").count() == 0
    assert folders.listing(spark, tree).count() == 10


def page_rows(files, seed=1):
    rng = random.Random(seed)
    rows = [(f, p, total, rng.randrange(3), 1000 + p) for f, (total, seen) in files.items() for p in range(seen)]
    rng.shuffle(rows)
    return rows


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "file bigint, page bigint, total_pages bigint, detections bigint, t bigint")
    df.select("file", "page", "total_pages", "detections", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def wanted(rows, status):
    found = {}
    for f in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == f and r[1] is not None}
        hits = ",".join(str(p) for p in sorted(own) if own[p][3] > 0)
        found[f] = (max(r[2] for r in own.values()), len(own), hits, sum(r[3] for r in own.values()), status(f))
    return found


def stream(spark, folder):
    return sf.completed_files(sp.landing(spark, folder, "*.parquet", sf.PAGES, 1), 60_000, "1 minute")


def test_files_over_triggers_and_a_restart(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "base")
    rows = page_rows({f: (4, 4) for f in range(8)} | {8: (5, 3), 9: (2, 2)})
    thirds = [rows[k::3] for k in range(3)]
    put(spark, folder, thirds[0])
    put(spark, folder, thirds[1] + thirds[0][:5])  # some pages come again
    first = sp.finished(stream(spark, folder), "append", base).collect()
    put(spark, folder, thirds[2])
    put(spark, folder, [(8, None, 5, 0, 1000)])
    both = sp.finished(stream(spark, folder), "append", base).collect()
    got = {r["file"]: tuple(r)[1:] for r in both}
    assert got == wanted(rows, lambda f: "incomplete" if f == 8 else "success")
    assert len(both) == 10 and {r["file"] for r in first} < set(got)


def test_files_are_given_up_when_time_passes(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "base")
    put(spark, folder, page_rows({1: (3, 2)}))
    put(spark, folder, [(2, 0, 1, 1, 5000)])  # an hour later
    put(spark, folder, [(3, 0, 1, 0, 6000)])
    got = {r["file"]: (r["seen_pages"], r["status"]) for r in sp.finished(stream(spark, folder), "append", base).collect()}
    assert got == {1: (2, "incomplete"), 2: (1, "success"), 3: (1, "success")}


def test_late_events_and_repeats_within_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    shape = "event_id bigint, t bigint, user_id bigint, event_type string, value double, props string"
    for rows in ([(1, 1000, 1, "a", 1.0, ""), (1, 1001, 1, "a", 2.0, ""), (2, 1002, 1, "a", 3.0, "")], [(3, 90000, 1, "a", 4.0, ""), (2, 1003, 1, "a", 5.0, "")], [(5, 90100, 1, "a", 6.0, "")], [(4, 1004, 1, "a", 6.0, ""), (3, 90001, 1, "a", 7.0, "")]):
        spark.createDataFrame(rows, shape).withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t").coalesce(1).write.mode("append").parquet(folder)
    got = sp.finished(sp.deduplicated(sp.landing(spark, folder, "*.parquet", files_per_trigger=1), ["event_id"]), "append").collect()
    assert sorted(r["event_id"] for r in got) == [1, 2, 3, 5]  # the last file's 4 is a day late
