"""What the third round's review found."""

import io
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from inkwell.operators import boxes, clusters, pairs, regions, ward
from inkwell.plans import registry
from inkwell.sources import archives
from inkwell.streaming import files


def by_sql(folder, sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(sql).fetchall()


def test_defaults_leave_other_noughts_and_nulls(spark, tmp_path):
    ids, values = [1, 2, 3, 5, 7, 11, 13, None], [0.0, 0.0, 4.0, None, -0.0, 2.5, float("nan"), 1.5]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "value": pa.array(values, pa.float64())}), tmp_path / "events.parquet")
    got = registry.queries()["c40_defaults"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, by_sql(tmp_path, registry.oracle_sql()["c40_defaults"], "events")))


def test_every_document_is_in_the_summary(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 64)).astype("float32")
    pq.write_table(pa.table({"vec_id": pa.array(range(500), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array([i % 7 for i in range(500)], pa.int32())}), tmp_path / "embeddings.parquet")
    got = sorted(map(tuple, registry.queries()["b7_pdf_summary"](spark, str(tmp_path)).collect()))
    assert [r[0] for r in got] == list(range(10)) and all(r[3] == 50 * 49 // 2 for r in got)
    assert got == sorted(by_sql(tmp_path, registry.oracle_sql()["b7_pdf_summary"], "embeddings"))


def test_what_pairs_send_grows_with_the_marks(spark):
    rows = spark.range(60).selectExpr("id AS sig_id", "array(1.0D, cast(id AS double)) AS v")
    assert pairs.block_cells(rows, 1, "v", []).count() <= pairs.MOST_BLOCKS * 60
    assert pairs.blocked_pairs(rows, -2.0, block_rows=1).count() == 60 * 59 // 2


def test_upper_digests_of_all_pairs():
    ids = np.array([-5, 0, 1, 2**31 - 1, 2**31 - 2, 2**40, 2**62], np.int64)
    want = pairs.pair_digest(ids[:, None], ids[None], 42) // (pairs.PRIME + 1)
    assert (pairs.upper_digest(ids, ids, 42) == want).all()


def test_density_clusters_without_a_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=6) + rng.normal(scale=0.5, size=(n, 6)) for n in (12, 9, 3, 1, 1)] + [rng.normal(size=(25, 6))])
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "sig_id long, v array<double>")
    edges = pairs.blocked_pairs(df, 0.85).selectExpr("sig_a AS a", "sig_b AS b")
    want = sorted(map(tuple, clusters.density_clusters(df, edges, 3).collect()))
    monkeypatch.setattr(clusters, "blocked_pairs", None)
    for block in (7, 2000):
        assert sorted(map(tuple, clusters.blocked_density(df, 0.85, 3, block).collect())) == want
    assert {-1} < {label for _, label in want}


def test_copies_take_no_rounds(spark):
    x = np.repeat(np.eye(6)[:3], 40, axis=0)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "pdf long, sig_id long, v array<double>")
    tree = ward.ward_tree(df, ["pdf"], 10).collect()
    assert len(tree) == 119 and len({r["b"] for r in tree}) == 119 and max(r["step"] for r in tree) <= 2
    assert sum(r["d"] == 0 for r in tree) == 117


def test_a_prediction_is_one_row_for_all_overlaps_and_sizes(spark, monkeypatch):
    rng, written, real = np.random.default_rng(8), [], boxes.materialised
    monkeypatch.setattr(boxes, "materialised", lambda df: written.append(real(df)) or written[-1])
    shape = "page long, id long, score double, b struct<x0:double,y0:double,x1:double,y1:double>, label long"
    truths = [(i % 9, 1000 + i, 0.0, (20.0 * i, 0.0, 20.0 * i + 10, 10.0), i % 2) for i in range(90)]
    found = [(p, i, float(rng.integers(0, 5)), (b[0] + float(rng.integers(0, 5)), 0.0, b[2], 10.0), label) for p, i, _, b, label in truths]
    found += [(0, 5000 + i, 9.0, (0.0, 0.0, 5.0, 5.0), 7) for i in range(9)]  # a label without truths
    table = boxes.benchmark_table(spark.createDataFrame(found, shape), spark.createDataFrame(truths, shape)).collect()
    assert len(table) == 2 * 2 * 10 and {r["label"] for r in table} == {0, 1}
    for least in (0.5, 0.75, 0.9):
        for label in (0, 1):
            order = sorted((f for f in found if f[4] == label), key=lambda f: (-f[2], f[0], f[1]))
            hits = np.cumsum([(f[3][2] - f[3][0]) / 10 >= least for f in order])
            curve = [(h / 45, h / (k + 1)) for k, h in enumerate(hits)]
            want = sum(max((p for r, p in curve if r + 1e-11 >= k / 100), default=0.0) for k in range(101)) / 101
            got = next(r for r in table if (r["label"], r["size"], r["overlap"]) == (label, "all", least))
            assert got["truths"] == 45 and abs(got["ap"] - want) < 1e-9 and abs(got["ar"] - hits[-1] / 45) < 1e-9
    assert max(w.count() for w in written if "page" in w.columns) == len(found)


def test_members_leave_in_batches_of_bounded_size():
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])
    taken = []
    rows = (taken.append(i) or (f"m{i}", bytes(3000)) for i in range(2500))
    first = next(archives.in_batches(rows, schema, most_rows=1000, most_bytes=30_000))
    assert first.num_rows == len(taken) == 10  # no more is held than a batch
    sizes = [b.num_rows for b in archives.in_batches(((f"m{i}", None if i % 2 else b"x") for i in range(2500)), schema, most_rows=1000)]
    assert sizes == [1000, 1000, 500]  # small archives share a batch


def test_members_of_many_small_archives(spark):
    def zipped(i):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.txt", str(i))
            z.writestr("b.txt", "b" * i)
        return out.getvalue()

    df = spark.createDataFrame([(f"{i}.zip", zipped(i)) for i in range(300)] + [("bad.zip", b"no")], "rel_path string, content binary").coalesce(1)
    found = archives.unpacked(df, 0, 100)
    got = {(r["archive"], r["member"]): (r["status"], r["size_bytes"], r["content"] and len(r["content"])) for r in found.collect()}
    assert len(got) == 601 and got["bad.zip", ""] == ("bad", 2, None) and got["7.zip", "b.txt"] == ("ok", 7, 7) and got["200.zip", "b.txt"] == ("too_large", 200, None)


class Kept:
    """A file's state, and the calls on it."""

    def __init__(self):
        self.pages, self.about, self.calls = {}, None, []

    def get(self):
        return self.about

    def update(self, about):
        self.about = about

    def containsKey(self, key):
        self.calls.append("containsKey")
        return key in self.pages

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        self.pages[key] = value

    def iterator(self):
        return iter(self.pages.items())

    def clear(self):
        self.pages, self.about = {}, None

    def registerTimer(self, at):
        self.calls.append(at)

    deleteTimer = registerTimer


def test_files_ask_and_keep_no_more_than_they_must():
    one, state = files.Files(1000), Kept()
    one.handle = one.pages = one.about = state
    rows = lambda *r: iter([pd.DataFrame(r, columns=["page", "total_pages", "detections", "ts"])])
    at = pd.Timestamp(100, unit="s", tz="UTC")
    whole = list(one.handleInputRows((5,), rows((1, 2, 3, at), (2, 2, 0, at)), None))
    assert [tuple(r) for r in whole[0].itertuples(index=False)] == [(5, 2, 2, "1", 3, "success")] and state.calls == []
    assert not list(one.handleInputRows((5,), rows((1, 3, 3, at), (1, 3, 4, at)), None)) and state.calls == ["updateValue", 101000]
    assert not list(one.handleInputRows((5,), rows((2, 3, 1, at)), None)) and state.calls[2:] == ["containsKey", "updateValue"]
    last = list(one.handleInputRows((5,), rows((None, 3, None, at)), None))
    assert [tuple(r) for r in last[0].itertuples(index=False)] == [(5, 3, 2, "1,2", 5, "incomplete")] and state.about is None and state.calls[-1] == 101000


def test_pixels_of_a_tile_travel_together(spark):
    rows = [(p, y, x) for p in (0, None) for y in range(20) for x in range(0, 20, 2)] * 2  # every pixel comes twice
    pixels = spark.createDataFrame(rows, "page long, y long, x long").coalesce(1)
    assert regions.packed(pixels, ["page"], 64).count() == 2
    got = regions.tile_parts(pixels, ["page"], 64).collect()
    assert len(got) == 20 and {(r["n"], r["y0"], r["y1"]) for r in got} == {(20, 0, 19)}
