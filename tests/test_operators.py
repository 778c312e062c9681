"""Order-dependent operators against plain loops, and edge cases by hand."""

import bz2
import gzip
import io
import lzma
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import geometry, rasters, strings, vectors, verdicts
from inkwell.operators import boxes, calibration, clusters, crossref, duplicates, pairs, staging
from inkwell.sources import archives, files, sinks

BOX = "page long, id long, score double, b struct<x0:double,y0:double,x1:double,y1:double>"


def random_boxes(rng, n, pages=4):
    out = []
    for i in range(n):
        x, y, w, h = rng.integers(0, 60), rng.integers(0, 60), rng.integers(5, 40), rng.integers(5, 40)
        out.append((int(rng.integers(pages)), i, float(rng.integers(0, 8)) / 8, (float(x), float(y), float(x + w), float(y + h))))
    return out


def overlap(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_suppression_against_a_loop(spark, seed):
    rows = random_boxes(np.random.default_rng(seed), 120)
    want = set()
    for page in range(4):
        kept = []
        for p, i, s, b in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[2], r[1])):
            if all(overlap(b, k) / min(area(b), area(k)) < 0.7 for k in kept):
                kept.append(b)
                want.add(i)
    got = boxes.suppress_nested(spark.createDataFrame(rows, BOX), ["page"])
    assert {r["id"] for r in got.collect()} == want


@pytest.mark.parametrize("seed", [3, 4])
def test_greedy_matches_against_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    guesses, truths = random_boxes(rng, 80), [(p, i + 1000, s, b) for p, i, s, b in random_boxes(rng, 60)]
    want = {}
    for page in range(4):
        free = {i: b for p, i, _, b in truths if p == page}
        for _, i, _, b in sorted((r for r in guesses if r[0] == page), key=lambda r: (-r[2], r[1])):
            ranked = sorted((-(overlap(b, t) / (area(b) + area(t) - overlap(b, t))), j) for j, t in free.items())
            want[i] = ranked[0][1] if ranked and -ranked[0][0] >= 0.2 else None
            free.pop(want[i], None)
    got = boxes.greedy_matches(spark.createDataFrame(guesses, BOX), spark.createDataFrame(truths, BOX), "page", 0.2)
    assert {r["id"]: r["truth_id"] for r in got.collect()} == want


def test_grid_reconciliation_equals_the_plain_one(spark):
    rng = np.random.default_rng(5)
    x = spark.createDataFrame(random_boxes(rng, 60), BOX)
    roles = ["ink", "placed_image", "full_page_scan", "other"]
    o = spark.createDataFrame([(p, i, roles[i % 4], b) for p, i, _, b in random_boxes(rng, 40)], "page long, id long, role string, b struct<x0:double,y0:double,x1:double,y1:double>")
    a = sorted(map(tuple, boxes.reconcile(x, o, ["page"]).collect()))
    assert a == sorted(map(tuple, boxes.reconcile_on_grid(x, o, ["page"], cell=16.0).collect()))


def marks(spark, n=60, groups=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, i % groups, rng.normal(size=4).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sig_id long, pdf long, v array<double>")


def unit(v):
    return np.array(v) / np.linalg.norm(v)


@pytest.mark.parametrize("assign", ["first", "last"])
def test_leader_clusters_against_a_loop(spark, assign):
    rows, df = marks(spark)
    want = {}
    for pdf in range(3):
        own = [(i, unit(v)) for i, p, v in rows if p == pdf]
        labels = {}
        leaders = []
        for i, v in own:
            if not any(v @ u >= 0.6 for _, u in leaders):
                leaders.append((i, v))
        for no, (i, v) in enumerate(leaders):
            labels[i] = no
            for j, u in own:
                if j > i and u @ v >= 0.6 and j not in [x for x, _ in leaders] and (assign == "last" or j not in labels):
                    labels[j] = no
        want |= labels
    got = {r["sig_id"]: r["label"] for r in clusters.leader_clusters(df, ["pdf"], 0.6, assign).collect()}
    assert got == want


def test_corpus_leaders_in_rounds(spark):
    rows, df = marks(spark, 90)
    want = []
    for i, _, v in rows:
        if not any(unit(v) @ u >= 0.6 for _, u in want):
            want.append((i, unit(v)))
    got = clusters.leading(df, clusters.neighbours(df, [], 0.6), [])
    assert sorted(r["sig_id"] for r in got.collect()) == [i for i, _ in want]


def test_pivot_signers_are_all_or_an_error(spark):
    signers = spark.createDataFrame([(w,) for w in (3, 1, 2, 3)], "writer int")
    assert crossref.pivot_signers(signers, most=3) == [1, 2, 3]
    with pytest.raises(ValueError, match="f25"):
        crossref.pivot_signers(signers, most=2)


def test_blocked_pairs(spark):
    rows, df = marks(spark, 50)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and unit(a[2]) @ unit(b[2]) >= 0.5}
    got = pairs.blocked_pairs(df, 0.5, block_rows=12).collect()
    assert {(r["sig_a"], r["sig_b"]) for r in got} == want and len(got) == len(want)


def test_best_signer_in_blocks(spark):
    rows, df = marks(spark, 40)
    refs = [(i % 3, v) for i, _, v in rows if i < 10]
    asked = spark.createDataFrame(refs, "writer long, v array<double>")
    want = []
    for i, _, v in rows:
        s, w = max(((max(float(unit(v) @ unit(u)), 0.0), -w) for w, u in refs))
        want.append((i, -w if s >= 0.5 else None, round(s, 9)))
    for block in (4000, 7):
        got = pairs.best_signers(df.select("sig_id", "v"), asked, 0.5, block_rows=block).collect()
        assert sorted((a, b, round(c, 9)) for a, b, c in got) == want


def test_top_pairs_without_a_floor(spark):
    rows, df = marks(spark, 30)
    every = sorted(((-(unit(a[2]) @ unit(b[2])), a[0], b[0]) for a in rows for b in rows if a[0] < b[0]))
    for k, block in ((50, 7), (10_000, 1000)):
        got = pairs.blocked_top(df, k, block_rows=block).collect()
        assert [(r["sig_a"], r["sig_b"]) for r in got] == [(a, b) for _, a, b in every[:k]]


def test_ranks_and_running_totals(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(3)), int(rng.integers(10)), int(rng.integers(5))) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, g long, x long, n long").repartition(3)
    placed = {r["i"]: r["place"] for r in staging.ranked(df, ["x", "i"], "place").collect()}
    assert placed == {i: k + 1 for k, (_, i) in enumerate(sorted((x, i) for i, _, x, _ in rows))}
    got = {r["i"]: r["run_n"] for r in boxes.running_totals(df, ["g"], ["x", "i"], ["n"]).collect()}
    assert got == {i: sum(n for j, h, y, n in rows if h == g and (y, j) <= (x, i)) for i, g, x, _ in rows}


def silhouette_of(x, labels):
    d = 1 - x @ x.T
    total = 0.0
    for i, own in enumerate(labels):
        same = [j for j, c in enumerate(labels) if c == own and j != i]
        if same:
            a, b = d[i, same].mean(), min(d[i, [j for j, c in enumerate(labels) if c == o]].mean() for o in set(labels) - {own})
            total += (b - a) / max(a, b)
    return total / len(x)


def dbscan_of(x, floor, need):
    n = len(x)
    near = [[j for j in range(n) if x[i] @ x[j] >= floor - 1e-12] for i in range(n)]  # itself included
    core, label = [len(v) >= need for v in near], [-1] * n
    for i in range(n):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = i
                        todo.append(j)
    return [label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i in range(n)]


def ward_of(x, k):
    d = {(i, j): 1 - x[i] @ x[j] for i in range(len(x)) for j in range(i)}
    members = {i: [i] for i in range(len(x))}
    get = lambda a, b: d[max(a, b), min(a, b)]
    while len(members) > k:
        _, i, j = min((get(a, b), min(a, b), max(a, b)) for a in members for b in members if a < b)
        for m in members:
            if m not in (i, j):
                ni, nj, nm = len(members[i]), len(members[j]), len(members[m])
                d[max(i, m), min(i, m)] = (((nm + ni) * get(i, m) ** 2 + (nm + nj) * get(j, m) ** 2 - nm * get(i, j) ** 2) / (ni + nj + nm)) ** 0.5
        members[i] += members.pop(j)
    return [next(c for c, m in members.items() if i in m) for i in range(len(x))]


def adaptive_of(x):
    """(method, labels) of the three methods tried one after the other."""
    n, tried = len(x), []
    best = (-1.0, None)
    for k in range(2, min(n - 1, 8) + 1):
        labels = ward_of(x, k)
        if silhouette_of(x, labels) > best[0] + 1e-12:
            best = (silhouette_of(x, labels), labels)
    tried.append(("hierarchical", best[1]))
    labels, leads = [-1] * n, []
    for i in range(n):
        if labels[i] < 0:
            leads.append(i)
            labels[i] = i
            for j in range(i + 1, n):
                labels[j] = i if x[i] @ x[j] >= clusters.LEADER else labels[j]
    tried.append(("threshold", labels))
    best = (-1.0, list(range(n)))
    for eps in clusters.EPS:
        for need in clusters.SAMPLES:
            labels = dbscan_of(x, 1 - eps, need)
            live = [i for i in range(n) if labels[i] >= 0]
            if len({labels[i] for i in live}) > 1:
                s = silhouette_of(x[live], [labels[i] for i in live])
                best = (s, labels) if s > best[0] + 1e-12 else best
    tried.append(("dbscan", best[1]))
    valid = [(m, c) for m, c in tried if 2 <= len(set(c)) < n]
    top = max(silhouette_of(x, c) for _, c in valid)
    return next((m, c) for m, c in valid if silhouette_of(x, c) > top - 1e-12)


def parted(labels):
    """The groups of equal labels, by position."""
    return {frozenset(i for i, c in labels.items() if c == own) for own in labels.values()}


@pytest.mark.parametrize(("seed", "scale"), [(1, 0.35), (2, 0.9)])
def test_adaptive_clusters_against_loops(spark, seed, scale):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6)) * 2
    rows = [(g * 100 + i, g, (centres[(i + g) % 4] + rng.normal(scale=scale, size=6)).tolist()) for g in range(2) for i in range(18)]
    rows += [(300, 2, [1.0] * 6), (301, 2, [1.0] * 5 + [1.1]), (302, 3, [1.0] * 6)]  # two alike, and one alone
    df = spark.createDataFrame(rows, "sig_id long, pdf long, v array<double>")
    got = clusters.adaptive_clusters(df, ["pdf"]).collect()
    assert len(got) == len(rows)
    for g in range(2):
        method, labels = adaptive_of(np.array([unit(v) for _, p, v in rows if p == g]))
        assert {r["method"] for r in got if r["pdf"] == g} == {method}
        assert parted({r["sig_id"] - g * 100: r["label"] for r in got if r["pdf"] == g}) == parted(dict(enumerate(labels)))
    assert len({r["label"] for r in got if r["pdf"] == 2}) == 1
    two = clusters.two_level_clusters(df.where("pdf < 2")).collect()
    first = parted({r["sig_id"]: r["level1"] for r in two})
    assert first == parted({r["sig_id"]: r["label"] for r in clusters.adaptive_clusters(df.where("pdf < 2")).collect()})
    for group in first:
        inside = {r["sig_id"]: r["label"] for r in two if r["sig_id"] in group}
        if len(group) > 2:
            ids = sorted(group)
            labels = adaptive_of(np.array([unit(v) for i, _, v in rows if i in group]))[1]
            assert parted(inside) == parted(dict(zip(ids, labels)))
        assert {r["confidence"] for r in two if r["sig_id"] in group} == {1.0 if len(group) == 1 else 0.8}


def test_ward_cuts_and_profiles(spark):
    rng = np.random.default_rng(3)
    x = np.array([unit(v) for v in rng.normal(size=(25, 5))])
    for k, labels in clusters.ward_cuts(x, 8).items():
        assert len(set(labels)) == k and parted(dict(enumerate(labels))) == parted(dict(enumerate(ward_of(x, k))))
    df = spark.createDataFrame([(i, i // 10, v.tolist()) for i, v in enumerate(x)], "sig_id long, pdf long, v array<double>")
    own = {i: 0 if i == 7 else 1 + i % 3 for i in range(25)}
    got = {r["label"]: r for r in clusters.signer_profiles(df, spark.createDataFrame(list(own.items()), "sig_id long, label long")).collect()}
    for label, r in got.items():
        ids = [i for i in own if own[i] == label]
        mean = np.mean([x[a] @ x[b] for a in ids for b in ids if a < b]) if len(ids) > 1 else 0.5
        assert (r["n_signatures"], r["representative"]) == (len(ids), min(ids)) and abs(r["confidence"] - mean) < 1e-9
        assert r["documents"] == ",".join(map(str, sorted({i // 10 for i in ids})))


def test_duplicate_levels(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(10, rows[0][1]), (11, rows[0][1])]  # equal streams
    rows += [(12, (base[1] * 3 + 2).tolist())]  # equal pixels
    low = base[2].copy()
    low[np.argmin(np.abs(low))] *= -1  # one sign bit
    rows += [(13, low.tolist()), (14, (base[3] + rng.normal(scale=1.0, size=64)).tolist())]
    got = duplicates.levels(spark.createDataFrame(rows, "sig_id long, v array<double>")).collect()
    assert sorted(map(tuple, got)) == [("L0", 0, 10), ("L0", 0, 11), ("L1", 1, 12), ("L2", 2, 13)] or sorted(map(tuple, got)) == [("L0", 0, 10), ("L0", 0, 11), ("L1", 1, 12), ("L1", 2, 13)]


@pytest.mark.parametrize("seed", [5, 6])
def test_benchmark_table_against_loops(spark, seed):
    rng = np.random.default_rng(seed)
    scaled = lambda rows: [(p, i, s, tuple(2.5 * c for c in b), i % 2) for p, i, s, b in rows]
    truths = scaled((p, i + 1000, s, b) for p, i, s, b in random_boxes(rng, 40))
    guesses = scaled((p, i, s, tuple(c + float(rng.integers(-3, 4)) for c in b)) for p, i, s, b in [*random_boxes(rng, 30), *((p, i - 900, float(rng.integers(0, 8)) / 8, tuple(c / 2.5 for c in b)) for p, i, _, b, _ in truths)])
    shape = BOX + ", label long"
    table = boxes.benchmark_table(spark.createDataFrame(guesses, shape), spark.createDataFrame(truths, shape), most=8).collect()
    got = {(r["label"], r["size"], r["overlap"]): (r["truths"], r["ap"], r["ar"]) for r in table}
    seen = 0
    for label in (0, 1):
        for size, low, high in boxes.SIZES:
            wanted = [t for t in truths if t[4] == label and low <= area(t[3]) <= high]
            for least in boxes.OVERLAPS:
                judged = []
                for page in range(4):
                    taken = set()
                    for _, i, s, b, _ in sorted((g for g in guesses if g[0] == page and g[4] == label), key=lambda g: (-g[2], g[1]))[:8]:
                        near = [(overlap(b, t[3]) / (area(b) + area(t[3]) - overlap(b, t[3])), t) for t in truths if t[0] == page and t[4] == label and t[1] not in taken]
                        near = [(-v, t[1], low <= area(t[3]) <= high) for v, t in near if v >= least - 1e-10]
                        inside, other = sorted(n for n in near if n[2]), sorted(n for n in near if not n[2])
                        pick = (inside or other or [None])[0]
                        if pick:
                            taken.add(pick[1])
                        if inside or (not other and low <= area(b) <= high):
                            judged.append((-s, page, i, bool(inside)))
                if not wanted:
                    assert (label, size, least) not in got
                    continue
                hits, curve = 0, []
                for k, (*_, hit) in enumerate(sorted(judged)):
                    hits += hit
                    curve.append((hits / len(wanted), hits / (k + 1)))
                ap = sum(max((p for r, p in curve if r + 1e-11 >= k / 100), default=0.0) for k in range(101)) / 101
                n, mine, recall = got[label, size, least]
                assert n == len(wanted) and abs(mine - ap) < 1e-9 and abs(recall - max((r for r, _ in curve), default=0.0)) < 1e-9
                seen += 0 < ap < 1
    assert seen > 20


def test_hierarchical_clusters_find_blobs(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(4)[:3] * 5
    rows = [(i, 0, (centres[i % 3] + rng.normal(scale=0.1, size=4)).tolist()) for i in range(24)]
    got = clusters.hierarchical_clusters(spark.createDataFrame(rows, "sig_id long, pdf long, v array<double>"), ["pdf"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["label"], set()).add(r["sig_id"] % 3)
    assert sorted(map(len, by.values())) == [1, 1, 1]


def test_fused_features(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [1.0]), (2, [3.0, 4.0], None), (3, [0.0, 0.0], [0.0, 0.0, 9.0])], "i int, a array<double>, b array<double>")
    got = {r["i"]: r["f"] for r in df.select("i", vectors.fused(F.col("a"), F.col("b")).alias("f")).collect()}
    blend = np.array([0.6 * 0.6 + 0.4, 0.6 * 0.8])
    assert np.allclose(got[1], blend / np.linalg.norm(blend)) and np.allclose(got[2], [0.6, 0.8]) and got[3] == [0.0, 0.0]


def test_bands_and_verdicts(spark):
    rows = [("ref-ref (same writer)", "a", 0.9), ("ref-ref (same writer)", "a", 0.8), ("ref-control (diff writer)", "a", 0.5), ("ref-ref (same writer)", "b", 0.4), ("ref-control (diff writer)", "b", 0.6), ("ref-ref (same writer)", "c", 0.4)]
    scores = spark.createDataFrame(rows, "kind string, scorer string, s double")
    bands = calibration.bands(scores)
    asked = spark.createDataFrame([("a", 0.8), ("a", 0.5), ("a", 0.7), ("b", 0.7), ("c", 0.7)], "scorer string, s double")
    got = {(r["scorer"], r["s"]): r["verdict"] for r in calibration.verdicts(asked, bands).collect()}
    assert got == {
        ("a", 0.8): "in same-writer band", ("a", 0.5): "in diff-writer band", ("a", 0.7): "between bands",
        ("b", 0.7): "NOT DIAGNOSTIC (bands overlap)", ("c", 0.7): "NO VERDICT (uncalibrated)",
    }


def test_golden_operating_points(spark):
    """Published counts satisfy the ratios that the evaluation reports."""
    for tp, fp, fn, recall, precision, ratio in ((885, 230, 40, 0.957, 0.794, 1.21), (881, 183, 44, 0.952, 0.828, 1.15), (880, 139, 45, 0.951, 0.864, 1.10), (869, 74, 56, 0.939, 0.922, 1.02)):
        assert abs(tp / (tp + fn) - recall) < 6e-4 and abs(tp / (tp + fp) - precision) < 6e-4 and abs((tp + fp) / (tp + fn) - ratio) < 6e-3


def test_baseline_without_references_adds_no_columns(spark):
    p = spark.createDataFrame([("a", "ref-questioned", 0.9)], "pair string, type string, cosine double")
    assert calibration.against_baseline(p, ["cosine"]).columns == ["pair", "type", "cosine"]
    q = spark.createDataFrame([("a", "ref-ref", 0.5), ("b", "x", 0.25)], "pair string, type string, cosine double")
    assert [r["cosine_vs_baseline"] for r in calibration.against_baseline(q, ["cosine"]).orderBy("pair").collect()] == [1.0, 0.5]


def test_composition_and_full_page(spark):
    rows = [(1, 1, 49, 0), (1, 1, 50, 0), (0, 0, 0, 3), (0, 2, 0, 0), (0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "f int, i int, c int, d int")
    got = [r[0] for r in df.select(geometry.composition(F.col("f"), F.col("i"), F.col("c"), F.col("d"))).collect()]
    assert got == ["scanned", "scanned_with_text_layer", "native", "image_only", "empty"]
    full = spark.createDataFrame([(0.8, 0.1, 0.1), (0.3, 0.95, 0.1), (0.29, 0.95, 0.1)], "r double, w double, h double")
    assert [r[0] for r in full.select(geometry.is_full_page(F.col("r"), F.col("w"), F.col("h"))).collect()] == [True, True, False]


def test_sniffing_order(spark):
    rows = [("a", bytearray(b"PK\x03\x04 %PDF-")), ("b", bytearray(b"x" * 900 + b"%PDF-")), ("c", bytearray(b"\xff\xd8\xff\xe0")), ("d.docx", bytearray(b"PK\x03\x04")), ("e.PDF", bytearray(b"")), ("f", bytearray(b"RIFF1234WEBP"))]
    df = spark.createDataFrame(rows, "p string, c binary").select("p", strings.classified(F.col("p"), F.col("c")).alias("k")).collect()
    assert {r["p"]: (r["k"]["kind"], r["k"]["how"]) for r in df} == {"a": (None, None), "b": ("pdf", "content"), "c": ("image", "content"), "d.docx": (None, None), "e.PDF": ("pdf", "extension"), "f": ("image", "content")}


def test_pair_types(spark):
    df = spark.createDataFrame([("reference", "reference"), ("control", "reference"), ("questioned", "reference"), ("questioned", "questioned"), ("control", "questioned"), ("control", "control")], "a string, b string")
    got = [r[0] for r in df.select(verdicts.pair_type(F.col("a"), F.col("b"))).collect()]
    assert got == ["ref-ref (same writer)", "ref-control (diff writer)", "ref-questioned (THE QUESTION)", "q-q", "q-control (diff writer)", "control-control (diff writer)"]


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return bytearray(out.getvalue())


def test_archives_unpack_to_depth(spark):
    inner = zipped({"deep.txt": b"x"})
    df = spark.createDataFrame([("a.zip", zipped({"t.txt": b"hello", "../bad": b"no", "in.zip": bytes(inner)})), ("b.zip", bytearray(b"junk"))], "rel_path string, content binary")
    got = {(r["archive"], r["member"]): (r["depth"], r["status"]) for r in archives.unpack_all(df).collect()}
    assert got == {("a.zip", "t.txt"): (0, "ok"), ("a.zip", "../bad"): (0, "unsafe"), ("a.zip", "in.zip"): (0, "ok"), ("b.zip", ""): (0, "bad"), ("a.zip!in.zip", "deep.txt"): (1, "ok")}
    manifest = {r["archive"]: r["status"] for r in archives.extraction_manifest(archives.unpack_all(df)).collect()}
    assert manifest == {"a.zip": "partial", "b.zip": "bad", "a.zip!in.zip": "ok"}


def test_single_compressed_files(spark):
    made = [("a.gz", gzip.compress(b"one")), ("b.bz2", bz2.compress(b"two")), ("c.xz", lzma.compress(b"three")), ("d.gz", gzip.compress(b"one" * 20)[:-9]), ("e.gz", gzip.compress(b"x" * 999))]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in made], "rel_path string, content binary")
    got = {r["archive"]: (r["member"], r["status"], r["content"]) for r in archives.unpack_all(df, most_bytes=100).collect()}
    assert [bytes(got[n][2]) for n in ("a.gz", "b.bz2", "c.xz")] == [b"one", b"two", b"three"]
    assert got["d.gz"][1] == "bad" and got["e.gz"][1] == "too_large"


def test_inputs_of_a_target(spark, tmp_path):
    root = tmp_path / "a+b (1)"  # no pattern, though it looks like one
    root.mkdir()
    (root / "x.pdf").write_bytes(b"%PDF-1.4")
    (root / "y.png").write_bytes(b"..")
    (root / "z.txt").write_bytes(b"..")
    got = sorted((r["rel_path"], r["kind"]) for r in files.resolved(spark, str(root)).collect())
    assert got == [("x.pdf", "pdf"), ("y.png", "image")]
    assert [tuple(r) for r in files.resolved(spark, str(root / "x.pdf")).collect()] == [("x.pdf", "pdf", 8)]
    with pytest.raises(Exception, match="neither a document"):
        files.resolved(spark, str(root / "z.txt")).collect()


def test_files_and_sinks_round_trip(spark, tmp_path):
    root = tmp_path / "corpus" / "g"
    root.mkdir(parents=True)
    (root / "x.pdf").write_bytes(b"%PDF-1.4")
    (root / "y").write_bytes(b"BM..")
    (root / ".hidden").write_bytes(b"BM")
    got = files.discover(spark, str(tmp_path / "corpus")).collect()
    assert [(r["rel_path"], r["grp"], r["kind"], r["how"], r["size_bytes"]) for r in got] == [("g/x.pdf", "g", "pdf", "extension", 8), ("g/y", "g", "image", "content", 4)]
    assert files.walk(spark, str(tmp_path / "corpus")).count() == 2
    df = spark.createDataFrame([(1, [1, 2], "a, b", 5)], "i int, xs array<int>, t string, _private int")
    sinks.write_csv(df, str(tmp_path / "csv"), lead=["t"])
    back = files.typed_csv(spark, str(tmp_path / "csv"), "t string, i int, xs string, gone double")
    assert [tuple(r) for r in back.collect()] == [("a, b", 1, "[1,2]", None)]


def test_rasters():
    grey = np.full((20, 20), 255.0)
    grey[4:16, 5:7] = 0
    grey[4:6, 12:18] = 0
    mask = grey < 128
    assert rasters.labelled(mask).max() == 2
    assert rasters.longest_runs(mask).max() == 12
    assert rasters.otsu(grey) == 0
    assert abs(rasters.masked_ssim(grey / 255, grey / 255) - 1) < 1e-9
    assert rasters.masked_ssim(grey, grey, np.zeros((20, 20), bool)) == 0.0
    assert rasters.staffs(mask) and rasters.white_fraction(grey) == 1 - mask.mean()
    assert rasters.window_extreme(mask, 1).sum() > mask.sum() > rasters.window_extreme(mask, 1, False).sum()
    assert rasters.binary_canvas(grey).shape == (128, 256) and set(np.unique(rasters.binary_canvas(grey))) == {0.0, 255.0}
    assert not rasters.erased(mask, grey, [("box", 0, 0, 1, 1)]).any() and (rasters.erased(mask, grey, [("grey", 0, 0, 1, 1)]) == mask).all()
    diagonal = np.eye(3, dtype=bool)
    assert rasters.labelled(diagonal).max() == 1
    assert (rasters.perturbed(grey, 3) == rasters.perturbed(grey, 3)).all()


def test_blocked_statistics(spark):
    rows, df = marks(spark, 40)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                c = unit(a[2]) @ unit(b[2])
                n, total, top = want.get((a[1], b[1]), (0, 0.0, -2.0))
                want[a[1], b[1]] = (n + 1, total + c, max(top, c))
    for block in (9, 1000):
        got = {(r["a"], r["b"]): (r["n"], r["total"], r["top"]) for r in pairs.blocked_statistics(df, "pdf", block_rows=block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def grown(mask, reach):
    return np.array([[mask[y, max(0, x - reach) : x + reach + 1].any() for x in range(mask.shape[1])] for y in range(mask.shape[0])])


def run_through(mask, y, x, axis):
    """Length of the run of ink through a pixel along an axis, counted step by step."""
    n = 0
    for step in (1, -1):
        at = [y, x]
        while 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at[0], at[1]]:
            n, at[axis] = n + 1, at[axis] + step
    return n - 1 if n else 0


@pytest.mark.parametrize("seed", range(6))
def test_stroke_kernels_against_loops(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((60, 90)) < 0.25
    mask[10:13, 5:80] = True  # a rule that a leaning stroke crosses
    mask[30:38, 2:60] = True  # too thick for a rule
    for y in range(60):
        mask[y, 40 + y // 8] = True
    h, w = mask.shape
    level = np.array([[run_through(mask, y, x, 1) >= 31 for x in range(w)] for y in range(h)])
    rows = [y for y in range(h) if level[y].any()]
    bands = [[y for y in rows if all(k in rows for k in range(min(y, z), max(y, z) + 1))] for z in rows]
    for band in bands:
        if len(band) > 4:
            level[band] = False
    assert (rasters.without_rules(mask) == (mask & ~level)).all() and level.any()
    wide = grown(mask, 3)
    tall = grown(np.array([[run_through(wide, y, x, 0) >= 12 for x in range(w)] for y in range(h)]), 3) & mask
    assert (rasters.tall_strokes(mask) == tall).all() and mask[20, 42] and tall[20, 42]
    kept = rasters.erased(mask, np.where(mask, 0, 255), [("vkeep", 0.0, 0.5, 1.0, 1.0)])
    assert (kept[:30] == mask[:30]).all() and (kept[30:] == tall[30:]).all()
    small, parts, n = mask[:25, :30] & (rng.random((25, 30)) < 0.5), np.zeros((25, 30), int), 0
    for y, x in zip(*np.nonzero(small)):
        if not parts[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 25 and 0 <= b < 30 and small[a, b] and not parts[a, b]:
                    parts[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert (rasters.labelled(small) == parts).all()


def test_staff_centres_and_cleaning():
    mask = np.zeros((100, 200), bool)
    mask[5:95, 20:24] = mask[5:95, 50:56] = mask[0:10, 150:152] = True
    found = rasters.staffs(mask)
    assert len(found) == 2 and rasters.staff_gaps(found, 100) == ([0.31], 1)
    mask[70:73, 10:190] = True  # a rule across both
    mask[90:92, 120:122] = True  # a speck
    left = rasters.cleaned(mask)
    assert left[5:70, 20:24].all() and left[73:95, 50:56].all() and not left[70:73, 60:].any() and not left[90:92, 120:122].any()
    assert not left[:, 150:152].any()  # far smaller than the largest part
