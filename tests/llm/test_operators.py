"""The ten operators against brute force on small fixtures, and their defined cases."""

import collections
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from inkwell.llm import backoff_lm, common, license_scan, minhash, mixing, piece_transducer, quality_classifier, quality_rules, token_counts, url_filter, vector_graph

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, host int, score string"


def docs_of(spark, texts, sources=None):
    """Rows with further columns whose names clash with what the operators return."""
    rows = [(i, t, "en", (sources or {}).get(i, "s"), None, "x", 7, 1, "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "word " * 30000), (5, "same text here now"), (6, "same text here now"), (6, "same text here now"), (None, "lost id text"), (7, "é漢\U0001f642 \x00 end")]


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


OPERATORS = {
    "minhash": lambda d: minhash.minhash_dedup(d, width=2),
    "license": license_scan.license_scan,
    "tokens": token_counts.token_counts,
    "lm": backoff_lm.backoff_scores,
    "mix": mixing.mix,
    "pieces": piece_transducer.round_trips,
    "rules": quality_rules.quality_rules,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_keep_their_number(spark, name):
    found = OPERATORS[name](docs_of(spark, ODD)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in ODD)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](docs_of(spark, [])).collect() == []


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def similarity_texts(seed=1):
    rng = random.Random(seed)
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts += [" ".join(edited(rng, base, rng.randrange(0, 14))) for _ in range(25)]
        texts += [" ".join(base).upper()] * 3
    return list(enumerate(texts))


def brute_components(texts, width):
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}, sets


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_against_all_pairs(spark, width):
    texts = similarity_texts()
    want, sets = brute_components(texts, width)
    got = collected(minhash.minhash_dedup(docs_of(spark, texts), width=width))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    stay = [r["doc_id"] for r in minhash.deduplicated(docs_of(spark, texts), width=width).collect()]
    assert sorted(stay) == sorted(set(want.values()))


def test_minhash_in_buckets_of_weakly_similar_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.choice(60, 20, replace=False).tolist() for _ in range(800)]
    for k in range(100):
        # 19 words in common and one of each text's own: 19 of 21
        texts.append([*texts[k][:19], next(w for w in rng.permutation(60).tolist() if w not in texts[k])])
    docs = docs_of(spark, [(i, " ".join(f"p{w}" for w in t)) for i, t in enumerate(texts)])
    # few bands, so that a pair meets in one or two buckets
    whole = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda *a: whole(*a).withColumn("bands", F.slice("bands", 1, 3)))
    bands = {r["doc_id"]: set(r["bands"]) for r in minhash.sketches(docs, 1).collect()}
    met = [(k, 800 + k) for k in range(100) if bands[k] & bands[800 + k]]
    got = collected(minhash.minhash_dedup(docs, width=1))
    assert len(met) > 50 and all(got[a]["component_id"] == got[b]["component_id"] for a, b in met)
    assert all(got[i]["component_id"] in (i, i - 800) for i in range(900))
    # the same with new hubs and several blocks
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    again = collected(minhash.minhash_dedup(docs, width=1))
    assert {i: r["component_id"] for i, r in again.items()} == {i: r["component_id"] for i, r in got.items()}


def test_minhash_defined_cases(spark):
    got = collected(minhash.minhash_dedup(docs_of(spark, ODD), width=2))
    assert [got[i]["n_shingles"] for i in (0, 1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1, 3]
    assert got[0]["component_id"] == 0 and got[0]["kept"] and got[6]["component_id"] == 5 and not got[6]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 201)] + [(5, 5)]
    got = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(60)}, 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_license_places(spark):
    texts = [
        (0, "Released under the MIT License. MIT license!"), (1, "x Apache   License, Version 2.0"), (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "cc by"), (4, "CC BY-NC 4.0"), (5, "the mit licenses apache-licensed"), (6, "License MIT license"), (7, "mİt license kK"), (8, None),
    ]
    got = collected(license_scan.license_scan(docs_of(spark, texts)))
    assert [got[i]["n_base"] for i in range(9)] == [2, 1, 1, 1, 1, 0, 1, 0, 0]
    assert (got[0]["first_word"], got[0]["last_word"], got[0]["n_words"]) == (3, 5, 7)
    assert [got[i]["base_labels"] for i in range(5)] == ["mit", "apache", "gpl", "cc-by", "cc-by"]
    assert "gpl-3.0" in got[2]["labels"] and "mit" in got[0]["labels"] and got[0]["score"] == 1.0
    assert got[6]["first_word"] == 1 and got[8]["n_words"] == 0 and got[8]["score"] == 0.0


def test_license_texts_and_near_misses(spark):
    whole = {label: text for label, text, _ in license_scan.TEXTS}
    mit = whole["mit-full"].split()
    texts = [
        (0, whole["mit-full"]), (1, "Foo. " + whole["bsd-full"].upper() + " end"), (2, " ".join([*mit[:20], "extra", *mit[20:]])),  # shifted: words before the gap no longer stand
        (3, " ".join(mit[:40])), (4, " ".join(w if i % 9 else "x" for i, w in enumerate(whole["zlib"].split()))), (5, whole["gpl-header"].replace("version 3", "version 2")),
    ]
    got = collected(license_scan.license_scan(docs_of(spark, texts)))
    labels = {i: r["labels"].split(",") for i, r in got.items()}
    assert "mit-full" in labels[0] and "mit-text" in labels[0] and got[0]["score"] == 1.0
    assert "bsd-full" in labels[1] and "bsd" in labels[1]
    assert "mit-full" in labels[2] and 0.75 < got[2]["score"] <= 1.0
    assert "mit-full" not in labels[3] and "zlib" not in labels[4]
    assert "gpl-header" in labels[5] and "gpl" in labels[5]


@pytest.mark.parametrize("phrase", ["cc by", "mit license", "released under the mit license apache license version 2 0"])
def test_license_words_without_end(spark, phrase):
    """100,000 license words in one text: work in proportion to them."""
    times = 100_000 // len(phrase.split())
    began = time.time()
    got = license_scan.license_scan(docs_of(spark, [(0, " ".join([phrase] * times))])).first()
    assert time.time() - began < 40
    assert got["n_words"] == times * len(phrase.split())
    assert got["n_base"] == times * (2 if "apache" in phrase else 1)


def test_tokens_equal_the_library_and_are_cached(spark, tmp_path):
    path = public_tokenizers.path(token_counts.MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = str(tmp_path / "cache")
    for texts in (ODD, [*ODD, (9, "a new text"), (10, "word " * 30000)]):
        got = token_counts.token_counts(docs_of(spark, texts), cache=cache).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_bytes"]) for r in got) == sorted((str(i), len(lib.encode(t or "")), len((t or "").encode())) for i, t in texts)
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in ODD}) + 1


def test_transducer_equals_the_library():
    path = public_tokenizers.path(piece_transducer.MODEL)
    mine, lib = piece_transducer.PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = ["", " ", "  a  b\n\tc </s> <0x41> €漢\U0001f642", "a" * 70, " " * 40 + "x  ", "▁▁ a", "\x00a\r\n"]
    texts += ["".join(rng.choice("etaoin shrdlu  aeé\n▁*#THEß漢<>0x41s/") for _ in range(rng.randrange(40))) for _ in range(400)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == lib.encode(t) and mine.decode(ids) == lib.decode(ids)


def test_transducer_round_trip(spark):
    texts = [(i, t) for i, t in ODD if i is not None and i != 6]
    back = collected(piece_transducer.decode(piece_transducer.encode(docs_of(spark, texts))))
    assert {i: r["text"] for i, r in back.items()} == {i: t or "" for i, t in texts}
    path = public_tokenizers.path(piece_transducer.MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    found = collected(piece_transducer.round_trips(docs_of(spark, texts)))
    fallback = set(piece_transducer.PieceTransducer(path).bytes.values())
    for i, t in texts:
        ids = lib.encode(t or "")
        r = found[i]
        assert (r["ids"], r["n_pieces"], r["n_bytes_pieces"], r["round_trip"]) == (ids, len(ids), len([x for x in ids if x in fallback]), lib.decode(ids) == (t or ""))


def test_neighbours_fit_where_merging_keeps_them():
    machine = piece_transducer.PieceTransducer(public_tokenizers.path(piece_transducer.MODEL))
    rng = random.Random(6)
    made = [p for p in machine.scores if len(p) == 1 or p in machine.halves]
    runs = [c * n for c in ("a", "-", "=", " ".replace(" ", piece_transducer.MARK)) for n in range(1, 17) if c * n in machine.halves or n == 1]
    pairs = [(rng.choice(made), rng.choice(made)) for _ in range(20_000)] + [(a, b) for a in runs for b in runs]
    assert machine.ordered and all(machine.follows(a, b) == (machine.merged(a + b)[0] == [a, b]) for a, b in pairs)


@pytest.mark.parametrize("fallback", [True, False])
def test_pieces_of_a_unigram_model(tmp_path, fallback):
    """The same pieces and scores read as a unigram model: the library's best path."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(public_tokenizers.path(piece_transducer.MODEL), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = piece_transducer.UNIGRAM
    rng = random.Random(7)
    for p in model.pieces:
        p.score = -rng.randrange(1, 4096) / 4 if p.type == piece_transducer.NORMAL else p.score
    if not fallback:
        model.trainer_spec.byte_fallback = False
        kept = [p for p in model.pieces if p.type != piece_transducer.BYTE]
        del model.pieces[:]
        model.pieces.extend(kept)
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    mine, lib = piece_transducer.PieceTransducer(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    for _ in range(300):
        text = "".join(rng.choice("abcdeth  \n.!\u00e9\u6f22\U0001f642\ue000\ue001") for _ in range(rng.randrange(40)))
        assert mine.encode(text) == lib.encode(text), text


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_classifier.classify(docs, labels).join(labels.withColumnRenamed("toxic", "_t"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_defined_cases(spark):
    labels = spark.createDataFrame([(3, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs_of(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert quality_classifier.classify(docs_of(spark, []), labels).collect() == []


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 50, 6), k % 2)) for k in range(80)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(80)])
    w, bias = quality_classifier.dual_coordinate_descent(rows, np.ones(50), y, np.ones(80), 50, 1)
    assert all((w[r].sum() + bias) * v > 0 for r, v in zip(rows, y, strict=True))


def test_dual_descent_against_projected_gradient():
    """The same dual problem solved plainly: gradient steps on all multipliers at once, cut to their bounds."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 4)) for _ in range(40)]
    ratio, y, cost = rng.normal(size=12), np.where(rng.random(40) < 0.5, 1.0, -1.0), np.full(40, 0.5)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = ratio[r], 1.0  # the bias is one more feature
    z = y[:, None] * x
    alpha, rate = np.zeros(40), 1 / np.linalg.eigvalsh(z @ z.T).max()
    for _ in range(50_000):
        alpha = np.clip(alpha + rate * (1 - z @ (z.T @ alpha)), 0, cost)
    want = z.T @ alpha
    w, bias = quality_classifier.dual_coordinate_descent(rows, ratio, y, cost, 3000, 1)
    assert np.abs(np.append(w, bias) - want).max() < 1e-2


def test_classifier_training_rows(spark):
    """Contradicting labels train nothing, long texts and other scripts train like any other."""
    texts = [(i, ("\u043b\u043e\u0448\u0430\u0434\u044c " if i % 2 else "\u6f22\u5b57 ") * (4000 if i < 4 else 30)) for i in range(40)]
    labels = [(i, i % 2, 0) for i in range(40)] + [(7, 0, 0), (8, 0, 1)]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r["label"] for r in quality_classifier.training_rows(docs_of(spark, texts), df).collect()}
    assert 7 not in rows and all(rows[i] == i % 2 for i in rows)
    assert {i for i in range(40)} - set(rows) - {7} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1} - {7}
    got = collected(quality_classifier.classify(docs_of(spark, texts), df))
    assert all(r["predicted"] == i % 2 for i, r in got.items())


def test_classifier_scores_plainly(spark):
    """Ratios, fit, folds and curve built plainly from sets of features."""
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("abcdef " if i % 2 else "uvwxyz ef ") for _ in range(rng.randrange(3, 30)))) for i in range(30)]
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in texts], "doc_id long, text string, label long")
    model = quality_classifier.fit(rows, epochs=4000)
    scratch = np.zeros(quality_classifier.N_FEATURES, bool)
    sets = {i: set(quality_classifier.features(t.encode(), scratch).tolist()) for i, t in texts}
    ratio = {f: math.log((sum(f in sets[i] for i in range(1, 30, 2)) + 1) / 17) - math.log((sum(f in sets[i] for i in range(0, 30, 2)) + 1) / 17) for f in set().union(*sets.values())}
    digest = {r["i"]: r["h"] for r in spark.range(30).select(F.col("id").alias("i"), F.xxhash64("id", F.lit(8)).alias("h")).collect()}
    order = [i for label in (0, 1) for i in sorted(range(label, 30, 2), key=digest.get)]
    known = sorted(ratio)
    x = np.array([[ratio[f] * (f in sets[i]) for f in known] + [1.0] for i in order])
    y = np.array([1.0 if i % 2 else -1.0 for i in order])

    def solved(own):
        z = y[own, None] * x[own]
        alpha, rate = np.zeros(len(own)), 1 / np.linalg.eigvalsh(z @ z.T).max()
        for _ in range(20_000):
            alpha = np.clip(alpha + rate * (1 - z @ (z.T @ alpha)), 0, 1.0)
        return z.T @ alpha

    margins = np.empty(30)
    for k in range(3):
        margins[k::3] = x[k::3] @ solved(np.array([i for i in range(30) if i % 3 != k]))
    scale = np.abs(margins).mean()
    p = 1 / (1 + np.exp(-(model.slope * margins + model.offset)))
    assert abs(((p - (y + 1) / 2) * margins / scale).sum() + 0.01 * model.slope * scale) < 0.05 and abs((p - (y + 1) / 2).sum() + 0.01 * model.offset) < 0.05
    want = 1 / (1 + np.exp(-(model.slope * (x @ solved(np.arange(30))) + model.offset)))
    assert np.abs(model.scores([dict(texts)[i].encode() for i in order]) - want).max() < 0.01


def test_classifier_odd_rows_with_a_model(spark):
    """Null and empty texts score what the bias alone says; very long ones and repeated rows like any other."""
    texts = [(i, ("good words here " if i % 2 else "zzz qqq ") * 40) for i in range(100, 160)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    odd = [*ODD, (50, "zzz qqq " * 100_000), (51, "good words here " * 50_000), (52, texts[1][1]), (52, texts[1][1])]
    got = quality_classifier.classify(docs_of(spark, texts + odd), labels).collect()
    assert len(got) == len(texts) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert by_id[0] == by_id[1] != [0.5] and by_id[52][0] == by_id[52][1] >= 0.5 and by_id[50][0] < 0.5 <= by_id[51][0]


def test_class_counts_against_sets(spark):
    texts = [(i, t) for i, t in enumerate(["aB1", "ab\n", "", "zz zz \u00e9", "aB1", "x"])]
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in texts], "doc_id long, text string, label long")
    n, counts = quality_classifier.class_counts(rows)
    assert n.tolist() == [3, 3]
    a, size = quality_classifier.SYMBOLS.astype(int), quality_classifier.ALPHABET
    want = np.zeros((2, quality_classifier.N_GRAMS), int)
    for i, t in texts:
        s = a[list(t.encode())]
        found = {x for x in s} | {size + x * size + y for x, y in zip(s, s[1:])}
        c, few = quality_classifier.COARSE_SYMBOLS.astype(int)[list(t.encode())], quality_classifier.COARSE
        found |= {size + size**2 + (x * few + y) * few + z for x, y, z in zip(c, c[1:], c[2:])}
        for f in found:
            want[i % 2, f] += 1
    assert (counts[:, : quality_classifier.N_GRAMS] == want).all()


def test_url_intervals_and_precedence(spark):
    day = "2024-01-%02d"
    events = [("a.org", "block", day % 2, "add"), ("a.org", "block", day % 10, "remove"), ("x.a.org", "allow", day % 5, "add"), ("b.org/in", "block", day % 1, "add"), ("b.org/in", "block", day % 1, "add"), (None, "block", day % 1, "add"), ("c.org", "block", None, "add")]
    ev = spark.createDataFrame(events, "key string, verdict string, day string, action string").withColumn("day", F.col("day").cast("date"))
    asked = [
        (1, "http://a.org/p", 2, "block"), (2, "http://a.org/p", 10, "none"), (3, "https://x.a.org", 4, "block"), (4, "https://u@X.A.org:80/q", 5, "allow"), (5, "http://b.org/in/1", 3, "block"),
        (6, "http://b.org/out", 3, "none"), (7, None, 3, "none"), (8, "no url", 3, "none"), (9, "http://a.org/p", 2, "block"), (9, "http://a.org/p", 2, "block"), (10, "http://a.org", None, "none"), (11, "http://c.org", 9, "none"),
    ]
    caps = spark.createDataFrame([(i, u, d and day % d, "z") for i, u, d, _ in asked], "page_id long, url string, fetched string, verdict string").withColumn("fetched", F.col("fetched").cast("date"))
    got = url_filter.url_filter(caps, ev).collect()
    assert sorted((r["page_id"], r["verdict"], r["kept"]) for r in got) == sorted((i, v, v != "block") for i, _, _, v in asked)
    assert all(r["kept"] for r in url_filter.url_filter(caps, ev.limit(0)).collect())


def test_words_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abC \n\t") for _ in range(n)) + "z" * (n % 50) for n in (0, 1, 400, 30, 0, 900)]
    raw, ends = "\n".join(texts).encode(), np.cumsum([len(t) + 1 for t in texts]) - 1
    whole, counts = backoff_lm.words_of(raw, ends)
    assert counts.tolist() == [len(t.split()) for t in texts]
    words = [w.lower() for t in texts for w in t.split()]
    assert len({*zip(words, whole.tolist())}) == len(set(words)) == len(set(whole.tolist()))
    backoff_lm.hasher.cache_clear()
    monkeypatch.setattr(backoff_lm, "CHUNK_BYTES", 64)
    again, same = backoff_lm.words_of(raw, ends)
    backoff_lm.hasher.cache_clear()
    assert again.tolist() == whole.tolist() and same.tolist() == counts.tolist()


def test_packed_numbers():
    rng = np.random.default_rng(9)
    for n in (1, 50):
        v = np.unique(rng.integers(2**62, 2**63, n, dtype=np.uint64))
        assert (backoff_lm.summed_up(backoff_lm.differences(v, np.uint64(2**62)), n, np.uint64(2**62)) == v).all()
        k = rng.integers(1, 600, n)
        assert (backoff_lm.numbers(*backoff_lm.small_numbers(k)) == k).all()


@pytest.mark.parametrize(("slices", "pack", "parts"), [(1, 4 << 20, 64), (3, 200, 2), (2, 900, 5)])
def test_backoff_against_counters(spark, slices, pack, parts, monkeypatch):
    monkeypatch.setattr(backoff_lm, "PACK_BYTES", pack)
    monkeypatch.setattr(backoff_lm, "PARTS", parts)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    texts = [(i, "  ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randrange(0, 60))).replace("w1", "W1")) for i in range(80)]
    texts[3] = (3, None)
    texts += [(80, texts[5][1]), (81, texts[5][1]), (None, "w0 w1 w2 w3"), (82, "w0"), (83, "w1 w0")]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t in texts:
        w = (t or "").lower().split()
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    n = sum(one.values())
    got = collected(backoff_lm.backoff_scores(docs_of(spark, texts), slices=slices))
    for i, t in texts:
        w, want = (t or "").lower().split(), 0.0
        for k in range(len(w)):
            step = 0.0
            if k > 1 and three[tuple(w[k - 2 : k + 1])] >= 2:
                want += math.log(three[tuple(w[k - 2 : k + 1])] / two[w[k - 2], w[k - 1]])
                continue
            step += math.log(0.4) if k > 1 else 0.0
            if k > 0 and two[w[k - 1], w[k]] >= 2:
                want += step + math.log(two[w[k - 1], w[k]] / one[w[k - 1]])
                continue
            step += math.log(0.4) if k > 0 else 0.0
            want += step + math.log(one[w[k]] / n)
        assert got[i]["n_tokens"] == len(w) and abs(got[i]["log_score"] - want) < 1e-8
    assert got[3]["mean_log_score"] is None


def test_raking_meets_all_targets(spark):
    rng = random.Random(1)
    texts = [(i, rng.choice(["plain words here", "a | b | c", "LOUD!! NOISE!!", "MIT license"]) + " x" * rng.randrange(50)) for i in range(300)]
    docs = docs_of(spark, texts, {i: f"s{min(i % 7, 3)}" for i in range(300)})
    rows = mixing.mix(docs, sweeps=300).collect()
    total = sum(r["n_tokens"] for r in rows)
    for m in ("source", "topic"):
        seen, fitted = collections.Counter(), collections.Counter()
        for r in rows:
            seen[r[m]] += r["n_tokens"]
            fitted[r[m]] += r["n_tokens"] * r["weight"]
        want = mixing.tempered({k: v / total for k, v in seen.items()}, mixing.POWERS[m])
        assert all(abs(fitted[k] / total - want[k]) < 1e-5 for k in want)
    assert max(r["probability"] for r in rows) == 1.0
    joined = {r["doc_id"]: r["weight"] for r in mixing.mix(docs, sweeps=300, max_local_cells=2).collect()}
    assert all(abs(joined[r["doc_id"]] - r["weight"]) < 1e-6 for r in rows)
    kept = {r["doc_id"] for r in rows if r["sampled"]}
    assert {r["doc_id"] for r in mixing.sampled(docs, sweeps=300).collect()} == kept


def test_given_targets(spark):
    docs = docs_of(spark, [(i, "some plain words") for i in range(40)], {i: "a" if i < 30 else "b" for i in range(40)})
    rows = mixing.mix(docs, targets={"source": {"a": 1.0, "b": 3.0, "gone": 5.0}}).collect()
    assert all(abs(r["weight"] - (1 / 3 if r["source"] == "a" else 3.0)) < 1e-9 for r in rows)


def test_a_rare_cell_does_not_thin_the_others(spark):
    docs = docs_of(spark, [(i, "some plain words") for i in range(401)], {i: "a" if i < 400 else "rare" for i in range(401)})
    rows = collected(mixing.mix(docs))
    weight = rows[400]["weight"]
    assert weight > 10 and all(r["probability"] == min(r["weight"], 1.0) for r in rows.values())
    assert all(r["copies"] in (math.floor(r["weight"]), math.floor(r["weight"]) + 1) and r["sampled"] == (r["copies"] > 0) for r in rows.values())
    assert abs(sum(r["copies"] for r in rows.values()) - 401) < 40
    drawn = collections.Counter(r["doc_id"] for r in mixing.sampled(docs).collect())
    assert drawn == {i: r["copies"] for i, r in rows.items() if r["copies"]}
    half = mixing.mix(docs, rate=0.5).collect()
    assert abs(sum(r["copies"] for r in half) - 200) < 40


def vectors_of(seed=2):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 14)):
                rows.append((i, (base + rng.normal(scale=0.09, size=16)).tolist(), label))
                i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(5)]
    return rows


@pytest.mark.parametrize("shard", [vector_graph.SHARD, 20])
def test_vectors_against_all_pairs(spark, shard, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", shard)
    if shard == 20:  # several cells, blocks and tasks of queries
        monkeypatch.setattr(vector_graph, "BLOCK", 15)
        monkeypatch.setattr(vector_graph, "QUERIES", 25)
    rows = vectors_of()
    root = {i: i for i, _, _ in rows}
    links = collections.Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, v, x in rows:
        for b, w, y in rows:
            if a < b and x == y and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collected(vector_graph.vector_dedup(df), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (links[i], top(i)) for i in root}
    if shard == 20:
        assert vector_graph.audit_recall(df, every=3) >= 0.9


@pytest.mark.parametrize(("copies", "others", "labels", "scale"), [(5000, 0, 1, 0.08), (2500, 3000, 2, 0.13)])
def test_near_copies_beyond_a_shard(spark, copies, others, labels, scale, monkeypatch):
    """Jittered copies of one vector, more than a shard holds, alone and among unrelated vectors."""
    for name, size in (("SHARD", 1000), ("BLOCK", 1500), ("QUERIES", 1500)):
        monkeypatch.setattr(vector_graph, name, size)
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    x = np.concatenate([base + rng.normal(size=(copies, 64)) * scale * np.linalg.norm(base) / 8, rng.normal(size=(others, 64))])
    label = rng.integers(0, labels, len(x))
    df = spark.createDataFrame([(i, v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    want = near.sum(1) - 1
    got = collected(vector_graph.vector_dedup(df), "vec_id")
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()
    asked = np.arange(0, len(x), 50)  # the stated queries against all rows
    assert links[asked].sum() >= 0.99 * want[asked].sum()
    assert vector_graph.audit_recall(df) >= 0.99


def test_vectors_of_extreme_lengths_link(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e-200, 0.0]), (2, [3e200, 0.0]), (3, [0.0, 5e-324]), (4, [0.0, 1e300]), (5, [1.0, 0.0]), (6, [1e308, 1e308]), (7, [1.0, 1.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_graph.vector_dedup(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 5: (3, 0), 3: (1, 3), 4: (1, 3), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_cells_in_reach_hold_every_link():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(300, 8))
    u = np.concatenate([u, u + rng.normal(scale=0.06, size=u.shape)])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    home, second, reach = vector_graph.reachable(u, vector_graph.centroids_of(u[::3], 40, 1), 0.98)
    a, b = np.nonzero(u @ u.T >= 0.98)
    assert reach[a, home[b]].all() and (home[a] != home[b]).any() and (home != second).all() and not reach.all()


def test_vector_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1, 5), (1, [0.0, 0.0], 1, 5), (2, [nan, 1.0], 1, 5), (3, [inf, 1.0], 1, 5), (4, [None, 1.0], 1, 5), (5, [], 1, 5), (6, [1.0, 1.0], None, 5), (7, [1.0, 1.0], None, 5), (8, [1.0, 1.0], 2, 5), (8, [1.0, 1.0], 2, 5), (9, [2.0, 2.0], 2, 5), (None, [1.0, 1.0], 2, 5), (10, [1.0, 1.0, 1.0], 2, 5)]
    got = vector_graph.vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert all(by[i] == (0, i, True) for i in (0, 1, 2, 3, 4, 5, 6, 7, 10))
    assert by[8] == (2, 8, True) and by[9] == (2, 8, False) and by[None][1:] == (None, True)
    assert vector_graph.vector_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for k in range(len(words) - 2):
        at[tuple(words[k : k + 3])].append(k)
    covered = {k + o for ks in at.values() if len(ks) > 1 for k in ks for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice(["a ", "b ", "éc ", "#* ", "d\n", "\n", "\t|e ", " x "]) for _ in range(rng.randrange(160)))) for i in range(80)]
    got = collected(quality_rules.quality_rules(docs_of(spark, texts)))
    for i, t in texts:
        want = brute_rules(t)
        assert tuple(got[i][m] for m in quality_rules.MEASURES) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_refused_hosts(spark):
    good, bad = " ".join(f"w{k}" for k in range(80)), "too short"
    texts = [(i, bad if i < 45 else good) for i in range(300)]
    docs = docs_of(spark, texts, {i: "bad.org" if i < 50 else f"h{i % 5}" for i in range(300)})
    got = collected(quality_rules.quality_rules(docs))
    assert not got[47]["kept"] and not got[47]["base_failed"] and got[60]["kept"] and 0.6 <= got[47]["host_rate"] < 0.9
    for most in (10_000, 0):
        assert sorted(r["doc_id"] for r in quality_rules.accepted(docs, max_broadcast_hosts=most).collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_masked_null_hosts(spark):
    got = quality_rules.quality_rules(docs_of(spark, [(1, "a b")], {1: None})).collect()
    assert got[0]["host"] == "" and not got[0]["kept"]
