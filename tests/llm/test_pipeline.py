"""The pipeline's stages against the operators' own results and against plain Python, stage by stage."""

import collections
import re

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import common, minhash, mixing, quality_classifier, quality_rules

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    seen, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "minhash_dedup", "mixing", "piece_transducer"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in seen.collect()}
        after = common.written(stage(spark, seen, DATA), name)
        ids = {r["doc_id"] for r in after.collect()}
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.quality_rules(seen).where("kept").collect()}
        elif name == "quality_classifier":
            want = {r["doc_id"] for r in quality_classifier.classify(seen, common.table(spark, DATA, "labels")).where("predicted = 1").collect()}
        elif name == "minhash_dedup":
            want = {r["doc_id"] for r in minhash.minhash_dedup(seen).where("kept").collect()}
        elif name == "mixing":
            want = {r["doc_id"] for r in mixing.mix(seen, corpus_pipeline.MIXTURE).where("sampled").collect()}
        else:
            want = set(before)
        assert ids == want and ids
        if name != "piece_transducer":
            assert sorted(after.columns) == sorted(docs.columns)
            assert all(r == before[r["doc_id"]] for r in after.select(seen.columns).collect())
        seen = after


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == ["doc_id", "ids"] and found.count() > 0


def test_odd_rows(spark):
    schema = common.table(spark, DATA, "documents").schema
    good = " ".join(f"w{k}" for k in range(70))
    docs = spark.createDataFrame([(None, good, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, good + " x", "en", "s", 1)], schema)
    for empty in (docs, docs.limit(0)):
        seen = empty
        for name, stage in corpus_pipeline.STAGES:
            seen = common.written(stage(spark, seen, DATA), name)
        assert seen.columns == ["doc_id", "ids"]


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words) < 50 or 100 * len(covered) > 50 * len(words)


def refused_hosts(rows):
    n, k = collections.Counter(r["source"] for r in rows), collections.Counter(r["source"] for r in rows if fails(r["text"] or ""))
    rates = [k[h] / n[h] for h in n]
    mean, m1, m2 = sum(k.values()) / sum(n.values()), sum(rates) / len(n), sum(x * x for x in rates) / len(n)
    between = m2 - m1 * m1 - mean * (1 - mean) * sum(1 / n[h] for h in n) / len(n)
    strength = max(mean * (1 - mean) / between - 1, 1.0) if between > 0 else 1e6
    return {h for h in n if (k[h] + mean * strength) / (n[h] + strength) >= 0.6}


def firsts_of_groups(rows):
    """Ids that stay when every pair is compared on its sets of five words."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i for i in root if top(i) == i}


def topic(text):
    low = text.lower()
    if "license" in low or "licence" in low:
        return "licensed"
    return "tabular" if " | " in text else "marked" if re.search("[#$%&*]{3}", text) else "shouted" if "!!" in text else "prose"


def copies_of(spark, rows):
    """Copies of each id by raking a dictionary of cells."""
    tokens = {r["doc_id"]: sum(map((r["text"] or "").count, " \t\r\n")) + 1 for r in rows}
    cell = {r["doc_id"]: (r["source"] or "", r["lang"] or "", topic(r["text"] or "")) for r in rows}
    seen = collections.Counter()
    for i, c in cell.items():
        seen[c] += tokens[i]
    total, fitted, goals = sum(seen.values()), dict(seen), []
    for m, name in enumerate(mixing.MARGINS):
        share = collections.Counter()
        for c, t in seen.items():
            share[c[m]] += t / total
        raised = {v: x ** corpus_pipeline.MIXTURE[name] for v, x in share.items()}
        goals.append({v: x / sum(raised.values()) * total for v, x in raised.items()})
    for _ in range(100):
        for m, goal in enumerate(goals):
            now = collections.Counter()
            for c, t in fitted.items():
                now[c[m]] += t
            fitted = {c: t * goal[c[m]] / now[c[m]] for c, t in fitted.items()}
    ids = spark.createDataFrame([(i,) for i in cell], "doc_id long")
    draw = {r[0]: r[1] for r in ids.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11) / F.lit(2.0**53)).collect()}
    found = {}
    for i, c in cell.items():
        weight = fitted[c] / seen[c]
        found[i] = int(weight) + (draw[i] < weight - int(weight))
    return {i: n for i, n in found.items() if n}


def test_stages_against_plain_python(spark):
    docs = common.table(spark, DATA, "documents")
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    kept = common.written(stages["quality_rules"](spark, docs, DATA), "kept")
    refused = refused_hosts(rows)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not fails(r["text"] or "") and r["source"] not in refused}
    good = common.written(stages["quality_classifier"](spark, kept, DATA), "good").collect()
    single = common.written(stages["minhash_dedup"](spark, spark.createDataFrame(good, docs.schema), DATA), "single")
    assert {r["doc_id"] for r in single.collect()} == firsts_of_groups(good)
    mixed = common.written(stages["mixing"](spark, single, DATA), "mixed")
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == copies_of(spark, single.collect())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = stages["piece_transducer"](spark, mixed, DATA).collect()
    want = {r["doc_id"]: library.encode(r["text"]) for r in mixed.collect()}
    assert len(found) == mixed.count() and all(r["ids"] == want[r["doc_id"]] for r in found)


def test_clashing_columns_and_repeated_rows(spark):
    """Columns named like the stages' own pass through; rows that repeat or tie share their fate."""
    docs = common.table(spark, DATA, "documents")
    names = ["_failed", "_good", "_host", "_dropped", "row", "mixed", "cell", "weight", "copy", "_salt", "host"]
    wide = docs.unionByName(docs.where("doc_id < 40"))
    for k, name in enumerate(names):
        wide = wide.withColumn(name, F.lit(k))
    plain = docs.unionByName(docs.where("doc_id < 40"))
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality_classifier":
            continue  # the same function of the texts; its fit is the slow part
        wide, plain = (common.written(stage(spark, df, DATA), name) for df in (wide, plain))
        if name != "piece_transducer":
            assert wide.columns == [*docs.columns, *names] and all([r[n] for n in names] == list(range(len(names))) for r in wide.select(*names).distinct().collect())
        assert collections.Counter(r["doc_id"] for r in wide.collect()) == collections.Counter(r["doc_id"] for r in plain.collect())
