"""Alignments against loops over tokens, sparse products against dense ones, and the defined cases."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkwell.llm import token_alignment as ta
from tests.llm.test_operators import DATA, ODD, docs_of

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE = {c: b for c, b in ta.byte_alphabet().items()}


def tokens(text):
    if not text:
        return [], []
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])


def spans(side):
    at, found = 0, []
    for i, t in side:
        found.append((i, at, at + len(t)))
        at += len(t)
    return found


def brute(texts):
    links, rows = {}, []
    for k, text in enumerate(texts):
        a, b = map(spans, tokens(text))
        links[k] = [(i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v)]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = ["|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        rows.append([len(a), len(b), len(groups), len(links[k]), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    counts = collections.Counter(p for own in links.values() for p in own)
    most = collections.Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(*r[:4], sum(counts[p] == most[p[1]] for p in links[k]), sum(counts[p] for p in links[k]), r[4]) for k, r in enumerate(rows)]


def some_texts(spark):
    rng = random.Random(2)
    real = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    odd = ["", None, " ", "  two  spaces ", "tab\tand\nline\r\n", "▁ stands for a space", "a <|endoftext|> b</s><unk><0x41>", "漢字かな交じり文 \U0001f642\U0001f469‍\U0001f680", "é é ﬁ    ", "\x00\x01", " " * 700 + "x", "﻿bom", real[3], real[3]]
    return real + odd + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1FAFF)])) for _ in range(80)) for _ in range(10)]


@pytest.mark.parametrize("hot", [300, ta.HOT])
def test_equals_loops(spark, hot):
    texts = some_texts(spark)
    found = {r["doc_id"]: tuple(r)[1:8] for r in ta.token_alignment(docs_of(spark, list(enumerate(texts))), hot=hot).collect()}
    assert [found[k] for k in range(len(texts))] == brute(texts)


def test_fast_ids_are_the_librarys(spark):
    both = ta.encoders(public_tokenizers.path(ta.A_FILE), public_tokenizers.path(ta.B_FILE))
    texts = [t for t in some_texts(spark) if t] + ["\n" * 3000 + "x", "a" * 5000, "".join(chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000)]
    for t in texts:
        assert both.a_ids(" " + t) == A.encode(" " + t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_products(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((9, 7)) < 0.3, rng.random((7, 8)) < 0.4

    def csr(dense):
        return ta.Csr(np.append(0, np.cumsum(dense.sum(1))), np.nonzero(dense)[1], dense.shape[1])

    want = a.astype(int) @ b.astype(int)
    rows, columns, values = ta.product(csr(a), csr(b))
    assert [rows.tolist(), columns.tolist()] == [x.tolist() for x in np.nonzero(want)] and values.tolist() == want[want > 0].tolist()
    assert ta.entries_by_row(csr(a), csr(b)).tolist() == want.sum(1).tolist()
    back = ta.transposed(csr(a))
    assert [back.starts.tolist(), back.columns.tolist()] == [csr(a.T).starts.tolist(), csr(a.T).columns.tolist()]


def test_group_links_are_counted_as_made(spark):
    both = ta.encoders(public_tokenizers.path(ta.A_FILE), public_tokenizers.path(ta.B_FILE))
    ids = [tuple(np.array(x, np.uint32) for x in p) for p in both([(t or "").encode() for t in some_texts(spark)])]
    x = ta.Aligned([a for a, _ in ids], [b for _, b in ids], both.a_sizes, both.b_sizes)
    i, j = x.group_links()
    assert np.array_equal(np.bincount(i, minlength=len(x.a)), x.n_group_links())
    assert np.array_equal(x.a_group[i], x.b_group[j])
    assert set(zip(*x.links(), strict=True)) <= set(zip(i, j, strict=True))


def test_defined_cases(spark):
    found = ta.token_alignment(docs_of(spark, ODD)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert tuple(by_id[0])[1:] == tuple(by_id[1])[1:] == (0, 0, 0, 0, 0, 0, "", 0)
    assert ta.token_alignment(docs_of(spark, [])).collect() == []


def test_map_of_ids(spark):
    texts = some_texts(spark)
    links = collections.Counter()
    for t in texts:
        a, b = map(spans, tokens(t))
        links.update((i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v))
    found = ta.id_links(docs_of(spark, list(enumerate(texts)))).collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in found} == links
