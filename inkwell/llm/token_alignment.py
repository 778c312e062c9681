"""Alignment of two tokenizers' tokens over the bytes of the texts (operator 11).

Both token sequences of a text cut the same bytes. With a row for each token and a column for
each byte they are two incidence matrices A and B in CSR form; a link is an entry of A·Bᵀ, two
tokens that share bytes. Places where a token of either ends cut the bytes into groups; with a
column for each group, an entry of the product of the group incidences links two tokens of one
group. Products are Gustavson's: each row of A sums up the rows of Bᵀ at its columns.

1. Texts are encoded once, and their ids are written with what a text says by itself.
2. Links are added up by id pair in tasks and then by pair.
3. Pairs that hold at least one in ``HOT`` of all links, at most ``HOT`` rows, go to all tasks,
   which add up what they are worth where the texts are; links of other pairs join the
   table of pairs by hash, so that no common pair gathers its texts.

The matrices of several texts are one: all tokens end where a text ends.

Texts are encoded with tiktoken over the vocabulary of the ``.json``, which gives the ids of
the tokenizers library in a fifth of its time; texts with white space in runs too long for its
pattern are left to that library.

Defined cases: null and empty texts, and those that either tokenizer does not give back byte
by byte, have no tokens: zeros and an empty ``groups_sha256``; special tokens' strings are
text; equal rows count each; null ids stay; with no rows there are none; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import ARROW_ROWS, map_arrow, session_of, setting, utf8, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HOT = 2_000_000
#: Bytes of text that make one pair of matrices, and entries that a task adds up at a time.
CHUNK_BYTES, PENDING = 2 << 20, 1_000_000
#: White space that is too long for the pattern of the fast encoder.
LONG_SPACE = re.compile(r"\s{500}")
OUT_ROWS = 100_000


class Csr(NamedTuple):
    """A sparse matrix of ones: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int


def incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes, of tokens that end at ``ends`` and leave no byte out."""
    size = int(ends[-1]) if len(ends) else 0
    return Csr(np.append(0, ends), np.arange(size), size)


def membership(groups: np.ndarray, n: int) -> Csr:
    """Tokens by groups: each token stands in one."""
    return Csr(np.arange(len(groups) + 1), groups, n)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    order = np.argsort(m.columns, kind="stable")
    return Csr(np.append(0, np.cumsum(np.bincount(m.columns, minlength=m.width))), rows[order], len(m.starts) - 1)


def entries_by_row(a: Csr, b: Csr) -> np.ndarray:
    """How many products Gustavson's method adds up for each row of ``a`` times ``b``."""
    sizes = np.append(0, np.cumsum(np.diff(b.starts)[a.columns]))
    return np.diff(sizes[a.starts])


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of ``a`` times ``b``, row by row: the rows of ``b`` at a row's columns, added up."""
    n = np.diff(b.starts)[a.columns]
    rows = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), n)
    columns = b.columns[np.repeat(b.starts[a.columns] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    if len(rows) and not np.all((rows[1:] > rows[:-1]) | (columns[1:] >= columns[:-1])):
        order = np.lexsort((columns, rows))
        rows, columns = rows[order], columns[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1]))[: len(rows)])
    return rows[first], columns[first], np.diff(np.append(first, len(rows)))


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoders:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {e: i for e, i in spec["model"]["vocab"].items() if e not in special}
        self.a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for e, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in e)
        ranks = {self.a_bytes[i]: i for i in vocab.values()}
        self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(b) for b in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def a_ids(self, text: str) -> list[int]:
        if LONG_SPACE.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def __call__(self, texts: list[bytes]) -> list[tuple[list[int], list[int]]]:
        """The ids of both for each text; none where either does not give its bytes back."""
        strings = [t.decode() for t in texts]
        found = []
        for raw, text, b in zip(texts, strings, self.pieces.encode(strings, num_threads=1), strict=True):
            a = self.a_ids(" " + text) if raw else []
            whole = b" " + raw
            fits = raw and b"".join(map(self.b_bytes.__getitem__, b)) == whole and b"".join(map(self.a_bytes.__getitem__, a)) == whole
            found.append((a, b) if fits else ([], []))
        return found


@functools.cache
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


class Aligned:
    """The tokens of several texts side by side, their groups and links."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64) for ids in (a, b))
        self.a_ends, self.b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        # bytes where both have a token that ends
        common = self.a_ends[np.isin(self.a_ends, self.b_ends, assume_unique=True)]
        self.n_groups = len(common)
        self.a_group, self.b_group = np.searchsorted(common, self.a_ends), np.searchsorted(common, self.b_ends)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A tokens, B tokens) that share bytes: the entries of A·Bᵀ."""
        return product(incidence(self.a_ends), transposed(incidence(self.b_ends)))[:2]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pairs, texts) of all links."""
        i, j = self.links()
        return self.a[i] << 32 | self.b[j], np.repeat(np.arange(len(self.n_a)), self.n_a)[i]

    def group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A tokens, B tokens) that share a group."""
        return product(membership(self.a_group, self.n_groups), transposed(membership(self.b_group, self.n_groups)))[:2]

    def n_group_links(self) -> np.ndarray:
        """For each A token, how many B tokens share its group; tells their number without making them."""
        return entries_by_row(membership(self.a_group, self.n_groups), transposed(membership(self.b_group, self.n_groups)))

    def by_text(self, values: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values))
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]

    def texts_of_groups(self, a_names: np.ndarray, b_names: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text. Names hold each id twice: before one of its group, and as its last."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (self.a_group, self.b_group))
        out = np.empty(len(self.a) + len(self.b), object)
        # before a token stand those of its own side, and the other side's of the groups before (B: of its own group too)
        out[np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group)] = a_names[self.a + last_a * (len(a_names) // 2)]
        out[np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, "right")] = b_names[self.b + last_b * (len(b_names) // 2)]
        out, ends = out.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(out[e - n : e])[:-1] for e, n in zip(ends, (self.n_a + self.n_b).tolist(), strict=True)]


def chunked(sizes: list[int]):
    """Slices of rows that hold about ``CHUNK_BYTES`` together."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > CHUNK_BYTES:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encoded(docs: DataFrame, a_path: str, b_path: str, text_col: str) -> DataFrame:
    """(row, doc_id, a, b, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256), written; a and b hold the ids, four bytes each."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def step(batches):
        both = encoders(a_path, b_path)
        a_names, b_names = (np.array([f"{i}{s}" for s in seps for i in range(n)], object) for n, seps in ((len(both.a_sizes), ",|"), (len(both.b_sizes), ",;")))
        for batch in batches:
            raw = utf8(batch, "text")
            for part in chunked([len(t) for t in raw]):
                ids = [(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in both(raw[part])]
                x = Aligned([a for a, _ in ids], [b for _, b in ids], both.a_sizes, both.b_sizes)
                names = x.texts_of_groups(a_names, b_names)
                _, text = x.pairs()
                fresh = np.append(True, x.a_group[1:] != x.a_group[:-1])[: len(x.a)]
                columns = [
                    *(c.slice(part.start, part.stop - part.start) for c in batch.columns[:2]),
                    pa.array([a.tobytes() for a, _ in ids], pa.binary()), pa.array([b.tobytes() for _, b in ids], pa.binary()),
                    *(pa.array(c.astype(np.int64)) for c in (x.n_a, x.n_b, x.by_text(fresh, x.n_a), np.bincount(text, minlength=len(ids)), x.by_text(x.n_group_links(), x.n_a))),
                    pa.array([hashlib.sha256(n.encode()).hexdigest() if n else "" for n in names], pa.string()),
                ]
                yield pa.record_batch(columns, names=["row", "doc_id", "a", "b", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256"])

    schema = "row long, doc_id long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string"
    with setting(session_of(docs), ARROW_ROWS, "1000"):
        return written(map_arrow(texts, step, schema), "tokens")


def aligned(batches, a_path: str, b_path: str):
    """Yields (rows, texts side by side) of the encoded table, several at a time."""
    both = encoders(a_path, b_path)
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint32) for x in batch.column(batch.schema.get_field_index(n)).to_pylist()] for n in ("a", "b"))
        for part in chunked([4 * len(x) for x in a]):
            yield np.asarray(batch.column(0))[part], Aligned(a[part], b[part], both.a_sizes, both.b_sizes)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def pair_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n, best), written: the links of each id pair, and if its B id has none with more."""

    def step(batches):
        keys, counts = [], []
        for _, x in aligned(batches, a_path, b_path):
            found, n = np.unique(x.pairs()[0], return_counts=True)
            keys, counts = [*keys, found], [*counts, n]
            if sum(map(len, keys)) > PENDING:
                found, n = merged(keys, counts)
                keys, counts = [found], [n]
                if len(found) > PENDING // 2:
                    yield from pair_batches(found, n)
                    keys, counts = [], []
        if keys:
            yield from pair_batches(*merged(keys, counts))

    def pair_batches(found, n):
        for at in range(0, len(found), OUT_ROWS):
            yield pa.record_batch([pa.array(c[at : at + OUT_ROWS].astype(np.int64)) for c in (found, n)], names=["pair", "n"])

    rows = map_arrow(tokens.select("row", "a", "b"), step, "pair long, n long")
    counts = written(rows.groupBy("pair").agg(F.sum("n").alias("n")), "pairs").withColumn("b_id", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    return written(counts.join(F.broadcast(most), "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "links")


def id_links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n, best): all id pairs that are linked anywhere, as a map between the vocabularies."""
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    links = pair_counts(encoded(docs, a_path, b_path, text_col), a_path, b_path)
    return links.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n", "best")


def token_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links."""
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    tokens = encoded(docs, a_path, b_path, text_col)
    links = pair_counts(tokens, a_path, b_path)
    total = links.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * hot >= total
    common = links.where(is_hot).toPandas().sort_values("pair")  # at most ``hot`` rows
    shared = session_of(docs).sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), common["best"].to_numpy(bool)))

    def step(batches):
        known, n, best = shared.value
        for rows, x in aligned(batches, a_path, b_path):
            pair, text = x.pairs()
            where = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            here = known[where] == pair if len(known) else np.zeros(len(pair), bool)
            own, rest_of, rest = text[here], text[~here], pair[~here]
            worth, good = (np.bincount(own, values[where[here]], len(rows)).astype(np.int64) if len(known) else np.zeros(len(rows), np.int64) for values in (n, best))
            # what is added up already needs no partner
            order = np.lexsort((rest, rest_of))
            rest, rest_of = rest[order], rest_of[order]
            first = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (rest_of[1:] != rest_of[:-1]))[: len(rest)])
            times = np.diff(np.append(first, len(rest)))
            row = np.concatenate([rows, rows[rest_of[first]]])
            key = np.concatenate([-1 - rows, rest[first]])
            gaps = np.arange(len(row)) >= len(rows)
            columns = [np.concatenate([c, np.zeros(len(times), np.int64)]) for c in (worth, good)]
            for at in range(0, len(row), OUT_ROWS):
                cut = slice(at, at + OUT_ROWS)
                yield pa.record_batch([pa.array(row[cut]), pa.array(key[cut]), pa.array(np.concatenate([np.zeros(len(rows), np.int64), times])[cut]), *(pa.array(c[cut], mask=gaps[cut]) for c in columns)], names=["row", "pair", "times", "worth", "good"])

    found = map_arrow(tokens.select("row", "a", "b"), step, "row long, pair long, times long, worth long, good long")
    rare = links.where(~is_hot).hint("shuffle_hash")
    joined = found.join(rare, "pair", "left")
    worth, good = F.coalesce("worth", F.col("times") * F.col("n")), F.coalesce("good", F.col("times") * F.col("best").cast("long"))
    sums = joined.groupBy("row").agg(F.sum(good).alias("n_best"), F.sum(worth).alias("count_sum"))
    names = ["n_a", "n_b", "n_groups", "n_links"]
    return tokens.drop("a", "b").join(sums, "row").select("doc_id", *names, "n_best", "count_sum", "groups_sha256", "n_group_links")
