"""SentencePiece encoding and decoding as a weighted transducer (operator 9).

The model file is compiled into three machines: the normaliser (dummy prefix, white space
to its mark), the pieces (each an arc over its characters that writes its id and weighs
minus its score) and the byte fallback (a character outside every piece writes its bytes
and weighs more than any piece). Composed with an input, paths are segmentations; the
tropical shortest path is found by relaxing the positions from left to right. That is what
the library gives for a unigram model. In a BPE model an arc also weighs infinity after a
piece that it may not follow: two pieces may be neighbours exactly if merging their
characters greedily by score gives back these two. One path of finite weight remains, and
it is what the library's merges give. The machine is composed segment by segment (no
piece crosses their borders), and shortest paths of segments that recur are kept.

Why adjacent pairs suffice: greedy merging inside a stretch doesn't depend on what is
outside until a merge crosses its border; the first one that crosses the border between
two pieces would also cross it in these two alone.

Defined cases: a null or empty text has no pieces and decodes to ""; rows may repeat; ids
outside the vocabulary can't be decoded and give the unknown piece's mark; with no rows
there are none; other columns are passed over.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import map_arrow, utf8

MODEL = "piece_bpe_32k.model"
#: White space's mark in pieces, and the kinds of pieces in a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_TEXT = " ⁇ "
#: Segments whose shortest paths a worker keeps, in each of two generations.
KEPT = 500_000
KEPT_CHARS = 40


class PieceTransducer:
    """One compiled model; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only unigram and BPE models with an identity normaliser are compiled")
        if any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("user-defined or unused pieces are not compiled")
        self.dummy_prefix = norm.add_dummy_prefix
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.kinds = [p.type for p in model.pieces]
        self.longest = max(map(len, self.ids))
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        crossed = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        # A cut that no piece crosses: before a run of marks, and around characters that are in no longer piece.
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inner)
        self.cut = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+") if not crossed else re.compile("(?s).+")
        self.bpe = model.trainer_spec.model_type == BPE
        self.halves = self._halves() if self.bpe else {}
        #: whether every merge scores at most what made its parts, so that scores tell the order of merges
        self.ordered = all(self.scores[h] >= self.scores[p] for p, two in self.halves.items() for h in two if len(h) > 1)
        #: a tree by characters; at the end of a piece its arc under "": the piece and its weight. What merging never makes has none.
        self.arcs: dict = {}
        for piece, score in self.scores.items():
            if not self.bpe or len(piece) == 1 or piece in self.halves:
                node = self.arcs
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (piece, -score)
        self.unknown_weight = 10.0 - min(self.scores.values())
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.out = [self._written(i) for i in range(len(self.texts))]

    def _written(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.texts[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return UNKNOWN_TEXT.encode()
        return self.texts[i].replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Greedy merging of a short text, and the two parts of the last merge."""
        parts, last = list(text), None
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = ["".join(last)]
        return parts, last

    def _halves(self) -> dict[str, tuple[str, str]]:
        """By piece that merging can make: the two parts that its last merge joins."""
        found = {}
        for piece in self.scores:
            if len(piece) > 1:
                parts, last = self.merged(piece)
                if len(parts) == 1:
                    found[piece] = last
        return found

    def follows(self, a: str, b: str) -> bool:
        """Whether the arc of ``b`` after that of ``a`` has a finite weight in a BPE machine.

        It has if no merge ever crosses the border. Going back in time, the merge that came
        last (that of the lower score) is undone on its side; what then ends ``a`` and begins
        ``b`` stood side by side until that merge, and would have been joined if joining
        them scores more (or as much, where that place is the leftmost).
        """
        if not self.ordered:
            return self.merged(a + b)[0] == [a, b]
        scores, halves = self.scores, self.halves
        bound, first = float("-inf"), True
        while True:
            crossing = scores.get(a + b)
            if crossing is not None and (crossing > bound or (first and crossing == bound)):
                return False
            left, right = halves.get(a), halves.get(b)
            if right is not None and (left is None or scores[b] <= scores[a]):
                bound, first, b = scores[b], True, right[0]
            elif left is not None:
                bound, first, a = scores[a], False, left[1]
            else:
                return True

    def shortest(self, text: str) -> list[str]:
        """The pieces of the path of least weight through the machine composed with ``text``.

        Positions are relaxed from left to right. Where pieces must fit each other, the
        path of finite weight up to a position is unique, so that one state each is enough.
        """
        n, inf = len(text), float("inf")
        cost, back, last = [0.0] + [inf] * n, [0] * (n + 1), [""] * (n + 1)
        bpe, nothing = self.bpe, {}
        for i in range(n):
            here, before = cost[i], last[i]
            if here == inf:
                continue
            known = self.fits.setdefault(before, {}) if bpe and before else nothing
            node = self.arcs
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                arc = node.get("")
                if arc is None:
                    continue
                part, weight = arc
                if here + weight < cost[j + 1]:
                    ok = known.get(part)
                    if ok is None:
                        ok = not bpe or not before or self.follows(before, part)
                        if bpe and before:
                            known[part] = ok
                            self.n_fits += 1
                    if ok:
                        cost[j + 1], back[j + 1], last[j + 1] = here + weight, i, part
            if text[i] not in self.ids and here + self.unknown_weight < cost[i + 1]:
                cost[i + 1], back[i + 1], last[i + 1] = here + self.unknown_weight, i, text[i]
        path = []
        while n:
            path.append(last[n])
            n = back[n]
        return path[::-1]

    def segment_ids(self, segment: str) -> bytes:
        """The ids of a segment as 32-bit integers; shortest paths are kept for a while."""
        kept = self.older.get(segment)
        if kept is None:
            found = array("i")
            for piece in self.shortest(segment):
                i = self.ids.get(piece)
                if i is not None:
                    found.append(i)
                elif self.bytes:
                    found.extend(self.bytes[b] for b in piece.encode())
                else:
                    found.append(self.unknown)
            kept = found.tobytes()
        if len(segment) <= KEPT_CHARS:
            if len(self.paths) >= KEPT:
                self.paths, self.older = {}, self.paths
            self.paths[segment] = kept
        return kept

    def encode_into(self, found: array, text: str) -> None:
        """Adds the ids of ``text`` to ``found``."""
        begin, kept, miss = len(found), self.paths.get, self.segment_ids
        found.frombytes(b"".join([kept(s) or miss(s) for s in self.cut.findall(self.normalise(text))]))
        if self.n_fits > 4 * KEPT:
            self.fits, self.n_fits = {}, 0
        if not self.bytes:  # without byte fallback, a run of unknown characters is one piece
            own = found[begin:].tolist()
            del found[begin:]
            found.extend(i for k, i in enumerate(own) if i != self.unknown or not k or own[k - 1] != i)

    def encode(self, text: str) -> list[int]:
        found = array("i")
        self.encode_into(found, text)
        return found.tolist()

    def decode(self, ids) -> str:
        last = len(self.out)
        text = b"".join([self.out[i] if 0 <= i < last else UNKNOWN_TEXT.encode() for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.cache
def transducer(model_path: str) -> PieceTransducer:
    """The compiled model, once for each Python worker."""
    return PieceTransducer(model_path)


def encoded_column(machine: PieceTransducer, texts: list[bytes]) -> pa.ListArray:
    found, offsets = array("i"), array("i", [0])
    for raw in texts:
        machine.encode_into(found, raw.decode())
        offsets.append(len(found))
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(found, np.int32) if found else [], pa.int32()))


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the piece ids of every whole text."""
    model_path = model_path or public_tokenizers.path(MODEL)

    def step(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), encoded_column(transducer(model_path), utf8(batch, "text"))], names=["doc_id", "ids"])

    rows = docs.select("doc_id", F.col(text_col).alias("text"))
    return map_arrow(rows, step, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null."""
    model_path = model_path or public_tokenizers.path(MODEL)

    def step(batches):
        for batch in batches:
            texts = [None if ids is None else transducer(model_path).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return map_arrow(rows, step, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


ROUND = "doc_id {kind}, n_pieces long, n_bytes_pieces long, round_trip boolean, ids array<int>"


def round_trips(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """One row per document: n_pieces, how many of them are of the byte fallback, whether
    decoding gives the text back, and the ids."""
    model_path = model_path or public_tokenizers.path(MODEL)

    def step(batches):
        for batch in batches:
            machine = transducer(model_path)
            texts = utf8(batch, "text")
            column = encoded_column(machine, texts)
            offsets, ids = column.offsets.to_numpy(), column.values.to_numpy()
            fallback = np.concatenate([[0], np.cumsum(np.isin(ids, list(machine.bytes.values())))])
            same = [machine.decode(ids[a:b].tolist()) == raw.decode() for raw, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
            n, byte_pieces = np.diff(offsets).astype(np.int64), fallback[offsets[1:]] - fallback[offsets[:-1]]
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(byte_pieces, pa.int64()), pa.array(same, pa.bool_()), column], names=["doc_id", "n_pieces", "n_bytes_pieces", "round_trip", "ids"])

    rows = docs.select("doc_id", F.col(text_col).alias("text"))
    return map_arrow(rows, step, ROUND.format(kind=dict(rows.dtypes)["doc_id"]))
