"""Quality classifier with naive Bayes support vectors (operator 4).

Features are indicators of n-grams: runs of one or two symbols of a 128-letter alphabet
(letters folded, capitals, digits, white space and the ASCII marks apart, and of the bytes
of other scripts their lower six bits) and of three of a 64-letter one (of other scripts'
bytes two bits), so that every n-gram has a number of its own; and, of the word bigrams, how
many repeat a word, with the share of distinct words, in classes.
Each indicator is scaled by the log ratio of its smoothed class counts; a linear hinge-loss
model over the scaled features is fitted by dual coordinate descent, and its margin is
turned into a probability by a logistic curve fitted on the same rows' margins out of fold.

Class counts are taken over all training rows. The linear model is fitted on a bounded
sample of them (``max_fit_rows``, chosen by a digest of the id, balanced by class) of texts
of any length: what reaches the driver is a row's n-gram numbers, not its text.

Defined cases: a null or empty text has no features and scores by the bias alone; very long
texts are read whole and weigh as one row; without training rows of both classes every
score is 0.5; repeated rows count each; a label other than 0 or 1 or null is no training
row, and neither is a document whose labels contradict each other; other columns are
passed over.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import map_arrow, spare, utf8, with_verdict

ALPHABET, COARSE = 128, 64
#: Upper bounds of the classes of a text's share of repeating bigrams and of distinct words.
SHARES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95])
#: Feature numbers: one symbol, two symbols, three symbols, then the two classes.
N_GRAMS = ALPHABET + ALPHABET**2 + COARSE**3
N_FEATURES = N_GRAMS + 2 * (len(SHARES) + 1)
LETTERS, MARKS = b"abcdefghijklmnopqrstuvwxyz", b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"


def symbol_table() -> np.ndarray:
    """By byte: the symbol's number."""
    table = np.full(256, 63, np.uint32)  # all other control bytes
    table[128:] = 64 + (np.arange(128, 256) & 63)
    for i, b in enumerate(LETTERS):
        table[b] = i
    table[ord("A") : ord("Z") + 1] = 26
    table[ord("0") : ord("9") + 1] = 27
    table[ord(" ")], table[ord("\n")], table[ord("\t")] = 28, 29, 30
    for i, b in enumerate(MARKS):
        table[b] = 31 + i
    return table


SYMBOLS = symbol_table()
#: By byte: its symbol in n-grams of three.
COARSE_SYMBOLS = np.where(SYMBOLS < COARSE, SYMBOLS, 60 + (SYMBOLS & 3)).astype(np.uint32)


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams that occur; ``seen`` is a zeroed scratch row and is left zeroed."""
    raw = np.frombuffer(text, np.uint8)
    s = SYMBOLS[raw]
    seen[s] = True
    if len(s) > 1:
        seen[s[:-1] * ALPHABET + s[1:] + ALPHABET] = True
        if len(s) > 2:
            c = COARSE_SYMBOLS[raw]
            seen[(c[:-2] * COARSE + c[1:-1]) * COARSE + c[2:] + ALPHABET + ALPHABET**2] = True
    words = text.split()
    if len(words) > 1:
        repeats = sum(map(eq, words, words[1:])) / (len(words) - 1)
        seen[N_GRAMS + np.searchsorted(SHARES, repeats)] = True
        seen[N_GRAMS + len(SHARES) + 1 + np.searchsorted(SHARES, len(set(words)) / len(words))] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    """Weights of the indicators themselves (ratio times hinge weight), bias and logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        seen = np.zeros(N_FEATURES, bool)
        margins = np.empty(len(texts))
        for i, t in enumerate(texts):
            margins[i] = self.weights[features(t, seen)].sum() + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of least half squared norm plus ``cost`` times hinge loss, over indicators scaled by ``ratio``."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    scaled = [ratio[f] for f in rows]
    square = np.array([(v**2).sum() + 1.0 for v in scaled])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * scaled[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step) * square[i])
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1) by the margin: Newton steps on a lightly penalised loss."""
    scale = max(float(np.abs(margins).mean()), 1e-9)
    x, t = margins / scale, (y + 1) / 2
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g = np.array([((p - t) * x).sum() + 1e-2 * a, (p - t).sum() + 1e-2 * b])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-6) / scale, b


def class_counts(training: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by class, and by class and n-gram, over all training rows.

    Each task adds up its rows; what reaches the driver is at most one row for each of
    the ``N_FEATURES`` n-grams and two classes.
    """

    def step(batches):
        counts, n = np.zeros((2, N_FEATURES), np.int64), np.zeros(2, np.int64)
        seen = np.zeros(N_FEATURES, bool)
        for batch in batches:
            for text, label in zip(utf8(batch, "text"), batch.column(1).to_pylist(), strict=True):
                counts[label, features(text, seen)] += 1
                n[label] += 1
        for label in (0, 1):
            at = np.flatnonzero(counts[label])
            yield pa.record_batch(
                [pa.array(np.append(at, N_FEATURES)), pa.array(np.full(len(at) + 1, label)), pa.array(np.append(counts[label, at], n[label]))],
                names=["feature", "label", "n"],
            )

    parts = map_arrow(training.select("text", "label"), step, "feature long, label long, n long")
    rows = parts.groupBy("feature", "label").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, N_FEATURES + 1), np.int64)
    counts[rows["label"].to_numpy(), rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return counts[:, N_FEATURES], counts[:, :N_FEATURES]


def featured(rows: DataFrame) -> DataFrame:
    """(doc_id, label, features) of rows (doc_id, text, label)."""

    def step(batches):
        seen = np.zeros(N_FEATURES, bool)
        for batch in batches:
            found = pa.array([features(t, seen).astype(np.int32) for t in utf8(batch, "text")], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(2), found], names=["doc_id", "label", "features"])

    return map_arrow(rows.select("doc_id", "text", "label"), step, f"doc_id {dict(rows.dtypes)['doc_id']}, label long, features array<int>")


def fit(training: DataFrame, max_fit_rows: int = 6000, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> Model | None:
    """A model from rows (doc_id, text, label 0 or 1); None without rows of both classes.

    ``max_fit_rows`` bounds only the hinge-loss sample on the driver.
    """
    n, counts = class_counts(training)
    if not n.all():
        return None
    smooth = 1.0
    p, q = counts[1] + smooth, counts[0] + smooth
    ratio = np.log((p / (n[1] + 2 * smooth)) / (q / (n[0] + 2 * smooth)))
    parts = []
    for label in (0, 1):
        own = min(1.0, 1.5 * max_fit_rows / 2 / n[label])
        draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
        rows = featured(training.where((F.col("label") == label) & (draw < int(own * (1 << 20)) + 1)))
        parts.append(rows.orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(max_fit_rows // 2))
    sample = parts[0].select("features", "label").union(parts[1].select("features", "label")).toPandas()
    if sample["label"].nunique() < 2:
        return None
    rows = [np.asarray(f, np.int64) for f in sample["features"]]
    y = np.where(sample["label"].to_numpy() == 1, 1.0, -1.0)
    each = np.where(y > 0, len(y) / 2 / (y > 0).sum(), len(y) / 2 / (y < 0).sum())  # classes weigh the same
    fold = np.arange(len(y)) % 3
    margins = np.empty(len(y))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        w, bias = dual_coordinate_descent([rows[i] for i in inside], ratio, y[inside], cost * each[inside], epochs, seed)
        for i in np.flatnonzero(fold == k):
            margins[i] = w[rows[i]] @ ratio[rows[i]] + bias
    w, bias = dual_coordinate_descent(rows, ratio, y, cost * each, epochs, seed)
    slope, offset = logistic_curve(margins, y)
    return Model(w * ratio, float(bias), float(slope), float(offset))


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; 0.5 without a model."""
    rows = docs.select("doc_id", F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES doubles: 2 MB

    def step(batches):
        for batch in batches:
            found = shared.value.scores(utf8(batch, "text"))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return map_arrow(rows, step, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def held_out():
    """True for the third of the ids that is never trained on."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): labelled rows outside the held-out third.

    The labels are joined by id; they are few beside the texts and pre-filtered, so the
    smaller side builds the table and no text is sorted.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("long").alias("label"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").drop("_other")
    rows = docs.where(~held_out()).select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(known.hint("shuffle_hash"), "doc_id")


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **parameters) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(training_rows(docs, labels, text_col), **parameters)
    return score(docs, model, text_col).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **parameters) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with their columns; texts don't move."""
    model = fit(training_rows(docs, labels, text_col), **parameters)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    good = spare(docs, "_good")
    return with_verdict(docs, good, lambda texts: (shared.value.scores(texts) >= threshold).tolist(), text_col).where(F.col(good)).drop(good)
