"""Mixing sources to target weights by iterative proportional fitting (operator 7).

Documents fall into cells of source, language and topic. The cells' token sums are raked
until they meet the target shares of all three marginals; a cell's weight is its fitted
over its observed tokens. A document is drawn weight times ``rate`` times: the whole part
as copies, and one more with the fraction's probability, so that expected shares equal the
targets and expected tokens are ``rate`` times the observed ones, however heavy a cell is.

Defined cases: a null source, language or text counts as an empty one; a document weighs
one token at least, a very long one all of its tokens; a target for a value without documents is left out and the others
are rescaled; without rows the result is empty; repeated rows, and all rows without an id,
share their fate (the draw depends on id and seed); other columns are passed over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import join_salted, session_of, written

MARGINS = ("source", "lang", "topic")


def topic_of(text):
    """A coarse topic from the text's form, where documents have none of their own."""
    low = F.lower(text)
    return (
        F.when(low.contains("license") | low.contains("licence"), "licensed")
        .when(text.contains(" | "), "tabular")
        .when(text.rlike(r"[#$%&*]{3}"), "marked")
        .when(text.contains("!!"), "shouted")
        .otherwise("prose")
    )


def cell_of(text_col: str = "text", topic_col: str | None = None, tokens_col: str | None = None):
    """struct(source, lang, topic, n_tokens) of a row.

    ``topic_col`` and ``tokens_col`` name columns that hold topics and token counts (of
    ``token_counts``, say); without them topics come from ``topic_of``, and a token is what
    white space ends.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gaps = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in " \t\r\n"), F.lit(1))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    tokens = F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(1)) if tokens_col else gaps
    return F.struct(empty("source").alias("source"), empty("lang").alias("lang"), (empty(topic_col) if topic_col else topic_of(text)).alias("topic"), tokens.cast("long").alias("n_tokens"))


def tempered(observed: dict[str, float], power: float) -> dict[str, float]:
    """Target shares between the observed ones (power 1) and equal ones (power 0)."""
    raised = {k: v**power for k, v in observed.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake_cells(values: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], sweeps: int, tolerance: float) -> np.ndarray:
    """Fitted tokens of cells; ``values`` holds each cell's number in each marginal."""
    fitted = tokens.astype(float)
    total = fitted.sum()
    for _ in range(sweeps):
        worst = 0.0
        for codes, share in zip(values, targets, strict=True):
            now = np.bincount(codes, fitted, len(share))
            factor = np.divide(share * total, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0)))
            fitted *= factor[codes]
        if worst < tolerance:
            break
    return fitted


def rake_frames(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict[str, float]] | None, sweeps: int, tolerance: float) -> DataFrame:
    """The same fit over a cell table of any size, one aggregate and join for each marginal."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = written(cells.withColumn("fitted", F.col("tokens").cast("double")), "cells")
    goals = {}
    for m in MARGINS:
        if targets and m in targets:
            given = session_of(cells).createDataFrame(list(targets[m].items()), f"{m} string, share double")
            raised = cells.select(m).distinct().join(given, m)
        else:
            raised = cells.groupBy(m).agg(F.pow(F.sum("tokens") / F.lit(float(total)), F.lit(powers[m])).alias("share"))
        goals[m] = written(raised.join(F.broadcast(raised.agg(F.sum("share").alias("all")))).select(m, (F.col("share") / F.col("all") * total).alias("goal")), "goals")
    for _ in range(sweeps):
        worst = 0.0
        for m in MARGINS:
            now = state.groupBy(m).agg(F.sum("fitted").alias("now")).join(goals[m], m, "left")
            factor = written(now.select(m, F.when(F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("now")).otherwise(1.0).alias("factor")), "factors")
            worst = max(worst, factor.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            state = join_salted(state, factor, m, "topic").withColumn("fitted", F.col("fitted") * F.col("factor")).drop("factor")
        state = written(state, "cells")
        if worst < tolerance:
            break
    return state


def cell_weights(
    cells: DataFrame,
    powers: dict[str, float],
    targets: dict[str, dict[str, float]] | None = None,
    sweeps: int = 100,
    tolerance: float = 1e-9,
    max_local_cells: int = 100_000,
) -> tuple[DataFrame, bool]:
    """(source, lang, topic, weight) from (source, lang, topic, tokens); whether the table is bounded.

    Up to ``max_local_cells`` cells (a few MB) are fitted on the driver; above it the same
    steps run as joins.
    """
    cells = written(cells, "cells")
    head = cells.limit(max_local_cells + 1).count()
    if head > max_local_cells:
        fitted = rake_frames(cells, powers, targets, sweeps, tolerance)
        return fitted.select(*MARGINS, (F.col("fitted") / F.col("tokens")).alias("weight")), False
    rows = sorted(tuple(r) for r in cells.select(*MARGINS, "tokens").collect())
    tokens = np.array([r[3] for r in rows], float)
    codes, goals = [], []
    for k, m in enumerate(MARGINS):
        names = sorted({r[k] for r in rows})
        number = {v: i for i, v in enumerate(names)}
        codes.append(np.array([number[r[k]] for r in rows], int))
        observed = np.bincount(codes[-1], tokens, len(names)) if rows else np.zeros(0)
        if targets and m in targets:
            share = np.array([targets[m].get(v, 0.0) for v in names])
        else:
            shares = tempered(dict(zip(names, observed / max(tokens.sum(), 1), strict=True)), powers[m])
            share = np.array([shares[v] for v in names])
        goals.append(share / share.sum() if share.sum() else share)
    fitted = rake_cells(codes, tokens, goals, sweeps, tolerance) if rows else tokens
    weights = [(*r[:3], float(f / r[3])) for r, f in zip(rows, fitted, strict=True)]
    return session_of(cells).createDataFrame(weights, "source string, lang string, topic string, weight double"), True


#: Exponents of the target shares in the queries: sources are evened out most.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}


def drawn(docs: DataFrame, powers: dict[str, float] | None, targets: dict[str, dict[str, float]] | None, seed: int, text_col: str, rate: float = 1.0, topic_col: str | None = None, tokens_col: str | None = None, **fit) -> DataFrame:
    """(row, doc_id, mixed): ``row`` has all columns of ``docs``, ``mixed`` the cell, n_tokens, weight, probability (of one copy at least), sampled and copies."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", cell_of(text_col, topic_col, tokens_col).alias("mixed"))
    cells = rows.select("mixed.*").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    weights, bounded = cell_weights(cells, powers or POWERS, targets, **fit)
    weights = weights.select(F.to_json(F.struct(*MARGINS)).alias("cell"), "weight")
    rows = rows.withColumn("cell", F.to_json(F.struct(*(F.col(f"mixed.{m}") for m in MARGINS))))
    joined = rows.join(F.broadcast(weights), "cell") if bounded else join_salted(rows, written(weights, "weights"), "cell", "doc_id", "inner")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(2**53))
    wanted = F.col("weight") * F.lit(float(rate))
    copies = (F.floor(wanted) + (draw < wanted - F.floor(wanted)).cast("long")).cast("long")
    mixed = F.struct("mixed.*", F.col("weight").alias("weight"), F.least(wanted, F.lit(1.0)).alias("probability"), (copies > 0).alias("sampled"), copies.alias("copies"))
    return joined.select("row", "doc_id", mixed.alias("mixed"))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, seed: int = 17, text_col: str = "text", **fit) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, sampled, copies."""
    return drawn(docs, powers, targets, seed, text_col, **fit).select("doc_id", "mixed.*")


def sampled(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, seed: int = 17, text_col: str = "text", **fit) -> DataFrame:
    """The rows of ``docs`` that the mixture draws, with their columns, as often as it draws them; texts don't move."""
    found = drawn(docs, powers, targets, seed, text_col, **fit).where("mixed.sampled")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mixed.copies")))
    return found.select("row", again.alias("copy")).select("row.*")
