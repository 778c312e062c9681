"""Pages of documents: the seam for renderers and detectors, which are given as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGES = "rel_path string, page int, ok boolean, error string, content binary"
BOXES = "rel_path string, page int, ok boolean, label int, score double, x0 double, y0 double, x1 double, y1 double"


def rendered(documents: DataFrame, render: Callable[[bytes], Iterator[bytes]]) -> DataFrame:
    """Pages of rows (rel_path, content); a document that fails midway gives one failed row and no more."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["rel_path"], batch["content"], strict=True):
                rows = []
                try:
                    rows = [(path, k + 1, True, None, page) for k, page in enumerate(render(content))]
                except Exception as why:  # noqa: BLE001  a renderer's failure is this row's status
                    rows = [(path, 0, False, str(why)[:200], None)]
                if rows:
                    yield pd.DataFrame(rows, columns=["rel_path", "page", "ok", "error", "content"])

    return documents.select("rel_path", "content").mapInPandas(step, PAGES)


def detected(pages: DataFrame, detector: Callable[[list[bytes]], list[list[tuple]]], batch_size: int = 16) -> DataFrame:
    """Boxes of pages in batches across documents; the last batch may be short.

    ``detector``: by page a list of (label, score, x0, y0, x1, y1).
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, int, bytes]] = []

        def flush() -> pd.DataFrame:
            found = detector([c for _, _, c in held])
            rows = [(p, n, True, *b) for (p, n, _), boxes in zip(held, found, strict=True) for b in boxes]
            held.clear()
            return pd.DataFrame(rows, columns=[x.split()[0] for x in BOXES.split(", ")])

        for batch in batches:
            for row in batch.itertuples():
                if row.ok:
                    held.append((row.rel_path, row.page, row.content))
                if len(held) >= batch_size:
                    yield flush()
        if held:
            yield flush()

    return pages.mapInPandas(step, BOXES)
