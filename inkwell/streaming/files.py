"""Results of files whose pages arrive in any order, emitted when a file is complete.

State is kept by file: a map from page to its detections, which goes with the file's result.
A file is complete when it has as many pages as it announced. One that isn't by the time
that the watermark passes its last page by ``patience``, or that its source closes (a
row without a page), is emitted as incomplete. So what is kept is the open files' pages alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAGES = "file bigint, page bigint, total_pages bigint, detections bigint, ts timestamp"
RESULT = "file bigint, total_pages bigint, seen_pages bigint, pages string, total_detections bigint, status string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# the engine's own worker in the driver reads the processor without the files that sessions add
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Files(StatefulProcessor):
    """Pages of a file until it is complete; a page that comes again replaces itself."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page bigint", "detections bigint")
        self.about = handle.getValueState("about", "total_pages bigint, seen bigint, timer bigint")

    def result(self, key: tuple, status: str, state: tuple | None, more: dict[int, int], total: int | None) -> pd.DataFrame:
        """The file's row, of what is kept and of ``more``; its state and timer go."""
        found = {}
        if state is not None:
            found = {int(k[0]): int(v[0]) for k, v in self.pages.iterator()}
            self.forgotten(state)
        found |= more
        hits = ",".join(str(p) for p in sorted(found) if found[p] > 0)
        return pd.DataFrame([(key[0], total, len(found), hits, sum(found.values()), status)], columns=["file", "total_pages", "seen_pages", "pages", "total_detections", "status"])

    def forgotten(self, state: tuple) -> None:
        self.pages.clear()
        self.about.clear()
        if state[2]:
            self.handle.deleteTimer(state[2])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Each call on the state goes to the engine and back: a file that is new asks for no page, one that ends keeps none."""
        state = self.about.get()
        total, seen, timer = state if state is not None else (None, 0, None)
        last, closed, more = None, False, {}
        for batch in rows:
            for page, n, of, ts in zip(*(batch[c].tolist() for c in ("page", "detections", "total_pages", "ts")), strict=True):
                if of == of and of is not None:
                    total = int(of) if total is None else max(total, int(of))
                if page != page or page is None:
                    closed = True
                    continue
                more[int(page)] = 0 if n != n or n is None else int(n)
                if ts == ts and ts is not None and (last is None or ts > last):
                    last = ts
        had = seen > 0
        seen += len(more) if not had else sum(not self.pages.containsKey((page,)) for page in more)
        any_page = had or bool(more)
        if total is not None and any_page and seen >= total:
            yield self.result(key, "success", state, more, total)
        elif closed and any_page:
            yield self.result(key, "incomplete", state, more, total)
        elif closed:
            if state is not None:
                self.forgotten(state)
        else:
            for page, n in more.items():
                self.pages.updateValue((page,), (n,))
            until = timer if last is None else int(last.timestamp() * 1000) + self.patience_ms
            if until != timer:
                if timer:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(until)
            self.about.update((total, seen, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.about.get()
        if state is not None:
            yield self.result(key, "incomplete", (*state[:2], None), {}, state[0])

    def close(self) -> None:
        pass


def completed_files(pages: DataFrame, patience_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Rows of ``RESULT`` of a stream of pages (``PAGES``), one for each file that is complete, closed or given up.

    Pages older than the watermark are dropped by the engine. A file whose later pages come after
    it was given up begins anew.
    """
    pages.sparkSession.conf.set(STORE, ROCKS)
    return pages.withWatermark("ts", late).groupBy("file").transformWithStateInPandas(Files(patience_ms), RESULT, "Append", "EventTime")
