"""Events of a stream: runs of flags that are closed across chunks, by rows or by time.

A processor with state holds each key's open event. A flag begins or lengthens it,
more than ``gap`` rows without one end it, and a timer ends it when the
watermark has passed its last row by ``silence``, so that the last event of a key that
says no more comes out too. However a stream is cut into chunks, and wherever it
is stopped and started again, the events are those of ``segments.events`` over all
rows, if rows of a key come in order.

``append_once`` writes each batch under its number: a batch that is run again
replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "first long, last long, n long, quiet long, at_ms long"


class EventCloser(StatefulProcessor):
    """key, first, last, n of each event of at least ``least`` rows."""

    def __init__(self, key: str, order: str, flag: str, ts: str, least: int, gap: int, silence_ms: int):
        self.names = (key, order, flag, ts)
        self.least, self.gap, self.silence_ms = least, gap, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _closed(self, key: tuple, events: list[tuple]) -> Iterator[pd.DataFrame]:
        kept = [e for e in events if e[2] >= self.least]
        if kept:
            yield pd.DataFrame([(key[0], *e[:3]) for e in kept], columns=[self.names[0], "first", "last", "n"])

    def _timed(self, at_ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at_ms is not None:
            self.handle.registerTimer(at_ms + self.silence_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  as pyspark names them
        _, order, flag, ts = self.names
        frame = pd.concat(list(rows)).sort_values(order)
        found = self.open.get() if self.open.exists() else None
        event = list(found) if found else None
        ended = []
        times = pd.to_datetime(frame[ts]).dt.tz_localize(None).astype("datetime64[ms]").astype("int64")
        for at, is_set, ms in zip(frame[order], frame[flag], times):
            if is_set:
                event = [int(at), int(at), 1, 0, int(ms)] if event is None else [event[0], int(at), event[2] + event[3] + 1, 0, int(ms)]
            elif event is not None:
                event[3], event[4] = event[3] + 1, int(ms)
                if event[3] > self.gap:
                    ended.append(tuple(event))
                    event = None
        if event is None:
            self.open.clear()
            self._timed(None)
        else:
            self.open.update(tuple(event))
            self._timed(event[4])
        yield from self._closed(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        event = self.open.get() if self.open.exists() else None
        self.open.clear()
        yield from self._closed(key, [tuple(event)] if event else [])

    def close(self) -> None:
        pass


def closed_events(rows: DataFrame, key: str, order: str, flag: str, ts: str, *, least: int, gap: int, silence: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Events of a stream of flagged rows, each when it has ended. Needs the RocksDB state store (``with_rocksdb``)."""
    seconds = int(pd.Timedelta(silence).total_seconds())
    kind = dict(rows.dtypes)[key]
    plain = rows.select(F.col(key), F.col(order).cast("long").alias(order), F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).alias(flag), F.col(ts)).withWatermark(ts, late)
    closer = EventCloser(key, order, flag, ts, least, gap, seconds * 1000)
    return plain.groupBy(key).transformWithStateInPandas(closer, f"{key} {kind}, first long, last long, n long", "append", "eventTime")


def with_rocksdb(spark: SparkSession) -> None:
    """State with timers lives in the state store that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: batch n goes to ``path``/batch=n, in the place of what a failed run of it left there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``append_once`` wrote."""
    return spark.read.parquet(path).drop("batch")
