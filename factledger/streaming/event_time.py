"""Streams on event time and on the clock: capture of rows in any order, and sources that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factledger.functions.claims import canonical

ERAS = StructType([StructField("key", StringType()), StructField("value_json", StringType()), StructField("boundary", LongType()), StructField("prior_ms", LongType()), StructField("kind", StringType())])
STATUS = StructType([StructField("source", StringType()), StructField("status", StringType()), StructField("at_ms", LongType())])
_HELD = StructType([StructField("claim", StringType()), StructField("seen_ms", LongType())])
_PLACE, _SAID = StructType([StructField("boundary", LongType()), StructField("id", LongType())]), StructType([StructField("value_json", StringType()), StructField("claim", StringType())])


class _InOrder(StatefulProcessor):
    """Rows wait in a map, by (boundary, id), until the watermark has passed them; then they are folded in that order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.waiting = handle.getValueState("held", _HELD), handle.getMapState("waiting", _PLACE, _SAID)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        late = []
        for pdf in rows:
            for t, i, v, c in zip(pdf["boundary"].tolist(), pdf["id"].tolist(), pdf["value_json"].tolist(), pdf["claim"].tolist()):
                if t <= passed:
                    late.append((key[0], v, t, None, "late"))
                else:
                    self.waiting.updateValue((t, i), (v, c))
                    self.handle.registerTimer(t)
        if late:
            yield _eras(late)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        ready = sorted((tuple(place), tuple(said)) for place, said in self.waiting.iterator() if place[0] <= passed)
        claim, seen = self.held.get() if self.held.exists() else (None, None)
        out = []
        for (t, i), (value, c) in ready:
            if seen is None or c != claim:
                out.append((key[0], value, t, seen, "observed" if seen is not None else "asserted"))
            claim, seen = c, t
            self.waiting.removeKey((t, i))
        if ready:
            self.held.update((claim, seen))
        if out:
            yield _eras(out)

    def close(self) -> None:
        pass


def _eras(rows: list[tuple]) -> pd.DataFrame:
    whole = lambda i: pd.array([pd.NA if r[i] is None else r[i] for r in rows], dtype="Int64")
    text = lambda i: pd.Series([r[i] for r in rows], dtype=object)
    return pd.DataFrame({"key": text(0), "value_json": text(1), "boundary": whole(2), "prior_ms": whole(3), "kind": text(4)})


def capture_in_any_order(stream: DataFrame, delay: str) -> DataFrame:
    """stream(key, value_json, boundary, id), boundary in epoch ms -> an era for each change of a key's claim, whatever the order in which rows
    arrive, so long as none comes more than `delay` behind the newest: a row waits in the key's state until the watermark has passed it. State
    holds one claim a key and the rows of the last `delay`. A row behind the watermark is given out as it is, of kind `late`: it says
    what held from its boundary, and its consumer records it as a correction of a past that is closed. Needs the RocksDB state store."""
    at = F.timestamp_millis("boundary")
    # the time column itself goes before the state, since Spark would drop the rows behind the watermark with it
    rows = stream.withColumn("_at", at).withWatermark("_at", delay).select("key", "value_json", "boundary", F.col("id").cast("long").alias("id"), canonical(F.col("value_json")).alias("claim"))
    return rows.groupBy("key").transformWithStateInPandas(_InOrder(), ERAS, "Append", "EventTime")


class _Silence(StatefulProcessor):
    """When each source last tried, with a timer on the clock; a new attempt moves it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("due_ms", LongType()), StructField("silent", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        due, silent = self.last.get() if self.last.exists() else (None, 1)
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(now + self.idle_ms)
        self.last.update((now + self.idle_ms, 0))
        if silent:
            yield _turn(key[0], "heard", now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.last.update((due, 1))
        yield _turn(key[0], "silent", due)

    def close(self) -> None:
        pass


def _turn(source: str, status: str, at: int) -> pd.DataFrame:
    return pd.DataFrame({"source": pd.Series([source], dtype=object), "status": pd.Series([status], dtype=object), "at_ms": [at]})


def watch_silence(polls: DataFrame, idle_ms: int) -> DataFrame:
    """polls(source, ...) -> a row whenever a source's state turns: `heard` at its first poll and at the first after a silence, `silent` when
    idle_ms have gone by on the clock without one. Found by a timer, so no poll is needed to notice that there is none. One row of
    state a source."""
    return polls.select("source").groupBy("source").transformWithStateInPandas(_Silence(idle_ms), STATUS, "Update", "ProcessingTime")


def run_with_state(stream: DataFrame, checkpoint: str):
    """A writer for streams with this state; the caller sets sink and trigger."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.writeStream.option("checkpointLocation", checkpoint)
