"""Stateful operators of streams: batches of requests that wait for each other, and entries that end when they are not used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = 10_000  # rows that go out at once


def _rows(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """What a micro-batch has of one key; its parts are in no order."""
    return pd.concat(list(parts), ignore_index=True)


class Coalescer(StatefulProcessor):
    """Holds a log's requests until there are `size` of them or the first has waited for `wait` seconds; then they are a batch.

    State: the open batch's requests (a list), its number and when it began. A timer ends a batch that nothing fills; a
    request that comes later than that, in the same micro-batch, ends it too.
    """

    def __init__(self, key: str, request: str, arrived: str, size: int, wait: int):
        self.key, self.request, self.arrived, self.size, self.wait = key, request, arrived, size, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "request long, arrived long")
        self.open = handle.getValueState("open", "batch long, n int, began long")

    def _frame(self, key: tuple, requests: list[int], times: list[int], batches: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: key[0], self.request: requests, self.arrived: times, "batch": batches})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, n, began = self.open.get() if self.open.exists() else (0, 0, 0)
        before = (n, began)
        held = [tuple(r) for r in self.waiting.get()] if n else []
        come = _rows(rows).dropna(subset=[self.request, self.arrived]).astype({self.request: "int64", self.arrived: "int64"}).sort_values([self.arrived, self.request], kind="stable")
        done: tuple[list[int], list[int], list[int]] = ([], [], [])  # requests, times and batches that go out, many in a frame

        def ends() -> None:
            for out, values in zip(done, ([r for r, _ in held], [t for _, t in held], [number] * len(held)), strict=True):
                out.extend(values)

        for request, arrived in zip(come[self.request].tolist(), come[self.arrived].tolist(), strict=True):
            if held and arrived - held[0][1] >= self.wait:
                ends()
                number, held = number + 1, []
            held.append((request, arrived))
            if len(held) >= self.size:
                ends()
                number, held = number + 1, []
            if len(done[0]) >= FRAME:
                yield self._frame(key, *done)
                done = ([], [], [])
        if done[0]:
            yield self._frame(key, *done)
        if before[0]:
            self.handle.deleteTimer((before[1] + self.wait) * 1000)
        began = held[0][1] if held else 0
        self.open.update((number, len(held), began))
        if held:
            self.waiting.put(held)
            self.handle.registerTimer((began + self.wait) * 1000)
        elif before[0]:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, n, _ = self.open.get()
        if n:
            held = [tuple(r) for r in self.waiting.get()]
            yield self._frame(key, [r for r, _ in held], [t for _, t in held], [number] * n)
            self.waiting.clear()
            self.open.update((number + 1, 0, 0))

    def close(self) -> None:
        pass


class Expiring(StatefulProcessor):
    """Entries that are dropped when they have not been used for longer than `ttl` seconds: (key, entry, since, until, uses) of each as it goes."""

    def __init__(self, key: str, used: str, ttl: int):
        self.key, self.used, self.ttl = key, used, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "entry long, since long, until long, uses long")

    def _gone(self, key: tuple, e: tuple) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "entry": [e[0]], "since": [e[1]], "until": [e[2]], "uses": [e[3]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, since, until, uses = self.entry.get() if self.entry.exists() else (0, 0, 0, 0)
        if uses:
            self.handle.deleteTimer((until + self.ttl) * 1000 + 1)
        for t in sorted(_rows(rows)[self.used].dropna().astype("int64").tolist()):
            if uses and t - until > self.ttl:
                yield self._gone(key, (number, since, until, uses))
                number, uses = number + 1, 0
            since, until, uses = (since if uses else t), t, uses + 1
        self.entry.update((number, int(since), int(until), uses))
        if uses:
            self.handle.registerTimer((int(until) + self.ttl) * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, since, until, uses = self.entry.get()
        if uses:
            yield self._gone(key, (number, since, until, uses))
        self.entry.update((number + 1, 0, 0, 0))  # what is left of a key: how many entries it had

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, processor: StatefulProcessor, key: str, seconds: str, late: str, schema: str) -> DataFrame:
    timed = rows.withColumn("_at", F.timestamp_seconds(seconds)).withWatermark("_at", late)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def coalesced_batches(requests: DataFrame, key: str, request: str, arrived: str, size: int, wait: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, request, arrived, batch): requests of a log in batches of `size`, or of what came in `wait` seconds of the first. arrived: whole seconds after 1970. A request without its number or time is dropped, and one at or before the watermark is late."""
    return _stateful(requests, Coalescer(key, request, arrived, size, wait), key, arrived, late, f"`{key}` long, `{request}` long, `{arrived}` long, batch long")


def expired_entries(uses: DataFrame, key: str, used: str, ttl: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, entry, since, until, uses): entries as they end, when they were not used for more than `ttl` seconds."""
    return _stateful(uses, Expiring(key, used, ttl), key, used, late, f"`{key}` long, entry long, since long, until long, uses long")


def ended_entries(uses: DataFrame, key: str, used: str, ttl: int, late: str = "0 seconds") -> DataFrame:
    """The same as session windows, which also join where one just touches the next, without Python and without the entry's number: a stream of (key, since, until, uses). used: whole seconds after 1970; uses without one are dropped."""
    timed = uses.filter(F.col(used).isNotNull()).withColumn("_at", F.timestamp_seconds(used)).withWatermark("_at", late)
    each = timed.groupBy(key, F.session_window("_at", f"{ttl} seconds")).agg(F.min(used).alias("since"), F.max(used).alias("until"), F.count("*").alias("uses"))
    return each.select(key, "since", "until", "uses")


def numbered(entries: DataFrame, key: str) -> DataFrame:
    """A table of ended entries with their numbers from 0 on, by key."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("since")).cast("long") - 1
    return entries.select(key, number.alias("entry"), "since", "until", "uses")
