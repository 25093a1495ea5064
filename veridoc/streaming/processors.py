"""Stateful streams with typed state, timers and expiry: a day's budget and the entries of a request cache.

Both need the RocksDB state store (:func:`use_rocksdb`).  Rows of a key are taken in order of time and id within a batch;
a row behind the watermark is not seen.  State goes when its timer fires: a day's when the watermark has passed the day, a
cache entry's when it has outlived ``ttl``.  A restart from the checkpoint goes on with the state as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NANO = 10**9


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"])


def _ms(at: pd.Timestamp) -> int:
    return at.value // 10**6


class Budget(StatefulProcessor):
    """State of a day: calls made, their cost in nano-units, whether a call was refused."""

    def __init__(self, max_calls: int, max_cost: float):
        self.max_calls, self.max_cost = max_calls, round(max_cost * NANO)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "calls long, nano long, full boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls, nano, full = self.day.get() if self.day.exists() else (0, 0, False)
        out = []
        for event, made, cost in _ordered(rows)[["event_id", "api_call", "cost"]].itertuples(index=False):
            full = full or bool(made) and (0 < self.max_calls <= calls or 0 < self.max_cost <= nano)
            out.append((event, calls, nano / NANO, bool(made) and full))
            if made and not full:
                calls, nano = calls + 1, nano + (0 if pd.isna(cost) else round(cost * NANO))
        self.day.update((calls, nano, full))
        self.handle.registerTimer(_ms(pd.Timestamp(key[0])) + 86_400_000)
        yield pd.DataFrame(out, columns=["event_id", "made", "spent", "refused"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.day.clear()
        yield pd.DataFrame({"event_id": [], "made": [], "spent": [], "refused": []})

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """State of a key: when its entry was stored, how often it was hit and when last."""

    def __init__(self, ttl_seconds: int):
        self.ttl = pd.Timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "stored timestamp, hits long, last_hit timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored, hits, last = self.entry.get() if self.entry.exists() else (None, 0, None)
        out = []
        for event, at in _ordered(rows)[["event_id", "ts"]].itertuples(index=False):
            hit = stored is not None and pd.Timestamp(stored) <= at < pd.Timestamp(stored) + self.ttl
            stored, hits, last = (stored, hits + 1, at) if hit else (at, hits, last)
            out.append((event, hit, hits, last))
        plain = lambda t: None if t is None else pd.Timestamp(t).to_pydatetime()
        self.entry.update((plain(stored), hits, plain(last)))
        self.handle.registerTimer(_ms(pd.Timestamp(stored) + self.ttl))
        frame = pd.DataFrame(out, columns=["event_id", "hit", "hits", "last_hit"])
        yield frame.assign(last_hit=pd.to_datetime(frame["last_hit"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.entry.exists() and _ms(pd.Timestamp(self.entry.get()[0]) + self.ttl) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame({"event_id": [], "hit": [], "hits": [], "last_hit": pd.to_datetime([])})

    def close(self) -> None:
        pass


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def budget_stream(calls: DataFrame, max_calls: int = 0, max_cost: float = 0.0, late: str = "1 day") -> DataFrame:
    """Each call (event_id, ts, api_call, cost) with the calls and cost made before it that day, and whether it is refused.

    The rule is that of ``usage.budget_gate``: from the first refusal of a day on all its calls are refused; 0 is no limit.
    """
    timed = _timed(calls.select("event_id", "ts", "api_call", "cost"), late)
    days = timed.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("day")
    return days.transformWithStateInPandas(Budget(max_calls, max_cost), "event_id long, made long, spent double, refused boolean", "Append", "EventTime")


def cache_stream(requests: DataFrame, ttl_seconds: int, key: str = "key", late: str = "1 day") -> DataFrame:
    """Each request (event_id, ts, key) with whether it hits an entry younger than the lifetime, and the entry's hits and last hit.

    A miss stores the entry anew; its hits are kept while it lives.
    """
    timed = _timed(requests.select("event_id", "ts", F.col(key).alias("key")), late)
    return timed.groupBy("key").transformWithStateInPandas(Cache(ttl_seconds), "event_id long, hit boolean, hits long, last_hit timestamp", "Append", "EventTime")
