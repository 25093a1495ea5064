"""Stateful stream operators: running budgets, cached requests, incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veridoc.operators.index_store import IndexStore


def daily_budget(calls: DataFrame, max_cost: float, late: str = "1 day") -> DataFrame:
    """Each call (event_id, ts, cost) with the day's spending before it and whether it is refused.

    State is one number a day, dropped once the watermark has passed the day.
    """

    def spend(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent = state.get[0] if state.exists else 0.0
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "event_id"])
            rows = []
            for event, cost in zip(pdf["event_id"], pdf["cost"].fillna(0.0), strict=True):
                refused = 0 < max_cost <= spent
                rows.append((key[0], event, spent, refused))
                spent += 0.0 if refused else cost
            yield pd.DataFrame(rows, columns=["day", "event_id", "spent_before", "refused"])
        state.update((spent,))
        ends = pd.Timestamp(key[0]).value // 10**6 + 86_400_000
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)

    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.withColumn("day", F.to_date("ts").cast("string")).groupBy("day").applyInPandasWithState(
        spend, "day string, event_id long, spent_before double, refused boolean", "spent double", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def cache_misses(requests: DataFrame, key: str = "key", ttl: str = "1 hour") -> DataFrame:
    """First request of each key within the lifetime of its entry; repeats are hits."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl)
    return timed.dropDuplicatesWithinWatermark([key])


def ingest_stream(snapshots: DataFrame, path: str, key: str, checkpoint: str):
    """Keep a corpus up to date from a stream of snapshots (key, fetched_at, ...), the newest of a key counting.

    Each batch adds one run to the :class:`~veridoc.operators.index_store.IndexStore` below ``path``: it writes its own documents
    and, once in a while, a merge of runs, never the whole corpus.  A rerun batch changes nothing.  Returns the started query.
    """

    def take(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (key, "fetched_at")]
        latest = batch.groupBy(key).agg(F.max(F.struct("fetched_at", *rest)).alias("s")).select(key, "s.*").select(*batch.columns)
        store = IndexStore(batch.sparkSession, path, key)
        older = store.read().select(key, F.col("fetched_at").alias("_at")) if store.runs() else None
        if older is not None:  # a snapshot older than what is stored is left aside
            latest = latest.join(older, key, "left").filter(F.col("_at").isNull() | (F.col("fetched_at") >= F.col("_at"))).drop("_at")
        store.apply(latest, latest.select(key), number)

    return snapshots.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()


def split_late(events: DataFrame, delay: str, batch: str = "batch", ts: str = "ts") -> DataFrame:
    """Rows with ``late``: older than the newest time of all earlier batches by more than ``delay``.

    A table of one row per batch carries the newest time forward; the rows themselves only meet it in a join.
    """
    newest = events.groupBy(batch).agg(F.max(ts).alias("_newest"))
    before = F.max("_newest").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    marks = newest.select(batch, (before - F.expr(f"INTERVAL {delay}")).alias("_mark"))
    joined = events.join(marks, batch, "left")
    return joined.withColumn("late", F.coalesce(F.col(ts) < F.col("_mark"), F.lit(False))).drop("_mark")


def late_rows_aside(events: DataFrame, path: str, delay: str, checkpoint: str, ts: str = "ts"):
    """Write a stream's rows below ``path``: on time to ``late=false``, those ``delay`` behind earlier batches to ``late=true``.

    Each batch overwrites its own folder, so a rerun batch repeats itself; it reads the newest time so far from the one-row table
    of the batch before.  Returns the started query.
    """

    def put(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        mark = spark.read.parquet(f"{path}/marks/b={number - 1}").first()["newest"] if number else None
        limit = F.lit(mark) - F.expr(f"INTERVAL {delay}") if mark is not None else F.lit(None).cast("timestamp")
        flagged = rows.withColumn("late", F.coalesce(F.col(ts) < limit, F.lit(False)))
        flagged.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/b={number}")
        newest = rows.agg(F.greatest(F.max(F.col(ts).cast("timestamp")), F.lit(mark).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/marks/b={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
