"""Helpers shared by the training-data operators: shared-folder tables and skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is heavy when it holds more than 1/HEAVY_SHARE of all rows, so at most HEAVY_SHARE groups are heavy.
HEAVY_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in ``spark.checkpoint.dir``.

    Only where that setting is absent on a single machine, as in tests, a temporary folder is used; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: this cuts the lineage durably."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """:func:`write_table` as a table in buckets of ``key``, so that grouping by it later needs no shuffle."""
    spark = df.sparkSession
    database = f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_dir(spark)}/{database}'")
    df.write.bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}", format="parquet")
    return spark.table(f"{database}.{name}")


def pack(*arrays: np.ndarray) -> bytes:
    """Columns, split into bytes by significance and compressed."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=n * sum(sizes)), np.uint8)
    ends = n * np.cumsum(sizes)
    return [np.ascontiguousarray(raw[e - n * s : e].reshape(s, n).T).view(k).ravel() for k, s, e in zip(kinds, sizes, ends, strict=True)]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, Arrow batches hold at most ``rows`` rows: for jobs run there whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each changed until no column has it (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def every(df: DataFrame | list[str]) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df if isinstance(df, list) else df.columns)]


def text_of(column: str | Column) -> Column:
    """The text, with null counting as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to one-row-per-key ``groups`` that no hot key can slow down.

    Keys whose ``size`` exceeds ``total / HEAVY_SHARE`` number at most HEAVY_SHARE (times the keys a row has) and are
    broadcast; the rest, of bounded group size, are joined by a shuffle.
    """
    extra = [c for c in groups.columns if c != key]
    heavy = groups.filter(F.col(size) * HEAVY_SHARE > F.lit(total))
    cold = groups.filter(F.col(size) * HEAVY_SHARE <= F.lit(total))
    mark = "_heavy_hit"
    tried = rows.join(F.broadcast(heavy.withColumn(mark, F.lit(True))), key, "left")
    hot_rows = tried.filter(F.col(mark)).drop(mark)
    rest = tried.filter(F.col(mark).isNull()).drop(mark, *extra)
    return hot_rows.unionByName(rest.join(cold, key))
