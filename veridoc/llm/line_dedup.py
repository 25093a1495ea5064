"""Line deduplication on levelled sorted runs of line hashes.

A run is a table of (h, n), bucketed and sorted by the 128-bit hash of a line's key: in how many documents of some batches
the line occurs.  A new batch is counted, merge-anti-joined with the lines that the runs have settled (held by
``settled_at`` documents), and what is left becomes a run of level 0.  Two runs of a level are merged into one of the next,
so a line is rewritten once a level.  All runs share one bucketing: anti joins with them shuffle the new batch only, and
merges, full outer joins of two runs, shuffle nothing.  A run is named by the batches it covers and a reader ignores runs that a
larger one covers, so a batch added again, or a merge that was broken off, changes nothing.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case.

Defined cases: a null or empty text is one empty line; empty keys are never dropped; a line repeated in a document counts
once for it, but all its copies are dropped; repeated rows are documents of their own; a text whose lines all go becomes
empty; a very long text is split whole; an empty table gives an empty result; other columns are passed on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import HEAVY_SHARE, every, fresh, join_groups, shared_dir, text_of, write_table
from .tokens import blocks

MIN_DOCS = 10
BATCHES = 4
BLANKS = " \t\n\x0b\x0c\r"
LINES = "doc binary, h binary, places array<int>, batch int"
RUN = re.compile(r"run_(\d+)_(\d+)_(\d+)")


class LineRuns:
    """The runs of one collection, as tables of a database in the shared folder."""

    def __init__(self, spark: SparkSession, settled_at: int = MIN_DOCS, name: str | None = None, buckets: int | None = None):
        self.spark, self.settled_at = spark, settled_at
        self.name = name or f"lines_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.name} LOCATION '{shared_dir(spark)}/{self.name}'")

    def runs(self) -> list[tuple[int, int, int]]:
        """(level, first batch, last batch) of the runs that no larger run covers."""
        tables = self.spark.sql(f"SHOW TABLES IN {self.name}").collect()  # a table for each run
        found = [tuple(map(int, m.groups())) for t in tables if (m := RUN.fullmatch(t["tableName"]))]
        return sorted(r for r in found if not any(o[1] <= r[1] and r[2] <= o[2] and o[0] > r[0] for o in found))

    def _table(self, run: tuple[int, int, int]) -> str:
        return f"{self.name}.run_{run[0]}_{run[1]}_{run[2]}"

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        rows.write.bucketBy(self.buckets, "h").sortBy("h").saveAsTable(self._table(run), format="parquet")

    def add(self, lines: DataFrame, batch: int) -> None:
        """Take in a batch: rows (h), one for each line and document that holds it.  Batches are numbered from 0 on."""
        runs = self.runs()
        if any(first <= batch <= last for _, first, last in runs):
            return
        rows = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        for run in runs:
            rows = rows.join(self._settled_in(run), "h", "left_anti")
        self._write(rows, (0, batch, batch))
        self._compact()

    def _settled_in(self, run: tuple[int, int, int]) -> DataFrame:
        return self._rows(run).filter(F.col("n") >= self.settled_at).select("h")

    def _compact(self) -> None:
        level = 0
        while len(own := [r for r in self.runs() if r[0] == level]) > 1:
            self._write(self._merged(*map(self._rows, own[:2])), (level + 1, own[0][1], own[1][2]))
            for run in own[:2]:
                self.spark.sql(f"DROP TABLE {self._table(run)}")
            level += 1

    def _rows(self, run: tuple[int, int, int]) -> DataFrame:
        return self.spark.table(self._table(run))

    def _merged(self, one: DataFrame, two: DataFrame) -> DataFrame:
        """Both runs as one.  (A union would not do: Spark may drop the bucketing of its inputs after relying on it.)"""
        return one.join(two.withColumnRenamed("n", "more"), "h", "full_outer").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

    def settled(self) -> DataFrame:
        """Hashes of the lines that ``settled_at`` documents hold."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h binary")
        return reduce(self._merged, map(self._rows, runs)).filter(F.col("n") >= self.settled_at).select("h")

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")


def keys_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes | None], np.ndarray]:
    """(lines of each text, hash of each distinct key or None for the empty one, key number of each line)."""
    import xxhash

    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    coded = pc.ascii_lower(pc.ascii_trim(split.flatten(), BLANKS)).dictionary_encode()
    hashed = [xxhash.xxh3_128_digest(k) if k else None for k in coded.dictionary.to_pylist()]
    return pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64), hashed, coded.indices.to_numpy()


def _doc_key(doc_id: Column, text: Column) -> Column:
    """16 bytes of a row's id and text: the same whenever a lost task is run again."""
    return F.substring(F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary"), F.lit("\n").cast("binary"), text.cast("binary")), 256)), 1, 16)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc, h, places, batch): a row for each document and line key in it, with the places of its lines."""

    def lines(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            doc = batch.column(0)
            for a, b in blocks(batch.column(1)):
                n_lines, hashed, key = keys_of(batch.column(1)[a:b])
                own = np.repeat(np.arange(b - a), n_lines)
                place = np.arange(len(key)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
                some = np.array([h is not None for h in hashed], bool)[key] if len(hashed) else np.zeros(0, bool)
                own, place, key = own[some], place[some], key[some]
                order = np.lexsort((place, key, own))
                own, place, key = own[order], place[order], key[order]
                new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])))[: len(own)]
                edges = pa.array(np.append(new, len(own)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [doc[a:b].take(pa.array(own[new])), pa.array(hashed, pa.binary()).take(pa.array(key[new])),
                     pa.ListArray.from_arrays(edges, pa.array(place.astype(np.int32))), batch.column(2)[a:b].take(pa.array(own[new]))],
                    names=["doc", "h", "places", "batch"],
                )

    text = text_of(text_col)
    keyed = docs.select(_doc_key(F.col(id_col), text).alias("doc"), text.alias("text"))
    return keyed.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")).select("doc", "text", "batch").mapInArrow(lines, LINES)


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))
def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Each text without the lines at the given places."""
    kept, counts = [], []
    for text, places in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        lines = text.split("\n")
        if places:
            drop = set(places)
            text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
        kept.append(text)
        counts.append((len(lines), len(set(places or ()))))
    total, dropped = zip(*counts, strict=True) if counts else ((), ())
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])


def drop_lines(docs: DataFrame, lines: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "lines") -> DataFrame:
    """``docs`` and a struct ``out`` (text, n_lines, n_dropped): the text without the lines whose hash is in ``keys`` (h).

    Only rows with such a line leave the line table; the hottest of them, at most HEAVY_SHARE, meet their rows by broadcast.
    """
    total = lines.count()
    heavy = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HEAVY_SHARE > F.lit(total))
    sized = write_table(keys.select("h").join(F.broadcast(heavy), "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n")), "line-keys")
    hits = join_groups(lines.select("doc", "h", "places"), sized, "h", "n", total)
    key, places = fresh([*docs.columns, out], "doc_key", "gone")
    gone = hits.groupBy(F.col("doc").alias(key)).agg(F.flatten(F.collect_list("places")).alias(places))
    text = text_of(F.col(text_col))
    rows = docs.select(*every(docs), _doc_key(F.col(id_col), text).alias(key)).join(gone, key, "left")
    return rows.select(*every(docs), without(text, F.col(places)).alias(out))


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text",
                        out: str = "lines", batches: int = BATCHES) -> DataFrame:
    """``docs`` and a struct ``out`` (text, n_lines, n_dropped): without the lines that ``min_docs`` documents hold.

    The line hashes are written once, dealt into batches, which are added to the runs one after the other.
    """
    spark = docs.sparkSession
    lines = line_table(docs, id_col, text_col, batches)
    path = f"{shared_dir(spark)}/line-hashes-{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch).select("h"), batch)
    keys = write_table(runs.settled(), "frequent-lines")
    runs.drop()
    return drop_lines(docs, lines, keys, id_col, text_col, out)


def drop_seen_lines(docs: DataFrame, runs: LineRuns, batch: int, id_col: str = "doc_id", text_col: str = "text", out: str = "lines") -> DataFrame:
    """A new batch without the lines that earlier batches settled; afterwards its own lines are in the runs."""
    lines = write_table(line_table(docs, id_col, text_col, 1), "line-hashes")
    seen = write_table(runs.settled(), "seen-lines")
    runs.add(lines.select("h"), batch)
    return drop_lines(docs, lines, seen, id_col, text_col, out)
