"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces of binary length: as many pieces of the largest length as fit, then the binary
digits of the remainder in descending order.  Each piece is a sequence of its own, in the bucket of its length, so no
sequence crosses documents and none needs padding.  Sequences are numbered bucket by bucket, longest first, from counts
per (task, bucket): nothing but those few counts is gathered.

Defined cases: null and empty texts give the end id alone (one piece of length 1); repeated rows and ids each give their
own pieces; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table
from .tokens import END_ID, blocks, encoder

MAX_TOKENS = 4096
PIECES = "doc_id long, start long, length long, doc_tokens long, shard int, place long, ids_crc32 long, ids binary"
BLOCK_BYTES = 4_000_000


def cuts(lengths: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents with so many ids each, longest first in each."""
    bits = [1 << k for k in range(largest.bit_length() - 2, -1, -1)]
    # Per document the largest pieces, then one column for each lower power of two.
    whole = lengths // largest
    doc = np.concatenate([np.repeat(np.arange(len(lengths)), whole), *(np.flatnonzero(lengths & m) for m in bits)])
    size = np.repeat([largest, *bits], [int(whole.sum()), *(int((lengths & m > 0).sum()) for m in bits)])
    order = np.argsort(doc, kind="stable")
    doc, size = doc[order], size[order]
    ends = np.cumsum(size)
    first = np.cumsum(lengths) - lengths
    return doc, ends - size - first[doc], size


def packed_pieces(docs: DataFrame, tokenizer: str, largest: int = MAX_TOKENS, end_id: int = END_ID,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences, written to the shared folder: ids as little-endian unsigned 32-bit binary, with their bucket
    (``length``), sequence_id, origin (doc_id, start) and unsigned CRC-32."""
    if largest < 1 or largest & (largest - 1):
        raise ValueError("largest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, used = encoder(tokenizer), Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            ids, texts = batch.column(0), batch.column(1)
            for a, b in blocks(texts, BLOCK_BYTES):
                flat, lengths = enc.encode(texts[a:b], end_id)
                doc, start, size = cuts(lengths, largest)
                place = np.empty(len(size), np.int64)
                for m in np.unique(size).tolist():
                    mine = size == m
                    place[mine] = used[m] + np.arange(mine.sum())
                    used[m] += int(mine.sum())
                raw = flat.astype("<u4")
                ends = np.concatenate([[0], np.cumsum(4 * size)])
                data = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                view = memoryview(raw).cast("B")
                crc = [zlib.crc32(view[x:y]) for x, y in pairwise(ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b].take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(lengths[doc]),
                     pa.array(np.full(len(size), shard, np.int32)), pa.array(place), pa.array(crc, pa.int64()), data.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "shard", "place", "ids_crc32", "ids"],
                )

    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("shard")
    )
    table = write_table(source.mapInArrow(pieces, PIECES), "packed", "zstd")
    used = table.groupBy("length", "shard").agg((F.max("place") + 1).alias("n"))
    order = Window.orderBy(F.col("length").desc(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = used.select("length", "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    # One row per task and power of two: thousands of times fewer than the pieces.
    return table.join(F.broadcast(bases), ["length", "shard"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "ids_crc32", "ids",
    )
