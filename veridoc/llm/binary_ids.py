"""Token ids as files in a Simple-8b word-aligned format.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector says how many values of which width follow
(:data:`SELECTORS`).  Selector 0 is the escape: its payload indexes a literal area of full 64-bit values, so any value
can be stored.  A segment (one row of the Parquet container) holds whole documents in order: their ids and lengths, the
words, the literals, and for every block of BLOCK ids the offset of its first word, so blocks decode independently and
without a loop over values.  Segments close at SEGMENT_IDS ids; a longer document has one to itself.

Defined cases: null and empty texts give the end id alone; repeated ids keep one entry per row, in the order of their
text hashes; an empty table gives no segment; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table
from .tokens import END_ID, blocks, encoder

#: Fixed values of the format: selector -> (values in a word, bits of each).
SELECTORS = {
    1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7),
    8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60),
}
ESCAPE = 0
BLOCK = 4096
SEGMENT_IDS = 1 << 18
SEGMENTS = (
    "shard int, shard_start long, doc_ids array<long>, doc_lengths array<long>, n_ids long,"
    " block_words array<int>, words binary, literals binary"
)
ARROW_SEGMENTS = pa.schema(
    [("shard", pa.int32()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("doc_lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("block_words", pa.list_(pa.int32())),
     ("words", pa.binary()), ("literals", pa.binary())]
)


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, literals) of unsigned values; no word spans two blocks."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    left = BLOCK - np.arange(n) % BLOCK
    left[n - n % BLOCK :] = n % BLOCK - np.arange(n % BLOCK)
    best = np.zeros(n, np.uint8)  # selector that packs most values from each position on; ESCAPE until one fits
    for s in sorted(SELECTORS, reverse=True):
        count, bits = SELECTORS[s]
        fits = np.flatnonzero(v < np.uint64(1 << bits))  # a run of ``count`` of them starts where the sorted places agree
        if len(fits) < count:
            break
        first = fits[: len(fits) - count + 1]
        first = first[fits[count - 1 :] - first == count - 1]
        best[first[left[first] >= count]] = s
    step = np.array([1] + [SELECTORS[s][0] for s in range(1, 15)])[best].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.asarray(at, np.int64)
    chosen = best[at] if n else best
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        count, bits = SELECTORS[int(s)]
        for k in range(count):
            words[mine] |= v[at[mine] + k] << np.uint64(k * bits)
    firsts = np.searchsorted(at, np.arange(0, n, BLOCK)) if n else np.zeros(0, np.int64)
    return words, firsts, v[at[chosen == ESCAPE]] if n else v


def decode_words(words: np.ndarray, literals: np.ndarray, n: int) -> np.ndarray:
    """The n values of a run of words, as unsigned 64-bit integers."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1] + [SELECTORS[s][0] for s in range(1, 15)])[chosen]
    start = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[start[mine]] = literals[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        count, bits = SELECTORS[int(s)]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[start[mine] + k] = words[mine] >> np.uint64(k * bits) & mask
    return out


def decode_block(words: np.ndarray, firsts: np.ndarray, literals: np.ndarray, n: int, block: int) -> np.ndarray:
    """Random access: the values of one block of a segment of n values."""
    end = firsts[block + 1] if block + 1 < len(firsts) else len(words)
    return decode_words(words[firsts[block] : end], literals, min(BLOCK, n - block * BLOCK))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
              partitions: int | None = None) -> DataFrame:
    """Encode every text and write the segments in ascending id order; returns them read back, undecoded."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done, shard = encoder(tokenizer), 0, None
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        sizes: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal done, held, ids, sizes
            flat = np.concatenate(held)
            words, firsts, literals = encode_words(flat)
            row = {
                "shard": shard, "shard_start": done, "doc_ids": ids, "doc_lengths": sizes, "n_ids": len(flat),
                "block_words": firsts.tolist(), "words": words.astype("<u8").tobytes(),
                "literals": literals.astype("<u8").tobytes(),
            }
            done, held, ids, sizes = done + len(flat), [], [], []
            return pa.RecordBatch.from_pylist([row], schema=ARROW_SEGMENTS)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            own, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in blocks(texts, 4_000_000):
                flat, lengths = enc.encode(texts[a:b], end_id)
                held.append(flat)
                ids += own[a:b]
                sizes += lengths.tolist()
                if sum(map(len, held)) >= SEGMENT_IDS:
                    yield close()
        if ids:
            yield close()

    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col)
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
        .repartitionByRange(parts, F.col("doc_id").asc(), F.col("tie").asc())
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("shard"))
    )
    return write_table(ordered.mapInArrow(segments, SEGMENTS), "simple8b")


def read_ids(segments: DataFrame) -> DataFrame:
    """Decode segments: one row per document with doc_id, start (ids of all documents before it) and binary ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = decode_words(
                    np.frombuffer(row["words"], "<u8"), np.frombuffer(row["literals"], "<u8"), row["n_ids"]
                )
                lengths = np.asarray(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = flat.astype("<u4")
                base = row["base"] + row["shard_start"]
                edges = 4 * np.concatenate([[0], ends]).astype(np.int64)
                data = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(raw)])
                view = memoryview(raw).cast("B")
                crc = [zlib.crc32(view[x:y]) for x, y in pairwise(edges.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(base + ends - lengths), pa.array(lengths),
                     pa.array(crc, pa.int64()), data.cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per shard
    return segments.join(F.broadcast(bases), "shard").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
