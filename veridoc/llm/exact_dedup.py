"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text once into a narrow table (id, row tag, SHA-256) and counts, for each cell of a Bloom filter
sized by the row count, how many rows set it; the cells set at least twice become a bitmap.  Pass two probes the bitmap:
a row one of whose cells was set only once has no equal and passes straight through; only the rest shuffle.
The filter has no false negatives, so the result is exact; a false positive costs one needlessly shuffled row.  More than
ROUND_ROWS rows take both passes in rounds, one for each range of hashes, so that a filter stays small enough to broadcast.

Defined cases: null text equals the empty text; of equal texts the row with the largest id stays (a null id is smaller
than any other; among rows with the same id and text one stays); a very long text is hashed like any other; an empty
table gives an empty result; extra columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import every, fresh, join_groups, new_path, text_of, write_table

BITS_PER_ROW = 16
BITMAP_BITS = 32768  # bits of one bitmap built by bitmap_construct_agg
ROUND_ROWS = 1 << 26  # rows of one round, whose filter of at most 128 MB is broadcast


def _filter_bits(rows: int) -> int:
    return max(BITMAP_BITS, 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length())


def _cells(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(bits)) for seed in (11, 29)]


def repeat_filter(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the cells that at least two rows set."""
    cells = digests.select(F.explode(F.array(*_cells(F.col(digest), bits))).alias("cell"))
    return (
        cells.groupBy("cell").count().filter("count > 1")
        .groupBy(F.expr(f"cell div {BITMAP_BITS}").alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg(cell % {BITMAP_BITS})").alias("bitmap"))
    )


def probe(df: DataFrame, digest: str, bitmaps: DataFrame, bits: int, out: str) -> DataFrame:
    """Add the boolean ``out``: whether the digest may be repeated.  The bitmaps hold ``bits`` bits: safe to broadcast."""
    names, hits = df.columns, []
    for k, cell in enumerate(_cells(F.col(digest), bits)):
        place, bucket, bitmap = fresh([*df.columns, out], f"cell{k}", f"bucket{k}", f"map{k}")
        side = bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
        df = df.withColumn(place, cell).join(F.broadcast(side), F.expr(f"{place} div {BITMAP_BITS}") == F.col(bucket), "left")
        byte = F.expr(f"cast(conv(hex(substring({bitmap}, cast({place} % {BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int)")
        bit = F.expr(f"cast({place} % 8 as int)")
        hits.append(F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    return df.select(*every(names), (hits[0] & hits[1]).alias(out))


def _rounds(rows: int) -> tuple[int, int]:
    """(rounds, bits of the filter of each)."""
    rounds = -(-max(rows, 1) // ROUND_ROWS)
    return rounds, _filter_bits(-(-rows // rounds))


def _round_of(digest: Column, rounds: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(47)), F.lit(rounds)).cast("int")


def _dealt(digests: DataFrame, digest: str, rounds: int):
    """Round -> its digests; several rounds are written once as a folder each, so that none reads another's."""
    if rounds == 1:
        return lambda r: digests
    [turn] = fresh(digests.columns, "turn")
    path = new_path(digests.sparkSession, "digest-rounds")
    digests.withColumn(turn, _round_of(F.col(digest), rounds)).write.partitionBy(turn).parquet(path)
    table = digests.sparkSession.read.schema(digests.schema.add(turn, "integer")).parquet(path)
    return lambda r: table.filter(F.col(turn) == r).drop(turn)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256."""
    digests = write_table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("tag"),
            F.unhex(F.sha2(text_of(F.col(text_col)).cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )
    total = digests.count()
    rounds, bits = _rounds(total)
    out, own_of = new_path(docs.sparkSession, "probed"), _dealt(digests, "digest", rounds)
    for r in range(rounds):
        own = own_of(r)
        bitmaps = write_table(repeat_filter(own, "digest", bits), "repeat-filter")
        probe(own, "digest", bitmaps, bits, "maybe").write.mode("append").parquet(out)
    probed = docs.sparkSession.read.schema(digests.schema.add("maybe", "boolean")).parquet(out)
    once = probed.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    again = probed.filter("maybe").select("doc_id", "tag", "digest")
    groups = write_table(
        again.groupBy("digest").agg(
            F.max(F.struct("doc_id", "tag")).alias("keep"), F.count(F.lit(1)).alias("group_size")
        ),
        "copy-groups",
    )
    joined = join_groups(again, groups, "digest", "group_size", total).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("tag") == F.col("keep.tag")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return once.unionByName(joined)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows the filter proves unique never shuffle, however many there are.  The others join the kept (id, digest) pairs, which
    are spread evenly because ids differ inside a group; rows that agree in id and text are then collapsed to one.
    """
    digest, own_id, kept_digest, turn, maybe = fresh(docs.columns, "digest", "own_id", "kept_digest", "turn", "maybe")
    text = F.unhex(F.sha2(text_of(F.col(text_col)).cast("binary"), 256))
    digests = write_table(docs.select(F.col(id_col).alias(own_id), text.alias(kept_digest)), "digests")
    rounds, bits = _rounds(digests.count())
    rows = docs.select(*every(docs), text.alias(digest))

    def stay(part: DataFrame, narrow: DataFrame) -> DataFrame:
        bitmaps = write_table(repeat_filter(narrow, kept_digest, bits), "repeat-filter")
        again = probe(narrow, kept_digest, bitmaps, bits, maybe).filter(maybe)
        keep = write_table(again.groupBy(kept_digest).agg(F.max(own_id).alias(own_id)), "kept-copies")
        probed = probe(part, digest, bitmaps, bits, maybe)
        copies = probed.filter(maybe).drop(maybe)
        same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(digest) == F.col(kept_digest))
        kept = copies.join(keep, same, "left_semi").dropDuplicates([id_col, digest])
        return probed.filter(~F.col(maybe)).select(*every(docs)).unionByName(kept.select(*every(docs)))

    if rounds == 1:
        return stay(rows, digests)
    # Sorted by round inside each file, so that every round reads about its own share of the table.
    rows = write_table(rows.withColumn(turn, _round_of(F.col(digest), rounds)).sortWithinPartitions(turn), "rounds")
    out, own_of = new_path(docs.sparkSession, "deduplicated"), _dealt(digests, kept_digest, rounds)
    for r in range(rounds):
        part = rows.filter(F.col(turn) == r).drop(turn)
        stay(part, own_of(r)).write.mode("append").parquet(out)
    return docs.sparkSession.read.schema(docs.schema).parquet(out)
