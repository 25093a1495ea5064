"""Running totals and places in order where one key may hold every row.

A window over a key is one sorted run in one task.  Here rows are dealt by their order into parts of about equal size (the
bounds come from a sample that depends on the rows alone), each part is scanned by itself, and what the parts before it
add up to, one row for each key and part, is joined to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS, SAMPLE = 32, 4096


def part_of(df: DataFrame, order: list[str], parts: int = PARTS) -> Column:
    """Number of the part in which a row stands, by bounds from at most SAMPLE rows chosen by their hash."""
    key = F.struct(*order)
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE).agg(F.sort_array(F.collect_list("k")).alias("ks"))
    held = sample.first()["ks"]
    bounds = list(dict.fromkeys(held[len(held) * i // parts] for i in range(1, parts))) if held else []
    types = [df.schema[c].dataType for c in order]
    literal = lambda row: F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(row, types, order, strict=True)))
    return reduce(lambda n, row: n + (key >= literal(row)).cast("int"), bounds, F.lit(0))


def running(df: DataFrame, by: list[str], order: list[str], totals: dict[str, tuple[str, str]], parts: int = PARTS) -> DataFrame:
    """``df`` and, for each name in ``totals``, the sum or max of a column over the rows before this one within ``by``.

    totals: name -> (column, "sum" or "max"); sums are 0 where no row stands before, maxima null.  ``order`` must tell all
    rows apart; nulls come first in it, and null keys are one group.
    """
    keys = [*by, "_part"]
    dealt = df.withColumn("_part", part_of(df, order, parts))
    kinds = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows a key
    local = dealt.select("*", *(kinds[how](c).over(inside).alias(f"_in_{n}") for n, (c, how) in totals.items()))
    sums = dealt.groupBy(*keys).agg(*(kinds[how](c).alias(n) for n, (c, how) in totals.items()))
    before = sums.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(kinds[how](n).over(earlier).alias(f"_pre_{n}") for n, (_, how) in totals.items()))
    joined = local.join(before, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)), "left")

    def whole(name: str, how: str) -> Column:
        own, pre = F.col(f"_in_{name}"), F.col(f"_pre_{name}")
        return F.greatest(own, pre) if how == "max" else F.coalesce(own, F.lit(0)) + F.coalesce(pre, F.lit(0))

    return joined.select(*df.columns, *(whole(n, how).alias(n) for n, (_, how) in totals.items()))


def numbered(df: DataFrame, order: list[str], out: str, by: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """``df`` with the place of each row in order, from 1, within ``by`` or over all."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    if by is None:
        ones, by = ones.withColumn("_all", F.lit(0)), ["_all"]
    return running(ones, by, order, {out: ("_one", "sum")}, parts).withColumn(out, F.col(out) + 1).select(*df.columns, out)


def values_at(df: DataFrame, key: str, value: str, places: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """One row per key: n, min, max and the values at the given places (from 1, in terms of ``n``) among its values in order.

    Equal values are counted before anything is ordered; nulls are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    n = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("c").alias("n"))
    placed = running(counts, [key], [value], {"before": ("c", "sum")}, parts).join(n, F.col(key).eqNullSafe(F.col("_key")))
    hit = lambda p: F.min(F.when(F.col("before") + F.col("c") >= p, F.col(value)))
    at = [F.when(F.max(p) >= 1, hit(p)).alias(name) for name, p in places.items()]
    return placed.groupBy(key).agg(F.max("n").alias("n"), F.min(value).alias("min"), *at, F.max(value).alias("max"))
