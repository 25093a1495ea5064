"""Retrieval quality, percentiles, splits and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.operators.scan import numbered, values_at


def rank_of(ranked: DataFrame, accepted: DataFrame, query: str, item: str) -> DataFrame:
    """First rank of an accepted item per query."""
    return ranked.join(accepted, [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("first_rank"))


def topk_rates(ranks: DataFrame, variant: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of queries whose first accepted rank is within k, by variant and overall; a missing rank is a miss."""
    rates = [F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))), 6).alias(f"top{k}") for k in ks]
    out = ranks.rollup(variant).agg(F.count(F.lit(1)).alias("n"), *rates)
    return out.withColumn(variant, F.coalesce(F.col(variant).cast("string"), F.lit("all")))


def nearest_rank_percentiles(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles by key: the smallest value with at least that share at or below it."""
    places = {f"p{round(s * 100)}": F.greatest(F.ceil(F.col("n") * F.lit(s)), F.lit(1)) for s in shares}
    return values_at(df, key, value, places).drop("n")


def truncated_p95(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value at place floor(0.95 n) in order; keys of one value have none."""
    found = values_at(df, key, value, {"p95": F.floor(F.col("n") * 95 / 100)})
    return found.filter(F.col("p95").isNotNull()).select(key, "p95")


def interpolated_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median): the middle value, or the mean of the two in the middle."""
    n = F.col("n")
    found = values_at(df, key, value, {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1})
    return found.select(key, "n", ((F.col("low") + F.col("high")) / 2).alias("median"))


def split_items(items: DataFrame, item: str) -> DataFrame:
    """Alternate items by rank of their id: tuning, validation."""
    placed = numbered(items.select(item).distinct(), [item], "_place")
    return placed.select(item, F.when(F.col("_place") % 2 == 1, "tuning").otherwise("validation").alias("half"))


def bucket(rank: Column, in_evidence: Column) -> Column:
    """C first, B in the evidence but not first, A absent."""
    return F.when(rank == 1, "C").when(in_evidence, "B").otherwise("A")


def recall(found: DataFrame, truth: DataFrame, query: str, item: str) -> DataFrame:
    """Mean share of the true items that were found."""
    hit = truth.join(found.select(query, item).withColumn("_hit", F.lit(1)), [query, item], "left")
    per = hit.groupBy(query).agg((F.count("_hit") / F.count(F.lit(1))).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("r"), 6).alias("recall"))
