"""Vector functions on arrays, computed in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero norm divides by one."""
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def unit(a: Column) -> Column:
    doubles = F.transform(a, lambda x: x.cast("double"))
    return bind(doubles, lambda v: bind(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def hash_bucket(term: Column, dim: int) -> Column:
    """Bucket of a term: the first four bytes of its SHA-256, modulo dim."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long") % dim


def hash_embed(terms: Column, dim: int) -> Column:
    """Unit vector of term counts per hash bucket."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def histogram(buckets: pd.Series) -> pd.Series:
        sizes = np.fromiter((0 if b is None else len(b) for b in buckets), np.int64, len(buckets))
        flat = np.concatenate([b for b, n in zip(buckets, sizes, strict=True) if n] or [np.zeros(0, np.int64)]).astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dim + flat, minlength=len(sizes) * dim).reshape(-1, dim).astype(float)
        length = np.sqrt((counts**2).sum(1, keepdims=True))
        return pd.Series(list(counts / np.where(length == 0, 1, length)))

    return histogram(F.transform(terms, lambda t: hash_bucket(t, dim)))


def dim_check(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector has another dimension."""
    return df.filter(F.size(column) != dim)
