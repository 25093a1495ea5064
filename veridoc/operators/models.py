"""Models that the user supplies: embedding and reranking in Arrow batches, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

BATCH = 32


def embed_with(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], kind: str, dim: int, text: str = "content", out: str = "embedding") -> DataFrame:
    """Rows with unit vectors of their prefixed texts (null: empty).  ``load`` runs once a task and gives the model.

    A vector of another width fails the job; a zero vector stays zero.
    """
    prefix = {"query": "query: ", "passage": "passage: "}[kind]

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for column in batches:
            texts = [prefix + (t or "") for t in column]
            parts = [np.asarray(model(texts[i : i + BATCH]), dtype=np.float64) for i in range(0, len(texts), BATCH)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, dim))
            if vectors.shape[1] != dim:
                raise ValueError(f"the model gives {vectors.shape[1]} numbers, expected {dim}")
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list((vectors / np.where(lengths == 0, 1.0, lengths)).astype(np.float32)))

    return rows.withColumn(out, embed(F.col(text)))


def rerank_with(candidates: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query: str = "question_id",
                question: str = "question", title: str = "title", content: str = "content", item: str = "unit_id") -> DataFrame:
    """Candidates with ``rerank`` scores of (question, title and content) pairs, ranked anew by them, ties by id."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for asked, held in batches:
            pairs = list(zip(asked.fillna(""), held.fillna("")))
            yield pd.Series([float(s) for i in range(0, len(pairs), BATCH) for s in model(pairs[i : i + BATCH])], dtype="float64")

    scored = candidates.withColumn("rerank", score(F.col(question), F.concat_ws("\n", title, content)))
    order = Window.partitionBy(query).orderBy(F.col("rerank").desc(), item)
    return scored.withColumn("rank", F.row_number().over(order))
