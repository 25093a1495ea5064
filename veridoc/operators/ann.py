"""Approximate nearest neighbours: an inverted file of cells with residual codes, and exact scores for the few that may count.

Cells are centres of a bounded, documented sample; every vector is indexed: its cell, and what is left of it after the centre
is taken off as one byte a dimension, with the length of the rounding error.  A query visits the cells nearest to it.  The
code and the error bound a vector's score from both sides, so a block passes on only vectors that may be among its k best,
and only those that may be among the k best of all blocks are scored exactly.  With all cells visited the result is exact.

How many cells are visited is measured on the sample: the least number that finds TARGET of the sample's true neighbours.  On
vectors without any grouping that is most of them; what is saved then is the reading and scoring of whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.vectors import cosine
from veridoc.operators.retrieval import DIGITS

TRAIN, CELLS, ROUNDS = 20_000, 4096, 12
TARGET, ASKED = 0.97, 400
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16384
ROUTED, TILE = 1 << 14, 1 << 20  # rows that a batch of queries becomes, and scores held at once
SLACK = 1e-5  # what single precision may add to a score


@dataclass
class Index:
    """Centres, the number of cells to visit, and a row (cell, vec_id, code, scale, error) for every vector."""

    centres: np.ndarray
    probes: int
    rows: DataFrame


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres_of(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by cosine, started at vectors drawn at random; an empty cell starts anew."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=cells) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """Cells to visit so that ``target`` of the k nearest within the sample are met, for at most ASKED of its vectors."""
    own = (x @ centres.T).argmax(1)
    asked = x[:ASKED]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, 1)[:, :k]
    order = np.argsort(-(asked @ centres.T), 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), 1)
    depth = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))))]) + 1 if len(depth) else 1


def build_index(vectors: DataFrame, k: int = 10, target: float = TARGET, vec_id: str = "vec_id", embedding: str = "embedding") -> Index:
    """Index of all vectors; centres and probes come from at most TRAIN of them, chosen by the hash of their ids."""
    fine = vectors.filter(F.col(embedding).isNotNull())
    sample = fine.select(vec_id, embedding).orderBy(F.xxhash64(vec_id), vec_id).limit(TRAIN).toPandas()  # at most TRAIN rows
    if not len(sample):
        return Index(np.zeros((1, 1)), 1, fine.select(F.lit(0).alias("cell"), vec_id, F.lit(b"").alias("code"), F.lit(0.0).alias("scale"), F.lit(0.0).alias("error")))
    x = _unit(sample[embedding])
    cells = max(1, min(CELLS, round(len(x) ** 0.5)))
    centres = centres_of(x, cells)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            y = _unit(pdf[embedding])
            own = (y @ centres.T).argmax(1)
            rest = y - centres[own]
            scale = np.abs(rest).max(1) / 127
            code = np.rint(rest / np.maximum(scale, 1e-300)[:, None]).astype(np.int8)
            error = np.linalg.norm(rest - code * scale[:, None], axis=1)
            yield pd.DataFrame({"cell": own, vec_id: pdf[vec_id], "code": [c.tobytes() for c in code], "scale": scale, "error": error})

    rows = fine.select(vec_id, embedding).mapInPandas(coded, f"cell int, {vec_id} long, code binary, scale double, error double")
    return Index(centres, probes_for(x, centres, k, target), rows)


def candidates(queries: DataFrame, index: Index, k: int, probes: int | None = None, query_id: str = "query_id", vec_id: str = "vec_id",
               embedding: str = "embedding") -> DataFrame:
    """(query, vector): the vectors of the visited cells that may be among a query's k best there."""
    centres, visited = index.centres, min(probes or index.probes, len(index.centres))

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            whole, ids = _unit(pdf[embedding]), pdf[query_id].to_numpy()
            step = max(1, ROUTED // visited)
            for at in range(0, len(whole), step):  # a query becomes a row for each cell it visits
                x = whole[at : at + step]
                base = x @ centres.T
                near = np.argsort(-base, 1, kind="stable")[:, :visited]
                codes = np.empty(len(x), object)
                codes[:] = [r.astype("<f4").tobytes() for r in x]
                yield pd.DataFrame({
                    query_id: np.repeat(ids[at : at + step], visited), "cell": near.ravel(), "base": np.take_along_axis(base, near, 1).ravel(),
                    "q": np.repeat(codes, visited),
                })

    fine = queries.filter(F.col(embedding).isNotNull()).select(query_id, embedding)
    asked = fine.mapInPandas(routed, f"{query_id} long, cell int, base double, q binary")
    # Blocks of bounded size, whatever a cell holds and however many queries visit it; a row for each cell is joined.
    sized = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = sized(index.rows, VECTOR_BLOCK, "n_v").join(sized(asked, QUERY_BLOCK, "n_q"), "cell")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bounded = F.broadcast(sizes)  # at most CELLS rows
    q = asked.join(bounded, "cell").select("*", block(query_id, "n_q").alias("_q"), each("n_v").alias("_v")).drop("n_q", "n_v")
    v = index.rows.join(bounded, "cell").select("*", block(vec_id, "n_v").alias("_v"), each("n_q").alias("_q")).drop("n_q", "n_v")

    def scan(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            x = np.frombuffer(b"".join(asked["q"]), "<f4").reshape(len(asked), -1)
            code = np.frombuffer(b"".join(held["code"]), np.int8).reshape(len(held), -1).astype(np.float32)
            scale, error, ids = held["scale"].to_numpy(), held["error"].to_numpy() + SLACK, held[vec_id].to_numpy()
            step = max(1, TILE // len(held))
            for a in range(0, len(x), step):
                about = asked["base"].to_numpy()[a : a + step, None] + (x[a : a + step] @ code.T) * scale
                low, m = about - error, min(k, len(held))
                least = np.partition(low, len(held) - m, 1)[:, len(held) - m]
                row, at = np.nonzero(about + error >= least[:, None])
                out.append(pd.DataFrame({query_id: asked[query_id].to_numpy()[a + row], vec_id: ids[at], "low": low[row, at], "high": (about + error)[row, at]}))
        return pd.concat(out) if out else pd.DataFrame({query_id: [], vec_id: [], "low": [], "high": []})

    keys = ["cell", "_q", "_v"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(scan, f"{query_id} long, {vec_id} long, low double, high double")
    by_low = Window.partitionBy(query_id).orderBy(F.col("low").desc())
    least = F.min(F.when(F.col("_n") <= k, F.col("low"))).over(Window.partitionBy(query_id))
    fair = found.withColumn("_n", F.row_number().over(by_low)).withColumn("_least", least).filter(F.col("high") >= F.col("_least"))
    return fair.select(query_id, vec_id)


def rescore(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "vec_id") -> DataFrame:
    """(query, vector, score, rank): the k best of the pairs by exact score, ties by smaller id."""
    scored = pairs.join(queries.select(query_id, F.col("embedding").alias("_q")), query_id).join(vectors.select(vec_id, F.col("embedding").alias("_v")), vec_id)
    scored = scored.select(query_id, vec_id, F.round(cosine(F.col("_q"), F.col("_v")), DIGITS).alias("score"))
    best = Window.partitionBy(query_id).orderBy(F.col("score").desc(), vec_id)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def knn_ann(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "vec_id", probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best vectors in the cells that each query visits."""
    index = build_index(vectors, k, vec_id=vec_id)
    return rescore(candidates(queries, index, k, probes, query_id, vec_id), queries, vectors, k, query_id, vec_id)
