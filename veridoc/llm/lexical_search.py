"""Ranked lexical search of many items at once, with common parts of the items computed once.

Terms are maximal runs of characters other than ASCII punctuation, white space and control characters; A-Z count as a-z.
One pass over the documents keeps the postings of the terms that items use, and the counts N, L and df.  Items come in
blocks of at most BLOCK_TERMS terms.  In a block, terms that the same items use equally often form one shared set (found
by a grouping on the items of each term); sets are ordered by the number of items that hold them, and items that begin
with the same sets share a path (:func:`plan`).  For a group of documents the score parts of a set are summed once, then
each step of a path once, level by level, so an item costs what no other item has computed yet.  Every task keeps the best
documents of each item, and a ranked window merges them.

Defined cases: null or empty texts have no terms and are not counted; an item without a term that a document holds has no
row; repeated items each have their own rows; equal scores go by ascending id (null first), repeated rows each take a
rank; a very long text is read whole; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table
from .tokens import blocks

TOP = 10
BLOCK_TERMS = 200_000  # term rows of one block of items, whose plan is broadcast
GROUP_DOCS = 512
GROUP_CELLS = 16_000_000  # partial scores that a task holds at most
NO_ID = np.iinfo(np.int64).min


def _fold() -> np.ndarray:
    """Bytes as terms have them: a blank for what separates terms, lower-case letters for upper-case ones."""
    to = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalnum():
            to[b] = 0x20
    to[ord("A") : ord("Z") + 1] += 32
    return to


FOLD = _fold()


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(terms of each text, distinct terms, number of each term) of the texts."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    folded = FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(folded))
    split = pc.split_pattern(plain, " ")
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    held = real.to_numpy(zero_copy_only=False)
    edges = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)))
    per = np.diff(np.append(0, np.cumsum(held))[edges])
    coded = flat.filter(real).dictionary_encode()
    return per, coded.dictionary, coded.indices.to_numpy()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, times): the terms of every item; ``item`` numbers the rows of ``items``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(2)):
                per, names, number = terms_of(batch.column(2)[a:b])
                key, times = np.unique(np.repeat(np.arange(b - a), per) * max(len(names), 1) + number, return_counts=True)
                item = pa.array(key // max(len(names), 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].take(item), batch.column(1)[a:b].take(item), names.take(pa.array(key % max(len(names), 1))), pa.array(times.astype(np.int64))],
                    names=["item", "item_id", "term", "times"],
                )

    rows = write_table(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), "items")
    id_type = rows.schema["item_id"].dataType.simpleString()
    return write_table(rows.mapInArrow(split, f"item long, item_id {id_type}, term string, times long"), "item-terms")


def shared_sets(terms: DataFrame) -> DataFrame:
    """(terms, items, times): the terms that the same items use equally often, and those items; terms only of one block."""
    used = F.sort_array(F.collect_list(F.struct("item", "times")))
    by_term = terms.groupBy("term").agg(used.alias("used"))
    sets = by_term.groupBy("used").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return sets.select("terms", F.col("used.item").alias("items"), F.col("used.times").alias("times"))


@dataclass
class Plan:
    """Shared sets and the steps that combine them: per level (parent step, set, times), -1 being no parent."""

    set_of: np.ndarray  # of each term
    n_sets: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    ends: np.ndarray  # the step at which an item is complete, steps being numbered level by level
    items: np.ndarray

    @property
    def n_steps(self) -> int:
        return sum(len(parent) for parent, _, _ in self.levels)


def plan(sets: list[tuple[list[int], list[int], list[int]]], n_terms: int) -> Plan:
    """The steps for sets (terms, items, times): each item takes its sets from the commonest on, and equal beginnings are one."""
    order = sorted(range(len(sets)), key=lambda s: (-len(sets[s][1]), sets[s][0]))
    set_of = np.zeros(n_terms, np.int64)
    path: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for rank, s in enumerate(order):
        terms, items, times = sets[s]
        set_of[terms] = rank
        for item, n in zip(items, times, strict=True):
            path[item].append((rank, n))
    steps: list[list[tuple[int, int, int]]] = []
    known: dict[tuple[int, int, int, int], int] = {}
    last: dict[int, tuple[int, int]] = {}
    for item in sorted(path):
        at = -1
        for depth, (rank, n) in enumerate(path[item]):
            if depth == len(steps):
                steps.append([])
            key = (depth, at, rank, n)
            if key not in known:
                known[key] = len(steps[depth])
                steps[depth].append((at, rank, n))
            at = known[key]
        last[item] = (len(path[item]) - 1, at)
    base = np.append(0, np.cumsum([len(level) for level in steps])).astype(np.int64)
    levels = []
    for depth, level in enumerate(steps):
        parent, rank, n = np.array(level, np.int64).T
        levels.append((np.where(parent < 0, -1, parent + (base[depth - 1] if depth else 0)), rank, n))
    items = sorted(last)
    return Plan(set_of, len(sets), levels, np.array([base[last[i][0]] + last[i][1] for i in items], np.int64), np.array(items, np.int64))


def combine(p: Plan, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (item, document) from score parts of single terms: sets first, then each step once."""
    sets = np.zeros((p.n_sets, n_docs), np.int64)
    np.add.at(sets, (p.set_of[term], doc), part)
    steps = np.zeros((p.n_steps, n_docs), np.int64)
    at = 0
    for parent, rank, n in p.levels:
        own = sets[rank] * n[:, None]
        if at:
            own += steps[parent]
        steps[at : at + len(parent)] = own
        at += len(parent)
    return steps[p.ends]


def postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf): per document its number of terms and, as binaries, those of the given terms it holds."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(sorted(terms))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted.value, pa.string())
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                per, names, number = terms_of(batch.column(1)[a:b])
                place = pc.fill_null(pc.index_in(names, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                own = place[number]
                doc = np.repeat(np.arange(b - a), per)[own >= 0]
                key, tf = np.unique(doc * max(len(known), 1) + own[own >= 0], return_counts=True)
                held = np.bincount(key // max(len(known), 1), minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(per), _runs(key % max(len(known), 1), held), _runs(tf, held)],
                    names=["doc_id", "n", "terms", "tf"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(read, "doc_id long, n long, terms binary, tf binary")


def _runs(values: np.ndarray, per: np.ndarray) -> pa.Array:
    edges = np.append(0, np.cumsum(per * 4)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(per), [None, pa.py_buffer(edges), pa.py_buffer(values.astype("<u4"))]).cast(pa.binary())


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the postings occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0)), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in found.select("terms").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
        out[r["term"]] = r["df"]
    return out


class Best:
    """The best ``top`` documents of each item so far: highest score, then smallest id, null being the smallest."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.floor = np.zeros(n_items, np.int64)  # the worst score that counts; 0 until there are ``top``
        self.rows = (np.zeros(0, np.int64),) * 3  # item, score, id

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero((scores > 0) & (scores >= self.floor[:, None]))
        rows = [np.concatenate(x) for x in zip(self.rows, (item, scores[item, doc], ids[doc]), strict=True)]
        order = np.lexsort((rows[2], -rows[1], rows[0]))
        item = rows[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank < self.top]
        self.rows = tuple(x[kept] for x in rows)
        full = order[rank == self.top - 1]
        self.floor[rows[0][full]] = rows[1][full]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    used = item_terms(items, item_col, item_text_col)
    n_blocks = max(1, -(-used.count() // block_terms))
    dealt = used.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    out = None
    for k in range(n_blocks):
        part = _search_block(docs, dealt.filter(F.col("block") == k), top, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = used.groupBy("item").agg(F.first("item_id").alias("item_id"))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, terms: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, score): candidates of one block of items, at most ``top`` from each task and item."""
    spark = docs.sparkSession
    sets = shared_sets(terms).collect()  # at most block_terms terms
    names = sorted(t for r in sets for t in r["terms"])
    number = {t: i for i, t in enumerate(names)}
    p = plan([([number[t] for t in r["terms"]], list(r["items"]), list(r["times"])) for r in sets], len(names))
    found = write_table(postings(docs, names, id_col, text_col), "postings", "zstd")
    total = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]
    df = document_frequencies(found, len(names))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    shared = spark.sparkContext.broadcast((p, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, weight = shared.value
        best = Best(len(p.items), top)
        group = max(1, min(GROUP_DOCS, GROUP_CELLS // max(p.n_steps + p.n_sets, 1)))
        for batch in batches:
            for a in range(0, batch.num_rows if len(p.items) else 0, group):
                part = batch.slice(a, group)
                held = pc.binary_length(part.column(2)).to_numpy(zero_copy_only=False) // 4
                term, tf = _flat(part.column(2)), _flat(part.column(3))
                doc = np.repeat(np.arange(part.num_rows), held)
                m = 25 + (75 * part.column(1).to_numpy(zero_copy_only=False) * n_docs) // max(n_terms, 1)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                ids = pc.fill_null(part.column(0), NO_ID).to_numpy(zero_copy_only=False)
                best.take(combine(p, doc, term, value, part.num_rows), ids)
        item, points, ids = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.items[item]), pa.array(ids, mask=ids == NO_ID), pa.array(points)], names=["item", "doc_id", "score"]
        )

    return found.select("doc_id", "n", "terms", "tf").mapInArrow(score, "item long, doc_id long, score long")
