"""Stupid-backoff scores of all documents under the n-gram model of the whole corpus.

Words are the lower-cased runs between ASCII white space; a start mark precedes each text.  With c(g) the occurrences of a
word sequence g (of the start mark: the texts with a word) and N all words, the word w behind the context h scores

    S(w | h) = c(h w) / c(h)          for the longest h, of at most ORDER - 1 words, whose h w occurs in MIN_DOCS documents
             = c(w) / N               where no h w does

times ALPHA for every word by which h had to be shortened; a document's score is the sum of ln S over its words.  All
counts cover all documents.

Every token is one row (document, n-gram).  The rows are dealt by a hash of the n-gram's last two words, so each partition
holds the count tables of its hash range for all orders; there every row finds its longest known n-gram and that one's
count.  What it must be divided by, the count of the n-gram without its last word, lies elsewhere: the rows ask for it in
a second deal, where they meet the count tables by the hash of that shorter n-gram.  The parts are summed per document.

To move little, the rows of a block of documents that go to one partition travel as packed columns, and words common in a
sample as their rank by frequency.  N-grams frequent in that sample would make hot keys; their exact counts are summed
beforehand (at most HOT of them), and rows that need no other count are scored where they are.  The samples (SAMPLE_DOCS
documents for n-grams, WORD_SAMPLE_DOCS for words) only decide which way a row takes, never its count.

Defined cases: null and empty texts have no word and score 0; a very long text is a block of its own; repeated rows each
count and get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, pack, unpack, write_table
from .tokens import blocks
from .weighted_minhash import mix

ORDER = 3
ALPHA = 0.4
MIN_DOCS = 2
SAMPLE_DOCS = 10_000
WORD_SAMPLE_DOCS = 50_000
COMMON = 1 << 19  # words with a rank
HOT = 1 << 16  # n-grams counted beforehand
CHUNK = 1 << 13  # of the counts of ranked words and hot n-grams, summed together
SLOTS = 1 << 21
BLOCK_DOCS = 1 << 14
BLOCK_BYTES = 4_000_000
PART_BYTES = 16 << 20  # of word codes that one partition receives; rows number blocks times partitions
SLICE = 1 << 19  # tokens of a partition that are counted together
STEP = 1 << 16
ARROW_ROWS = 1000
RARE = np.uint64(1 << 63)  # the code of a rare word is its hash with this bit, that of a common one its rank
NONE = np.uint64((1 << 64) - 1)  # before the start mark
START = np.uint64(0x5354415254)
DOCS, SUMS, ROWS_OF, WORD_COUNTS, COUNTS, ASK_ADD, ASK_TAKE = range(7)
ROW = "p long, kind int, size int, base long, n long, data binary"
COLUMNS = tuple(c.split()[0] for c in ROW.split(", "))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, number of every word's hash in order, words per text)."""
    import xxhash

    plain = pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))  # trimmed, as a split may read past a blank end
    split = pc.ascii_split_whitespace(plain)
    counts = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(split)
    flat = flat.filter(pc.not_equal(flat, ""))
    coded = flat.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    return hashes >> np.uint64(1), coded.indices.to_numpy(), counts.astype(np.int64)


def contexts(words: np.ndarray, counts: np.ndarray, order: int, start: np.uint64) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """([word, the one before, ...], document, number of n-gram orders above 1) of every token."""
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    columns = [words]
    for j in range(1, order):
        before = np.concatenate([words[:0], np.full(min(j, len(words)), NONE), words[: max(len(words) - j, 0)]])
        columns.append(np.where(place >= j, before, np.where(place == j - 1, start, NONE)))
    return columns, doc, np.minimum(order, place + 2)


def grams(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the sequences of the last 1, 2, ... words."""
    out = [columns[0]]
    for c in columns[1:]:
        out.append(mix(out[-1] + mix(c + np.uint64(0x9E3779B97F4A7C15))))
    return out


class Index:
    """Place of a key in a list, or -1, by one probe; a key that shares its slot with a later one is not found."""

    def __init__(self, keys: np.ndarray):
        self.slots = np.full(SLOTS, -1, np.int32)
        at = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        self.slots[at] = np.arange(len(keys))
        self.keys = np.append(keys, NONE)

    def find(self, values: np.ndarray) -> np.ndarray:
        at = self.slots[(values & np.uint64(SLOTS - 1)).astype(np.int64)]
        return np.where(self.keys[at] == values, at, -1)


class Routes:
    """The words with a rank and the hot n-grams, both found in a sample, with their exact counts once they are known."""

    def __init__(self, words: np.ndarray, hot: np.ndarray):
        self.hot, self.hash_of = Index(hot), np.append(words, NONE)
        self.rank = np.argsort(words).astype(np.int32)
        self.sorted = words[self.rank]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.rank[at], -1)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        rank = self.ranks(hashes)
        return np.where(rank >= 0, rank.astype(np.uint64), np.where(hashes == NONE, NONE, hashes | RARE))

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        rank = np.minimum(codes, np.uint64(len(self.hash_of) - 1)).astype(np.int64)
        return np.where(codes == NONE, NONE, np.where(codes & RARE, codes & ~RARE, self.hash_of[rank]))

    def hot_orders(self, g: list[np.ndarray], top: np.ndarray) -> list[np.ndarray]:
        """Per order from 2 on the place of the n-gram among the hot ones, if all shorter ones are hot too, or -1."""
        out, so_far = [], np.ones(len(top), bool)
        for k, key in enumerate(g[1:], 2):
            at = np.where(so_far & (top >= k), self.hot.find(key), -1)
            so_far = at >= 0
            out.append(at)
        return out

    def settle(self, columns: list[np.ndarray], hashes: list[np.ndarray], top: np.ndarray, best: np.ndarray, log_count: np.ndarray):
        """Scores of tokens whose longest known n-gram has ``best`` words and ``log_count``, without the counts that are
        not here; those as (tokens, columns asked for, whether to add the logarithm or take it off)."""
        value = (top - best) * math.log(ALPHA) + log_count
        asks = []
        for k in range(1, len(columns) + 1):
            mine = np.flatnonzero(best == k)
            own = columns[:1] if k == 1 else columns[1:k]
            if len(own) == 1:
                rank = own[0][mine]
                here = rank < RARE
                log = self.log_word[rank[here].astype(np.int64)]
            else:
                at = self.hot.find(grams([h[mine] for h in hashes[1:k]])[-1])
                here = at >= 0
                log = self.log_hot[at[here]]
            value[mine[here]] += log if k == 1 else -log
            if k == 1:
                value[mine] -= self.log_n
            far = mine[~here]
            if len(far):
                asks.append((far, [c[far] for c in own], k == 1))
        return value, asks


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(COLUMNS))


def runs(values: np.ndarray) -> Iterator[tuple]:
    """(value, from, to) of the runs of equal values."""
    cut = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    yield from zip(values[cut], cut, [*cut[1:], len(values)][: len(cut)], strict=True)


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order, [(partition, from, to)]) that brings together what goes to each partition."""
    part = (mix(keys) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, [(int(p), s, e) for p, s, e in runs(part[order])]


def deal(kind: int, columns: list[np.ndarray], doc: np.ndarray, base: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
    """One packed row of word codes and documents (a number in the block that starts at ``base``) for every partition."""
    order, cuts = dealt(keys, len(labels))
    columns, doc, base = [c[order] for c in columns], doc[order], base[order]
    for part, s, e in cuts:
        steps = np.diff(doc[s:e], prepend=0).astype(np.int16), np.diff(base[s:e], prepend=0)
        yield int(labels[part]), kind, len(columns), 0, e - s, pack(*(c[s:e] for c in columns), *steps)


def undeal(rows: pd.DataFrame, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(word codes, document, base) of all packed rows of so many columns."""
    got = [unpack(d, n, *["<u8"] * size, "<i2", "<i8") for d, n in zip(rows["data"], rows["n"], strict=True)]
    doc, base = (np.concatenate([np.cumsum(x[k], dtype=np.int64) for x in got]) for k in (-2, -1))
    return [np.concatenate([x[j] for x in got]) for j in range(size)], doc, base


def routing_key(g: list[np.ndarray], hot: list[np.ndarray]) -> np.ndarray:
    """The hash of the shortest n-gram that is not hot: all tokens with an n-gram that contains it have the same."""
    key = g[1].copy()
    for k in range(2, len(g)):
        key = np.where(hot[k - 2] >= 0, g[k], key)
    return key


def slices(columns: list[np.ndarray], routes: Routes, size: int) -> Iterator[np.ndarray]:
    """The tokens of a partition in turns of about ``size``; equal n-grams that are not hot come in the same turn."""
    n = -(-len(columns[0]) // size)
    turn = np.zeros(len(columns[0]), np.int32)
    for a in range(0, len(turn), size) if n > 1 else ():
        own = [c[a : a + size] for c in columns]
        g = grams([routes.hashes(c) for c in own])
        turn[a : a + size] = mix(mix(routing_key(g, routes.hot_orders(g, top_of(own))))) % np.uint64(n)
    for k in range(n):
        yield np.flatnonzero(turn == k)


def top_of(columns: list[np.ndarray]) -> np.ndarray:
    """Number of words and start marks of every token's longest n-gram."""
    top = np.full(len(columns[0]), 1)
    for c in columns[1:]:
        top += c != NONE
    return top


def choose_routes(docs: DataFrame, id_col: str, text_col: str, order: int) -> Routes:
    """Words and n-grams frequent in samples, most frequent first; an n-gram never comes before its own parts."""
    rows = max(docs.select(id_col).count(), 1)

    def frequent(orders: range, size: int, limit: int) -> np.ndarray:
        sample = docs.select(F.col(text_col).alias("text")).sample(min(1.0, size / rows), seed=17)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in blocks(batch.column(0), BLOCK_BYTES):
                    names, at, counts = words_of(batch.column(0)[a:b])
                    columns, _, top = contexts(names[at], counts, orders[-1], START)
                    g = grams(columns)
                    for k in orders:
                        h, n = np.unique(g[k - 1][top >= k], return_counts=True)
                        if k > 1:  # n-grams that are frequent repeat within a block
                            h, n = h[n > 1], n[n > 1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(h.view(np.int64)), pa.array(n)], names=["k", "h", "n"])

        counted = sample.mapInArrow(count, "k long, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).filter("n > 1")
        return counted.orderBy(F.col("n").desc(), "k", "h").limit(limit).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)

    words = frequent(range(1, 2), WORD_SAMPLE_DOCS, COMMON)
    return Routes(np.append(words, START), frequent(range(2, order + 1), SAMPLE_DOCS, HOT))


def count_routes(texts: DataFrame, routes: Routes, order: int) -> None:
    """Exact counts over all texts: of the ranked words, of the hot n-grams and their documents, and of all words."""
    n_words, n_hot = len(routes.hash_of) - 1, len(routes.hot.keys) - 1
    size = n_words + 2 * n_hot + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        in_words, in_hot, in_docs = found[:n_words], found[n_words : n_words + n_hot], found[n_words + n_hot : -1]
        for batch in batches:
            for a, b in blocks(batch.column(0), BLOCK_BYTES // 4):
                names, at, counts = words_of(batch.column(0)[a:b])
                found[-1] += len(at)
                rank = routes.ranks(names)
                in_words[rank[rank >= 0]] += np.bincount(at, minlength=len(names))[rank >= 0]
                in_words[-1] += int((counts > 0).sum())  # the start mark, the last word
                columns, doc, top = contexts(names[at], counts, order, START)
                for k, key in enumerate(grams(columns)[1:], 2):
                    hot = np.where(top >= k, routes.hot.find(key), -1)
                    some = np.flatnonzero(hot >= 0)
                    in_hot += np.bincount(hot[some], minlength=n_hot)
                    seen, several = in_documents(hot[some], doc[some], n_hot)
                    in_docs += seen + several.astype(np.int64)
        yield chunks(found)

    def chunks(found: np.ndarray) -> pa.RecordBatch:
        at = range(0, len(found), CHUNK)
        return pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([pack(found[k : k + CHUNK]) for k in at], pa.binary())], names=["at", "data"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["at"].iloc[0])
        own = sum(unpack(d, min(CHUNK, size - at), "<i8")[0] for d in pdf["data"])
        return pd.DataFrame({"at": [at], "data": [pack(own)]})

    got = texts.mapInArrow(count, "at long, data binary").groupBy("at").applyInPandas(total, "at long, data binary").collect()
    full = np.zeros(size, np.int64)
    for r in got:  # bounded by COMMON and HOT
        full[r["at"] : r["at"] + CHUNK] = unpack(r["data"], min(CHUNK, size - r["at"]), "<i8")[0]
    with np.errstate(divide="ignore"):
        routes.log_word, routes.log_hot = np.log(full[:n_words]), np.log(full[n_words : n_words + n_hot])
    routes.hot_known, routes.total = full[n_words + n_hot : -1] >= MIN_DOCS, int(full[-1])
    routes.log_n = math.log(max(routes.total, 1))


def in_documents(group: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group: whether it has a row, and whether its rows are of several documents."""
    last = np.full(n, -1, np.int64)
    last[group] = doc
    several = np.zeros(n, bool)
    several[group[last[group] != doc]] = True
    return last >= 0, several


def task_labels(docs: DataFrame, parts: int) -> np.ndarray:
    """A number for each of ``parts`` tasks that Spark's hash sends to it, so that partitions are dealt evenly."""
    spread = docs.sparkSession.range(40 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("t")).agg(F.min("id").alias("id"))
    labels = np.arange(parts) + 40 * parts
    for r in spread.collect():  # one short row per task
        labels[r["t"]] = r["id"]
    return labels


def log_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_words and log_score of every row."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    routes = choose_routes(docs, id_col, text_col, order)
    count_routes(docs.select(F.col(text_col).alias("text")), routes, order)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(8 * routes.total / PART_BYTES))
    labels, slice_tokens = task_labels(docs, parts), SLICE
    shared = spark.sparkContext.broadcast((routes, labels))  # bounded by COMMON, HOT and a number per partition

    def home(base: int, labels: np.ndarray) -> int:
        return int(labels[int(mix(np.array([base], np.uint64))[0] % np.uint64(len(labels)))])

    def sums(doc: np.ndarray, value: np.ndarray, base: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        order_ = np.argsort(base, kind="stable")
        doc, value, base = doc[order_], value[order_], base[order_]
        for block, s, e in runs(base):
            total, some = np.bincount(doc[s:e], value[s:e]), np.unique(doc[s:e])
            yield home(block, labels), SUMS, 0, int(block), len(some), pack(some.astype(np.uint16), total[some])

    def ask(asks: list, doc: np.ndarray, base: np.ndarray, routes: Routes, labels: np.ndarray) -> Iterator[tuple]:
        for at, own, add in asks:
            key = grams([routes.hashes(c) for c in own])[-1]
            yield from deal(ASK_ADD if add else ASK_TAKE, own, doc[at], base[at], key, labels)

    def ask_all(asked: dict, columns: list, doc: np.ndarray, base: np.ndarray, routes: Routes, labels: np.ndarray) -> Iterator[tuple]:
        for (size, add), found in asked.items():
            far = np.concatenate(found)
            yield from ask([(far, [c[far] for c in (columns[:1] if add else columns[1 : 1 + size])], add)], doc, base, routes, labels)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, labels = shared.value
        for batch in batches:
            spans = [(k, min(b, k + BLOCK_DOCS)) for a, b in blocks(batch.column(2), BLOCK_BYTES) for k in range(a, b, BLOCK_DOCS)]
            for a, b in spans:
                names, at, counts = words_of(batch.column(2)[a:b])
                base, ids = batch.column(0)[a].as_py(), batch.column(1)[a:b]
                null = ids.is_null().to_numpy(zero_copy_only=False)
                columns, doc, top = contexts(routes.codes(names)[at], counts, order, routes.codes(np.array([START]))[0])
                key, done, value, asked = np.empty(len(top), np.uint64), np.zeros(len(top), bool), np.zeros(len(top)), {}
                for s in range(0, len(top), STEP):  # so many tokens at a time, as each takes some 200 bytes here
                    own, long = [c[s : s + STEP] for c in columns], top[s : s + STEP]
                    hashes = [routes.hashes(c) for c in own]
                    g = grams(hashes)
                    hot = routes.hot_orders(g, long)
                    here_ = np.choose(long - 2, hot) >= 0
                    # In place: the n-grams of all orders are hot.
                    best, log_count = np.ones(len(long), np.int64), np.zeros(len(long))
                    for k, place in enumerate(hot, 2):
                        known = here_ & (place >= 0) & (routes.hot_known[place] if len(routes.hot_known) else False)
                        best[known], log_count[known] = k, routes.log_hot[place[known]]
                    here = np.flatnonzero(here_)
                    value[s + here], asks = routes.settle([c[here] for c in own], [h[here] for h in hashes], long[here], best[here], log_count[here])
                    for far, words_, add in asks:
                        asked.setdefault((len(words_), add), []).append(s + here[far])
                    # The others go where the shortest n-gram that is not hot is counted.
                    key[s : s + STEP], done[s : s + STEP] = routing_key(g, hot), here_
                here = np.flatnonzero(done)
                rows = [(home(base, labels), DOCS, 0, base, b - a, pack(pc.fill_null(ids, 0).to_numpy(), null.astype(np.uint8), counts))]
                bases = np.full(len(doc), base)
                rows += sums(doc[here], value[here], bases[here], labels)
                rows += ask_all(asked, columns, doc, bases, routes, labels)
                away = np.flatnonzero(~done)
                rows += deal(ROWS_OF, [c[away] for c in columns], doc[away], bases[away], key[away], labels)
                rare = routes.ranks(names) < 0
                if rare.any():
                    rows += count_rows(WORD_COUNTS, names[rare], np.bincount(at, minlength=len(names))[rare], labels)
                yield batch_of(rows)

    def count_rows(kind: int, keys: np.ndarray, n: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        order_, cuts = dealt(keys, len(labels))
        keys, n = keys[order_], n[order_]
        for part, s, e in cuts:
            yield int(labels[part]), kind, 0, 0, e - s, pack(keys[s:e], n[s:e])

    def find_best(pdf: pd.DataFrame) -> pd.DataFrame:
        routes, labels = shared.value
        kind = pdf["kind"].to_numpy()
        out = list(pdf[(kind != ROWS_OF) & (kind != WORD_COUNTS)].itertuples(index=False, name=None))
        words = [unpack(d, n, "<u8", "<i8") for d, n in pdf.loc[kind == WORD_COUNTS, ["data", "n"]].itertuples(index=False)]
        if words:
            key, at = np.unique(np.concatenate([k for k, _ in words]), return_inverse=True)
            out += count_rows(COUNTS, key, np.bincount(at, np.concatenate([n for _, n in words])).astype(np.int64), labels)
        mine = pdf[kind == ROWS_OF]
        if len(mine):
            columns, local, base = undeal(mine, order)
            value, asked, counted = np.zeros(len(local)), {}, {}
            for at in slices(columns, routes, slice_tokens):
                own, doc = [c[at] for c in columns], local[at] + base[at]
                hashes, top = [routes.hashes(c) for c in own], top_of(own)
                g = grams(hashes)
                best, log_count = np.ones(len(doc), np.int64), np.zeros(len(doc))
                for k, place in enumerate(routes.hot_orders(g, top), 2):
                    hot = np.flatnonzero(place >= 0)
                    known = hot[routes.hot_known[place[hot]]]
                    best[known], log_count[known] = k, routes.log_hot[place[known]]
                    some = np.flatnonzero((top >= k) & (place < 0))
                    key, group, n = np.unique(g[k - 1][some], return_inverse=True, return_counts=True)
                    several = in_documents(group, doc[some], len(key))[1]
                    known = some[several[group]]
                    best[known], log_count[known] = k, np.log(n)[group[several[group]]]
                    if k < order and several.any():
                        counted.setdefault(k, []).append((key[several], n[several]))
                del g
                value[at], asks = routes.settle(own, hashes, top, best, log_count)
                for far, words_, add in asks:
                    asked.setdefault((len(words_), add), []).append(at[far])
            for found in counted.values():
                out += count_rows(COUNTS, *(np.concatenate(x) for x in zip(*found, strict=True)), labels)
            out += sums(local, value, base, labels)
            out += ask_all(asked, columns, local, base, routes, labels)
        return pd.DataFrame(out, columns=COLUMNS)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        routes, labels = shared.value
        kind = pdf["kind"].to_numpy()
        out = list(pdf[kind == DOCS].itertuples(index=False, name=None))
        counted = [unpack(d, n, "<u8", "<i8") for d, n in pdf.loc[kind == COUNTS, ["data", "n"]].itertuples(index=False)]
        key = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in counted)])
        log_n = np.log(np.concatenate([np.zeros(0), *(n for _, n in counted)]))
        order_ = np.argsort(key)
        key, log_n = key[order_], log_n[order_]
        doc, value, base = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for r in pdf[kind == SUMS].itertuples(index=False):
            at, total = unpack(r.data, r.n, "<u2", "<f8")
            doc.append(at.astype(np.int64))
            value.append(total)
            base.append(np.full(r.n, r.base))
        for (sort, size), rows in pdf[kind >= ASK_ADD].groupby(["kind", "size"]):
            own, at, block = undeal(rows, size)
            log = log_n[np.searchsorted(key, grams([routes.hashes(c) for c in own])[-1])]
            doc.append(at)
            value.append(log if sort == ASK_ADD else -log)
            base.append(block)
        out += sums(np.concatenate(doc), np.concatenate(value), np.concatenate(base), labels)
        return pd.DataFrame(out, columns=COLUMNS)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["kind"] == DOCS].iloc[0]
        ids, null, counts = unpack(known["data"], known["n"], "<i8", "<u1", "<i8")
        total = np.zeros(len(ids))
        for d, n in pdf.loc[pdf["kind"] == SUMS, ["data", "n"]].itertuples(index=False):
            at, value = unpack(d, n, "<u2", "<f8")
            total[at] += value
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64").astype("Int64"), "n_words": counts, "log_score": total}).assign(
            doc_id=lambda x: x["doc_id"].mask(null.astype(bool))
        )

    source = docs.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(explode, ROW).repartition(parts, "p").groupBy("p").applyInPandas(find_best, ROW)
    rows = rows.repartition(parts, "p").groupBy("p").applyInPandas(answer, ROW)
    with arrow_rows(spark, ARROW_ROWS):  # a batch of texts stays small outside the heap and in the worker
        return write_table(rows.groupBy("base").applyInPandas(add, "doc_id long, n_words long, log_score double"), "log-scores")
