"""Alignment of two tokenizers' ids by the byte offsets at which tokens of both end.

Encoder A is a byte-level BPE, encoder B a piece BPE whose pieces never join words; both read a space and the text.  Such a
text is cut before spaces behind a visible character and before marks behind a letter, where tokens of both always end, and
each distinct chunk is encoded and aligned once.  In a chunk the shorter list of token ends drives an exponential and then
binary search into the longer one (:func:`gallop`); the common ends slice groups, and the differences of their ranks are the
overlapping ranges.

A document is stored as its distinct linked id pairs with the number of links of each.  How many documents hold a pair is
summed over these rows; scores come from one more pass over them, with the counts of a bounded range of A ids (at most
ROUND_PAIRS pairs) broadcast at a time, so nothing but counts is shuffled.

Defined cases: null and empty texts, and those whose tokens of A or B do not spell a space and the text, have no tokens:
zeros and an empty string; a very long text is aligned whole; repeated rows are documents of their own; ties for the
highest count of an A id all count as best; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .tokens import _spans, blocks

MARK = "▁"  # stands for a space in B's pieces
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
LATIN = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
CACHE_CHUNKS = 300_000
ROUND_PAIRS = 4_000_000  # pairs whose counts one broadcast holds: at most 52 MB
COUNT_ROWS = 4_000_000
BLOCK_BYTES = 2_000_000
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"


def gallop(ends: np.ndarray, first: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each value its place in the ascending run ``ends[first:stop]``, or -1: steps double until the value is passed, then halve.

    All values take their steps together.
    """
    low, step = first.copy(), np.ones(len(first), np.int64)
    going = np.arange(len(first))
    while len(going):
        at = low[going] + step[going]
        going = going[at < stop[going]]
        going = going[ends[low[going] + step[going]] < value[going]]
        step[going] *= 2
    high = np.minimum(low + step, stop - 1)
    low = np.where(step > 1, low + step // 2, low)
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        less = ends[middle] < value[going]
        low[going] = np.where(less, middle + 1, low[going])
        high[going] = np.where(less, high[going], middle)
        going = going[low[going] < high[going]]
    return np.where((first < stop) & (ends[np.minimum(low, len(ends) - 1)] == value), low, -1)


def common_ends(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of the values common to both lists of each text; ``n_a`` and ``n_b`` are the lists' lengths.

    In every text the shorter list drives the search through the longer one.
    """
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    found = []
    for short, n_short, from_short, long, n_long, from_long, mine in (
        (a, n_a, start_a, b, n_b, start_b, n_a <= n_b), (b, n_b, start_b, a, n_a, start_a, n_a > n_b),
    ):
        place = _spans(from_short[mine], n_short[mine])
        own = np.repeat(np.flatnonzero(mine), n_short[mine])
        other = gallop(long, from_long[own], from_long[own] + n_long[own], short[place]) if len(place) else place
        hit = other >= 0
        found.append((place[hit], other[hit]))
    (in_a, in_b), (back_b, back_a) = found
    in_a, in_b = np.concatenate([in_a, back_a]), np.concatenate([in_b, back_b])
    order = np.argsort(in_a)
    return in_a[order], in_b[order]


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if visible in Latin-1, else from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Aligned chunks, kept by number; when more than ``limit`` are known, those met in one block only are forgotten."""

    def __init__(self, byte_level: str, pieces: str, limit: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        of, vocab = byte_alphabet(), self.a.get_vocab()
        spelled = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            spelled[i] = bytes(of.get(c, 0) for c in piece)
        self.n_b = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.n_b)]
        words = [p for i, p in enumerate(names) if not self.b.is_byte(i)]
        if any(MARK in p.lstrip(MARK) for p in words):
            raise ValueError("pieces of the second vocabulary join words")
        #: Marks that no piece has behind a letter, and a letter that is a piece: in front of them a text is cut as well.
        self.marks = np.zeros(256, bool)
        self.marks[[ord(m) for m in ".,;:!?" if not any(re.search(f"{LETTER}[{m}]", p) for p in words)]] = True
        self.lead = "x"
        self.marks &= self.b.piece_to_id(MARK + self.lead) != self.b.unk_id()
        self.a_bytes = pa.array(spelled, pa.binary())
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)], pa.binary())
        self.a_names, self.b_names = (pa.array(map(str, range(n)), pa.string()) for n in (len(spelled), self.n_b))
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.met = np.zeros(0, np.int64)  # blocks that held the chunk
        self.sizes = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, 1 where the tokens do not spell the chunk
        self.shown = pa.array([], pa.string())
        self.counts = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Drop the chunks met in one block, or all where that leaves too many."""
        often = self.met > 1
        if often.sum() > self.limit // 2:
            return self.clear()
        names = [c for c, k in zip(self.known, often.tolist(), strict=True) if k]  # a dict keeps the order of its numbers
        at = _spans((np.cumsum(self.counts) - self.counts)[often], self.counts[often])
        self.known = dict(zip(names, count()))
        self.pairs, self.links, self.counts = self.pairs[at], self.links[at], self.counts[often]
        self.sizes, self.shown, self.met = self.sizes[often], self.shown.filter(pa.array(often)), np.ones(len(names), np.int64)

    def _encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # B puts a space in front of what it reads, but not of nothing: a space at the end of a text is a piece of its own.
        # A chunk that begins with a mark is read behind a letter.
        b = self.b.encode([c[1:] if c[0] == " " else self.lead + c for c in chunks], num_threads=1)
        lone = [self.b.piece_to_id(MARK)]
        return a, [lone if c == " " else i if c[0] == " " else i[1:] for c, i in zip(chunks, b, strict=True)]

    def learn(self, chunks: list[str]) -> None:
        """Encode and align new chunks, all of them together."""
        encoded = self._encode(chunks)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in encoded)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip(encoded, (n_a, n_b), strict=True))
        raw = pa.array(chunks, pa.string()).cast(pa.binary())
        bad, width = np.zeros(len(chunks), bool), []
        for ids, n, spelled in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            parts = spelled.take(pa.array(ids))
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), parts), b"")
            bad |= ~pc.equal(whole, raw).to_numpy(zero_copy_only=False).astype(bool)
            width.append(pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
        for k, (ids, n) in enumerate(((a, n_a), (b, n_b))):  # chunks that are not spelled have no tokens
            keep = ~np.repeat(bad, n)
            width[k] = width[k][keep]
            if k:
                b, n_b = ids[keep], np.where(bad, 0, n)
            else:
                a, n_a = ids[keep], np.where(bad, 0, n)
        in_a, in_b = common_ends(np.cumsum(width[0]), n_a, np.cumsum(width[1]), n_b)
        # A group is what lies between two common ends; every chunk's end is one, so no group spans two chunks.
        of_a, of_b = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
        chunk = np.repeat(np.arange(len(chunks)), n_a)[in_a]
        groups = np.bincount(chunk, minlength=len(chunks))
        n_links = np.bincount(chunk, of_a * of_b, len(chunks)).astype(np.int64)
        text = [
            pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), names.take(pa.array(ids))), ",")
            for ids, n, names in ((a, of_a, self.a_names), (b, of_b, self.b_names))
        ]
        shown = pc.binary_join_element_wise(*text, "|")
        shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(groups)).astype(np.int32)), shown), ";")
        owner, pair, links = self._pairs(a, b, of_a, of_b, chunk)
        counts = np.bincount(owner, minlength=len(chunks))
        self.known.update(zip(chunks, count(len(self.known))))
        self.met = np.append(self.met, np.zeros(len(chunks), np.int64))
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, groups, n_links, bad], 1)])
        self.shown = pa.concat_arrays([self.shown, shown])
        self.counts = np.append(self.counts, counts)
        self.pairs, self.links = np.append(self.pairs, pair), np.append(self.links, links)

    def _pairs(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, pair, links) of the distinct pairs of each chunk: every distinct A id of a group with every distinct B id."""
        sides = []
        for ids, n in ((a, of_a), (b, of_b)):
            key, times = np.unique(np.repeat(np.arange(len(n)), n) << 32 | ids, return_counts=True)
            sides.append((key & 0xFFFFFFFF, times, np.bincount(key >> 32, minlength=len(n))))
        (x, x_times, n_x), (y, y_times, n_y) = sides
        each = np.repeat(n_y, n_x)  # partners of each distinct A id
        left = np.repeat(np.arange(len(x)), each)
        right = _spans(np.repeat(np.cumsum(n_y) - n_y, n_x), each)
        key = np.repeat(chunk, n_x * n_y) << 32 | x[left] * self.n_b + y[right]
        order = np.argsort(key, kind="stable")
        key, links = key[order], (x_times[left] * y_times[right])[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        key, links = key[new], np.add.reduceat(links, new) if len(new) else links
        return key >> 32, key & 0xFFFFFFFF, links

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of each chunk, chunks of each text); every text begins with its space."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
        padded = np.concatenate([np.zeros(3, np.uint8), data])
        one, two, three = padded[2:-1], padded[1:-2], padded[:-3]  # the bytes before each byte
        visible = (one > 0x20) & (one != 0x7F)
        # Behind characters that may be white space there is no cut: those of two bytes with C2, of three with E1, E2 and E3.
        visible &= ~((one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
        letter = LATIN[one] | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
        cut = (data == 0x20) & visible | self.marks[data] & letter
        cut[: offsets[0]] = False
        cut[offsets[:-1]] = True
        at = np.flatnonzero(cut)
        edges = np.append(at, offsets[-1]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), texts.buffers()[2]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        if (numbers < 0).any():
            base = len(self.known)
            self.learn([names[i] for i in np.flatnonzero(numbers < 0)])
            numbers[numbers < 0] = base + np.arange((numbers < 0).sum())
        self.met[numbers] += 1
        return numbers[coded.indices.to_numpy()], np.diff(np.searchsorted(at, offsets))

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(sizes of each text, its printed groups, distinct pairs of each text, all pairs in order of text and pair, links of each)."""
        if len(self.known) > self.limit:
            self.shrink()
        texts = pc.fill_null(texts, "").cast(pa.string())
        spaced = pc.binary_join_element_wise("", texts, " ")
        number, per = self.chunks(spaced)
        first = np.cumsum(per) - per
        sizes = np.add.reduceat(self.sizes[number], first) if len(per) else np.zeros((0, 5), np.int64)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool)
        good = (sizes[:, 4] == 0) & ~empty
        sizes[~good] = 0
        # Only the chunks of texts that have tokens go on.
        doc = np.repeat(np.arange(len(per)), per)
        mine = good[doc]
        doc, number = doc[mine], number[mine]
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(np.where(good, per, 0))).astype(np.int32)), self.shown.take(pa.array(number))
        )
        shown = pc.binary_join(lists, ";").to_pylist()
        seen, times = np.unique(doc * len(self.counts) + number, return_counts=True)
        doc, number = seen // max(len(self.counts), 1), seen % max(len(self.counts), 1)
        n = self.counts[number]
        at = _spans((np.cumsum(self.counts) - self.counts)[number], n)
        key = np.repeat(doc, n) << 32 | self.pairs[at]
        value = np.repeat(times, n) * self.links[at]
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        key, value = key[new], np.add.reduceat(value, new) if len(new) else value
        return sizes[:, :4], shown, np.bincount(key >> 32, minlength=len(per)), key & 0xFFFFFFFF, value


@lru_cache(maxsize=1)
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One aligner per Python worker, kept between tasks."""
    return Aligner(byte_level, pieces)


def _packed(values: np.ndarray, per: np.ndarray, width: str) -> pa.Array:
    """The runs of ``per`` values as binaries."""
    edges = np.append(0, np.cumsum(per * np.dtype(width).itemsize)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(per), [None, pa.py_buffer(edges), pa.py_buffer(values.astype(width))]).cast(pa.binary())


def _unpacked(column: pa.Array, width: str) -> np.ndarray:
    """All values of a column of packed runs."""
    return np.frombuffer(b"".join(column.to_pylist()), width).astype(np.int64)


def align_documents(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, the linked pairs and their links as
    binaries, and with ``groups`` the groups in print."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_level, pieces)
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK_BYTES):
                sizes, shown, per, pairs, links = own.align(batch.column(1)[a:b])
                # Pairs ascend, so their differences are stored; a text's first pair stands as it is.
                steps = np.diff(pairs, prepend=0)
                first = (np.cumsum(per) - per)[per > 0]
                steps[first] = pairs[first]
                columns = [batch.column(0)[a:b], *(pa.array(sizes[:, k]) for k in range(4)),
                           pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown], pa.string()),
                           _packed(steps, per, "<u4"), _packed(links, per, "<u8")]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
                if groups:
                    columns.append(pa.array(shown, pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(aligned, ALIGNED + ", groups string" * groups)


def _pairs_of(steps: pa.Array, per: np.ndarray) -> np.ndarray:
    """The pairs of stored differences."""
    flat = _unpacked(steps, "<u4")
    total = np.cumsum(flat)
    first = (np.cumsum(per) - per)[per > 0]
    base = total[first] - flat[first]
    return total - np.repeat(base, per[per > 0])


def _per(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): by how many documents each id pair is held linked; a document names a pair once."""

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                column = batch.column(0)[a:b]
                held.append(np.unique(_pairs_of(column, _per(column)), return_counts=True))
                size += len(held[-1][0])
                if size > COUNT_ROWS:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > COUNT_ROWS // 2:
                        yield _count_rows(*held.pop())
                        size = 0
        if held:
            yield _count_rows(*_summed(held))

    return aligned.select("pairs").mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in held]))
    return pair, n


def _count_rows(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])


def link_scores(aligned: DataFrame, n_b: int, round_pairs: int = ROUND_PAIRS) -> DataFrame:
    """``aligned`` (written, so that it is read alike each time) without its binaries, and n_best and count_sum: links whose
    count is the highest of their A id, and the sum of all links' counts.  ``n_b`` is the size of B's vocabulary."""
    spark = aligned.sparkSession
    counts = write_table(pair_counts(aligned).withColumn("a", F.expr(f"pair div {n_b}")), "pair-counts")
    sizes = sorted((r["a"], r["n"]) for r in counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each id of A
    turn, held, rounds = 0, 0, {}
    for a, n in sizes:
        if held and held + n > round_pairs:
            turn, held = turn + 1, 0
        held += n
        rounds.setdefault(turn, []).append(a)
    parts = []
    for own in rounds.values():
        found = counts.filter(F.col("a").between(own[0], own[-1])).select("pair", "n").toPandas().sort_values("pair")  # at most ROUND_PAIRS rows
        pair, n = found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
        start = np.flatnonzero(np.append(True, np.diff(pair // n_b) > 0))
        best = n == np.repeat(np.maximum.reduceat(n, start), np.diff(np.append(start, len(n))))
        parts.append(_scored(aligned, spark.sparkContext.broadcast((pair.astype(np.uint32), n, best))))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return aligned.select(*plain, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    # Repeated rows agree in all columns, so each round brings as many rows of a kind.
    rows = reduce(DataFrame.unionByName, parts)
    summed = rows.groupBy(*plain).agg(F.sum("n_best").alias("best"), F.sum("count_sum").alias("sums"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"))
    each = F.explode(F.sequence(F.lit(1), "copies"))
    return summed.select(*plain, F.expr("best div copies").alias("n_best"), F.expr("sums div copies").alias("count_sum"), each.alias("copy")).drop("copy")


def _scored(aligned: DataFrame, table) -> DataFrame:
    """Documents and the part of n_best and count_sum that comes from the broadcast pairs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            for a, b in blocks(batch.column(6)):
                part = batch.slice(a, b - a)
                per = _per(part.column(6))
                own, links = _pairs_of(part.column(6), per), _unpacked(part.column(7), "<i8")
                at = np.minimum(np.searchsorted(pair, own.astype(np.uint32)), len(pair) - 1)
                links = np.where(pair[at] == own, links, 0)
                ends = np.append(0, np.cumsum(per))
                sums = [np.diff(np.append(0, np.cumsum(v))[ends]) for v in (links * best[at], links * n[at])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:6], *map(pa.array, sums)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"],
                )

    schema = ALIGNED.split(", pairs")[0] + ", n_best long, count_sum long"
    return aligned.select(*[c.split()[0] for c in ALIGNED.split(", ")]).mapInArrow(score, schema)


def align_and_score(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", round_pairs: int = ROUND_PAIRS) -> DataFrame:
    """One row for each document: sizes, digest of the groups, n_best and count_sum."""
    from sentencepiece import SentencePieceProcessor

    n_b = SentencePieceProcessor(model_file=pieces).get_piece_size()
    aligned = write_table(align_documents(docs, byte_level, pieces, id_col, text_col), "aligned", "zstd")
    return link_scores(aligned, n_b, round_pairs)
