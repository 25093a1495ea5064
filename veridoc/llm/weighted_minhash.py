"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of SHINGLE lower-cased words; a text with fewer words is one shingle, a text without words none.  The
weight of a shingle in a text is its count times idf(d) = (1 + ln (1 + N) / (1 + d)) / (1 + ln (1 + N) / 2), d being the number
of the N distinct texts that hold it: a shingle of one text weighs its count, every other one less.

The document frequencies of all shingles are exact.  Distinct texts lie in batches, in buckets of the batch number.  The sorted
hashes of a batch are cut into ranges, one packed row each; a range meets its rows of all batches, counts, and tells each batch
which of its shingles other texts hold, and how many.  Back at its texts, a batch knows its hashes by their order, so places
are enough.

Every distinct text gets BANDS * ROWS consistent samples (element, t); texts that agree in all samples of a band share a
bucket.  No bucket is expanded to all pairs: members are compared with a pivot, members that may not be similar to it
with three more, and what still lies in different components is compared block by block on fingerprints.  Each pair
whose fingerprints agree in MIN_AGREE samples is verified by exact weighted Jaccard similarity; classes are the connected
components of the verified links.  Copies are collapsed before all this and rejoin at the end.

Defined cases: null text counts as empty; a very long text is shingled whole; equal texts, empty ones too, are always one class; a class is named by its
smallest id (null is smaller than any) and that row stays, one of them if rows repeat; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import exact_dedup
from .common import arrow_rows, every, fresh, join_groups, pack, text_of, unpack, write_buckets, write_table
from .tokens import blocks

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 4
SAMPLES = BANDS * ROWS
MIN_AGREE = 20  # of SAMPLES; a pair at 0.8 falls below with a chance of about 1e-5
SURE_AGREE = 36
F0 = 0.0  # share of the texts up to which shingles would share one idf: none do
BATCH_BYTES = 12_000_000  # of text, on average
RANGE_TEXT = 16_000_000  # bytes of text to a range of hashes, some 2 million of them
BUCKET_BYTES = 64_000_000
BLOCK = 512
SIGN_SHINGLES = 33_000  # of texts signed together, so that their arrays stay in the processor's cache
ARROW_ROWS = 1000
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingle hashes, sorted, and their counts."""
    import xxhash

    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    flat = hashed[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)
    n = max(len(flat) - SHINGLE + 1, 0)
    five = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        five = mix(five + np.uint64(k + 1)) ^ flat[k : n + k]
    five = mix(five)
    out, at = [], 0
    for m in counts.tolist():
        if m >= SHINGLE:
            out.append(np.unique(five[at : at + m - SHINGLE + 1], return_counts=True))
        elif m and (m > 1 or flat[at] != EMPTY_WORD()):
            own = np.uint64(m)
            for w in flat[at : at + m]:
                own = mix(np.array([own], np.uint64))[0] ^ w
            out.append((np.array([own], np.uint64), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += m
    return out


@lru_cache(maxsize=1)
def EMPTY_WORD() -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(""))


class Weights:
    """Shingle weights: count times idf, from the shingles of several texts and the number of texts."""

    def __init__(self, common: np.ndarray, rows_with: np.ndarray, rows: int):
        order = np.argsort(common)
        self.common = common[order]
        self.rows_with, self.rows = rows_with[order], rows

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weigh(counts, *self.held(hashes), self.rows)

    def held(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are common, how many texts hold those)."""
        if not (len(self.common) and len(hashes)):
            return np.zeros(len(hashes), bool), np.zeros(0)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        hit = self.common[at] == hashes
        return hit, self.rows_with[at[hit]]


def weigh(counts: np.ndarray, hit: np.ndarray, rows_with: np.ndarray, rows: int) -> np.ndarray:
    """Counts times idf; those not hit have an idf of 1."""
    w = counts.astype(np.float64)
    w[hit] *= (1 + np.log((1 + rows) / (1 + rows_with))) / (1 + math.log((1 + rows) / 2))
    return w


@lru_cache(maxsize=1)
def gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 65,536 midpoints: 1 - exp(-x) (1 + x) = p, by Newton's method."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        f = 1 - np.exp(-x) * (1 + x) - p
        x = np.maximum(x - f / np.maximum(x * np.exp(-x), 1e-12) * 0.9, x / 4)
    return x


@lru_cache(maxsize=1)
def log_gamma_quantiles() -> np.ndarray:
    return np.log(gamma_quantiles())


def mix_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    """:func:`mix` of x, written over it."""
    for bits, factor in ((30, MIX1), (27, MIX2)):
        np.right_shift(x, np.uint64(bits), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, factor, out=x)
    np.right_shift(x, np.uint64(31), out=spare)
    np.bitwise_xor(x, spare, out=x)


def sample(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Fingerprints (set, sample) as 32-bit integers; every set must have an element.

    One set of arrays serves all samples.  An element of weight 1 has t = 0, which leaves the division to the other ones.
    """
    flat = np.concatenate([h for h, _ in sets])
    log_w = np.log(np.concatenate([w for _, w in sets]))
    starts = np.cumsum([0] + [len(h) for h, _ in sets[:-1]])
    odd = np.flatnonzero(log_w)
    log_odd = log_w[odd]
    gamma, log_gamma = gamma_quantiles(), log_gamma_quantiles()
    out = np.empty((len(sets), SAMPLES), np.uint32)
    n = len(flat)
    x, spare, a, b = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n), np.empty(n)
    rank, both = np.empty(n, np.float32), np.empty((n, 2), np.uint32)
    for j in range(SAMPLES):
        np.bitwise_xor(flat, mix(np.full(1, j + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=x)
        mix_in_place(x, spare)
        parts = x.view(np.uint16).reshape(-1, 4)
        np.multiply(x.view(np.uint32)[1::2], 2.0**-32, out=b)
        beta, x_odd = b[odd], x[odd]
        np.subtract(1, b, out=b)
        np.take(gamma, parts[:, 0], out=a)
        r = a[odd]
        np.multiply(a, b, out=a)  # r (1 - beta)
        np.take(log_gamma, parts[:, 1], out=b)
        t = np.floor(log_odd / r + beta)
        log_c = b[odd]
        np.subtract(b, a, out=a)
        a[odd] = log_c - r * (t + 1 - beta)
        rank[:] = a
        # Floats in the order of unsigned integers: negative ones with all bits turned, others with the sign bit set.
        sign = (rank.view(np.int32) >> 31).view(np.uint32)
        np.bitwise_xor(rank.view(np.uint32), sign | np.uint32(1 << 31), out=both[:, 1])
        mix_in_place(x, spare)
        x[odd] = mix(x_odd + t.astype(np.int64).astype(np.uint64) * MIX1)
        both[:, 0] = x.view(np.uint32)[::2]
        out[:, j] = (np.minimum.reduceat(both.view(np.uint64)[:, 0], starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def band_keys(prints: np.ndarray) -> np.ndarray:
    """(set, band) keys of agreeing sample groups."""
    keys = np.empty((len(prints), BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(len(prints), b + 1, np.uint64)
        for k in range(ROWS):
            h = mix(h + prints[:, b * ROWS + k].astype(np.uint64))
        keys[:, b] = h.view(np.int64)
    return keys


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    if not (len(h1) and len(h2)):
        return 0.0
    at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
    both = h2[at] == h1
    least = np.minimum(w1[both], w2[at[both]]).sum()
    return float(least / (w1.sum() + w2.sum() - least))


# --- statistics -------------------------------------------------------------------------------------------------------


class Ranges:
    """Equal ranges of 64-bit hashes."""

    def __init__(self, n: int):
        self.bounds = np.array([(k << 64) // n for k in range(n)], np.uint64)

    def cuts(self, ordered: np.ndarray) -> list[int]:
        """Where each range begins in sorted hashes, and the last ends."""
        return [*np.searchsorted(ordered, self.bounds).tolist(), len(ordered)]


def all_shingles(texts: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`shingles` of a batch."""
    return [s for chunk in texts.chunks for a, b in blocks(chunk) for s in shingles(chunk[a:b])]


def texts_with(batches: DataFrame, ranges: Ranges) -> DataFrame:
    """(batch, part, n, data) of all shingles that several texts hold: places among the batch's hashes of that range, and texts."""

    def ask(batch: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate([h for h, _ in all_shingles(batch["text"])]), return_counts=True)
        cut = ranges.cuts(h)
        spans = [(p, s, e) for p, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if s < e]
        return packed(batch["batch"][0].as_py(), [(p, e - s, pack(np.diff(h[s:e], prepend=np.uint64(0)), n[s:e].astype(np.uint32))) for p, s, e in spans])

    def count(asked: pa.Table) -> pa.Table:
        sizes = asked["n"].to_pylist()
        got = [unpack(d, n, "<u8", "<u4") for d, n in zip(asked["data"].to_pylist(), sizes, strict=True)]
        _, at = np.unique(np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in got]), return_inverse=True)
        total = np.bincount(at, np.concatenate([n for _, n in got])).astype(np.uint32)[at]
        out, part, end = [], asked["part"][0].as_py(), 0
        for batch, n in zip(asked["batch"].to_pylist(), sizes, strict=True):
            own, end = total[end : end + n], end + n
            some = np.flatnonzero(own > 1)
            if len(some):
                out.append(packed(batch, [(part, len(some), pack(np.diff(some, prepend=0).astype(np.uint32), own[some]))]))
        return pa.concat_tables(out) if out else packed(0, [])

    asked = batches.select("batch", "text").groupBy("batch").applyInArrow(ask, PACKED)
    return asked.groupBy("part").applyInArrow(count, PACKED)


PACKED = "batch long, part int, n int, data binary"


def packed(batch: int, rows: list[tuple]) -> pa.Table:
    columns = [pa.array([batch] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary())))]
    return pa.Table.from_arrays(columns, names=["batch", "part", "n", "data"])


def weights_of(h: np.ndarray, told: pa.Table, ranges: Ranges, rows: int) -> Weights:
    """The weights of a batch with the sorted hashes ``h``, from its rows of :func:`texts_with`."""
    cut, common, held = ranges.cuts(h), [h[:0]], [np.zeros(0)]
    for part, n, data in zip(*(told[c].to_pylist() for c in ("part", "n", "data")), strict=True):
        step, texts = unpack(data, n, "<u4", "<u4")
        common.append(h[cut[part] + np.cumsum(step, dtype=np.int64)])
        held.append(texts.astype(float))
    return Weights(np.concatenate(common), np.concatenate(held), rows)


# --- links ------------------------------------------------------------------------------------------------------------


@F.pandas_udf(BooleanType())
def may_agree(x: pd.Series, y: pd.Series) -> pd.Series:
    """Whether the fingerprints agree in MIN_AGREE samples."""
    return pd.Series(_agree(x, y) >= MIN_AGREE)


@F.pandas_udf(BooleanType())
def surely_agree(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(_agree(x, y) >= SURE_AGREE)


def _prints(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint16).reshape(len(x), SAMPLES)


def _agree(x: pd.Series, y: pd.Series) -> np.ndarray:
    return (_prints(x) == _prints(y)).sum(1) if len(x) else np.zeros(0)


@F.pandas_udf(BooleanType())
def similar(h1: pd.Series, w1: pd.Series, h2: pd.Series, w2: pd.Series) -> pd.Series:
    """Whether two sets, as binary hashes and weights, reach SIMILAR."""
    u, f = (lambda b: np.frombuffer(b, "<u8")), (lambda b: np.frombuffer(b, "<f4").astype(float))
    return pd.Series([similarity(u(a), f(b), u(c), f(d)) >= SIMILAR - 1e-9 for a, b, c, d in zip(h1, w1, h2, w2, strict=True)], dtype=bool)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    one = sets.select(F.col("node").alias("a"), F.col("h").alias("h1"), F.col("w").alias("w1"))
    two = sets.select(F.col("node").alias("b"), F.col("h").alias("h2"), F.col("w").alias("w2"))
    return pairs.join(one, "a").join(two, "b").filter(similar("h1", "w1", "h2", "w2")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in an edge; the label is the smallest node of its component."""
    both = write_table(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")), "links")
    labels = write_table(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("near"), F.col("label").alias("got"))
        least = both.join(seen, "near").groupBy("node").agg(F.min("got").alias("got"))
        step = labels.join(least, "node").select("node", "label", F.least("label", "got").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = write_table(step.join(jump, "next").select("node", "label", F.least("next", "far").alias("new")), "labels")
        done = moved.filter("new < label").isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if done:
            return labels


def compare_blocks(rows: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between different components that share a bucket, found block by block.

    rows: (key, node, label, prints); members: (key, n).  A bucket of n members is dealt into ceil(n / BLOCK) parts by a
    hash of the node; each pair of parts is one small group, so no task ever holds more than two parts.  A first pass over
    fingerprints keeps the members that may have a partner in their group; a second one compares those members' sets
    where they stand.  Only links leave a group, and none between components it has already joined.
    """
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = rows.join(members, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("key", "node", "label", "prints", "part", other.alias("with"))
    dealt = dealt.withColumn("p", F.least("part", "with")).withColumn("q", F.greatest("part", "with")).drop("with")

    def partners(pdf: pd.DataFrame):
        """Per row the later rows of the group that may be similar to it."""
        label, x, part = pdf["label"].to_numpy(), _prints(pdf["prints"]), pdf["part"].to_numpy()
        two = len(np.unique(part)) > 1
        for i in range(len(pdf)):
            ok = ((x[i] == x[i + 1 :]).sum(1) >= MIN_AGREE) & (label[i + 1 :] != label[i])
            if two:
                ok &= part[i + 1 :] != part[i]
            yield i, np.flatnonzero(ok) + i + 1

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(len(pdf), bool)
        for i, near in partners(pdf):
            held[near] = True
            held[i] |= len(near) > 0
        return pdf[held]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].tolist()
        own = [(np.frombuffer(h, "<u8"), np.frombuffer(w, "<f4").astype(float)) for h, w in zip(pdf["h"], pdf["w"], strict=True)]
        root = {v: v for v in pdf["label"]}
        labels = pdf["label"].tolist()
        size = [float(w.sum()) for _, w in own]

        def find(v):
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        found = []
        for i, near in partners(pdf):
            for j in near.tolist():
                a, b = find(labels[i]), find(labels[j])
                if min(size[i], size[j]) < (SIMILAR - 1e-9) * max(size[i], size[j]):
                    continue  # too unlike in size to reach it
                if a != b and similarity(*own[i], *own[j]) >= SIMILAR - 1e-9:
                    root[a] = b
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    some = dealt.groupBy("key", "p", "q").applyInPandas(narrow, dealt.schema).join(sets, "node")
    return some.groupBy("key", "p", "q").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept, digest (SHA-256 of the text)."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):  # every job of the search runs here; only plain joins are left
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(F.col(text_col))
    rows = write_table(
        docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("tag"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                    F.octet_length(text).alias("size")),
        "near-rows",
    )
    total = rows.count()
    texts = write_table(
        rows.groupBy("digest").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    n_texts, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    distinct = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    if n_texts < total:
        distinct = exact_dedup.exact_dedup(distinct)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_batch = max(1, min(BATCH_BYTES * n_texts // max(size, 1), n_texts // (2 * tasks)))
    distinct = distinct.select(
        F.floor(F.monotonically_increasing_id() / F.lit(per_batch)).alias("batch"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text"
    )
    distinct = write_buckets(distinct, "distinct", "batch", max(tasks, math.ceil(size / BUCKET_BYTES)))
    ranges = Ranges(max(tasks, math.ceil(size / RANGE_TEXT)))
    told = texts_with(distinct, ranges)

    def sign(batch: pa.Table, told: pa.Table) -> pa.Table:
        sets = all_shingles(batch["text"])
        weights = weights_of(np.unique(np.concatenate([h for h, _ in sets])), told, ranges, n_texts)
        held = [weights.held(h) for h, _ in sets]
        some = [k for k, (h, _) in enumerate(sets) if len(h)]
        prints, ends = [np.zeros((0, SAMPLES), np.uint32)], np.cumsum([len(sets[k][0]) for k in some]) // SIGN_SHINGLES
        for own in np.split(np.array(some, np.int64), np.flatnonzero(np.diff(ends)) + 1):
            if len(own):
                prints.append(sample([(sets[k][0], weigh(sets[k][1], *held[k], n_texts)) for k in own.tolist()]))
        prints = np.concatenate(prints)
        short = prints.astype(np.uint16)
        return pa.Table.from_arrays(
            [batch["digest"].take(pa.array(some, pa.int64())), pa.array(list(band_keys(prints)), pa.list_(pa.int64())), pa.array([p.tobytes() for p in short], pa.binary()),
             pa.array([np.packbits(held[k][0]).tobytes() for k in some], pa.binary()), pa.array([held[k][1].astype("<u4").tobytes() for k in some], pa.binary())],
            names=["digest", "bands", "prints", "common", "held"],
        )

    signed = distinct.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(sign, "digest binary, bands array<long>, prints binary, common binary, held binary")
    signatures = write_table(signed.join(texts.select("digest", "node"), "digest"), "signatures", "zstd")
    members = signatures.select("node", F.explode("bands").alias("key"))
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("r"), F.col("node").alias("v")))["v"].alias(f"p{k}") for k in range(4)]
    buckets = write_table(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *pivots).filter("n > 1"), "buckets")
    shared = write_table(join_groups(members, buckets, "key", "n", total), "bucket-members")

    prints = signatures.select("node", "prints")
    first = shared.filter("node <> p0").select("node", F.col("p0").alias("pivot"), "p1", "p2", "p3").distinct()
    p_side = prints.select(F.col("node").alias("pivot"), F.col("prints").alias("theirs"))
    tried = first.join(prints, "node").join(p_side, "pivot").withColumn("sure", surely_agree("prints", "theirs"))
    tried = write_table(tried.withColumn("may", F.col("sure") | may_agree("prints", "theirs")).drop("theirs"), "tried")
    more = tried.filter(~F.col("sure")).select("node", "prints", F.explode(F.array("p1", "p2", "p3")).alias("pivot")).filter("node <> pivot").distinct()
    more = more.join(p_side, "pivot").filter(may_agree("prints", "theirs"))
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = write_table(ordered(tried.filter("may"), "node", "pivot").union(ordered(more, "node", "pivot")).distinct(), "pairs")

    # Weighted sets of every text that shares a bucket, made once for both verifications.
    wanted = signatures.join(shared.select("node").distinct(), "node", "left_semi").select("node", "digest", "common", "held")
    picked = distinct.select("digest", "text").join(wanted, "digest").select("node", "text", "common", "held")

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                h, w = [], []
                for (own, n), common, held in zip(shingles(batch.column(1)[a:b]), *(batch.column(k)[a:b].to_pylist() for k in (2, 3)), strict=True):
                    hit = np.unpackbits(np.frombuffer(common, np.uint8), count=len(own)).astype(bool)
                    h.append(own.astype("<u8").tobytes())
                    w.append(weigh(n, hit, np.frombuffer(held, "<u4").astype(float), n_texts).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(h, pa.binary()), pa.array(w, pa.binary())], names=["node", "h", "w"])

    sets = write_table(picked.mapInArrow(weighted, "node long, h binary, w binary"), "sets")
    links = write_table(verify(pairs, sets), "verified")
    found = components(links)

    label = F.coalesce(F.col("label"), F.col("node"))
    labelled = shared.select("key", "node").join(found, "node", "left").select("key", "node", label.alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("key", "n")
    open_keys = write_table(open_keys, "open-buckets")
    rest = write_table(labelled.join(open_keys.select("key"), "key", "left_semi").join(prints, "node"), "open-members")
    extra = write_table(compare_blocks(rest, open_keys, sets), "verified-late")
    if not extra.isEmpty():
        found = components(links.union(extra))

    full = texts.join(found, "node", "left").withColumn("label", label)
    named = full.groupBy("label").agg(F.min("first").alias("keep"), F.sum("n").alias("class_size"))
    classes = write_table(full.join(named, "label").select("digest", "n", "keep", "class_size"), "classes")
    return join_groups(rows, classes, "digest", "n", total).select(
        "doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", (F.col("tag") == F.col("keep.tag")).alias("kept"),
        "digest",
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate class, with all its columns."""
    digest, kept_id, kept_digest = fresh(docs.columns, "digest", "kept_id", "kept_digest")
    found = near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    kept = found.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest))
    rows = docs.select(*every(docs), F.unhex(F.sha2(text_of(F.col(text_col)).cast("binary"), 256)).alias(digest))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest))
    # Rows that repeat both id and text are one.
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, digest]).select(*every(docs))
