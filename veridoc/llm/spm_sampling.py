"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The segmentations of a text form a lattice; a piece's log-probability follows Zipf's law in its rank in the vocabulary
file.  With the lattice's backward masses as exact bounds, a perturbed best-first (A*) search needs no wasted step: the
first path is drawn piece by piece, every decision leaves behind the group of its other choices with one truncated
Gumbel value for the whole group, and the next sample starts from the best group of all.  This yields SAMPLES distinct
segmentations in descending perturbed order, with inclusion scores 1 - exp(-exp(log p - kappa)), kappa being the value of
the next best group.  All random numbers are hashes of the row key, so a rerun repeats them.

The text is cut into words in front of each run of space marks, which no piece crosses, and a word into chunks between
two bytes that no piece holds side by side.  Lattices are made per distinct chunk and the most used ones are kept; the
words of many documents are walked in lockstep, from chunk to chunk.

Defined cases: null and empty texts have one segmentation, without pieces, of log-probability 0; a text with fewer than
SAMPLES segmentations gives them all with inclusion 1; characters outside the vocabulary become byte pieces; repeated
rows draw alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import blocks
from .weighted_minhash import mix

SAMPLES = 3
MARK = "▁"  # stands for a space
ZIPF_SHIFT = 2.7
CHUNK_CACHE = 120_000  # chunks whose lattices a worker holds at most between two blocks, some 100 MB
LEAST_WAIT = -37.0  # below the log of the least waiting time that a 53-bit number stands for
FAR = -45.0  # log-probability of a path's beginning from which its groups are drawn only if they are needed
MASK = (1 << 64) - 1
RESULT = "doc_id long, sample int, log_prob double, perturbed double, inclusion double, n_pieces long, ids_crc32 long, ids binary, decoded_ok boolean"


def normalized(text: str | None) -> str:
    """The text as the vocabulary sees it: spaces become marks, one mark in front."""
    return MARK + text.replace(" ", MARK) if text else ""


def extend(h: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Hash of a string one character longer."""
    return mix(h * np.uint64(31) + point + np.uint64(1))


def added(held: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``held`` with ``new`` behind it, in place where the array that it begins has room."""
    n, room = len(held) + len(new), held.base
    if room is None or len(room) < n:
        room = np.empty(n + n // 4, held.dtype)
        room[: len(held)] = held
    room[len(held) : n] = new
    return room[:n]


class Lattices:
    """Lattices of distinct chunks, in flat arrays.

    A node is a place in a chunk; its edges are pieces with conditional log-probabilities ``log_q`` and upper ends ``cum`` of
    their shares.  None of these numbers depends on which other chunks are held.
    """

    def __init__(self, path: str, limit: int = CHUNK_CACHE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte = [i for i in range(size) if model.is_byte(i)]
        weight = {i: 1 / (k + ZIPF_SHIFT) for k, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)) + byte)}
        norm = math.log(sum(weight.values()))
        self.log_ps = np.full(size, -np.inf)
        for i, w in weight.items():
            self.log_ps[i] = math.log(w) - norm
        self.piece = {model.id_to_piece(i): i for i in normal}
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in byte}
        self.longest = max(map(len, self.piece))
        sizes = np.fromiter(map(len, self.piece), np.int64, len(self.piece))
        points = np.frombuffer("".join(self.piece).encode("utf-32-le"), np.uint32).astype(np.uint64)
        start, own = np.cumsum(sizes) - sizes, np.fromiter(self.piece.values(), np.int64, len(sizes))
        at, h, found = np.arange(len(sizes)), np.zeros(len(sizes), np.uint64), []
        for b in range(1, self.longest + 1):
            h = extend(h, points[start[at] + b - 1])
            found.append((h, np.where(sizes[at] == b, own[at], -1)))
            at, h = at[sizes[at] > b], h[sizes[at] > b]
        h, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h)
        self.prefix, at = np.unique(h[order], return_index=True)
        self.prefix_id = np.maximum.reduceat(ids[order], at)
        at = np.searchsorted(self.prefix, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))  # by the first 20 bits
        self.fullest = int(np.diff(np.append(at, len(self.prefix))).max())
        self.prefix = np.append(self.prefix, np.zeros(self.fullest, np.uint64))
        self.prefix_id = np.append(self.prefix_id, np.full(self.fullest, -1))
        self.bucket = at
        self.raw = [b""] * size
        for i in normal:
            self.raw[i] = model.id_to_piece(i).encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.bytes = pa.array(self.raw, pa.large_binary())
        self.cut = np.ones((256, 256), bool)  # pairs of bytes with a chunk's end between them
        for i in normal:
            text = np.frombuffer(self.raw[i], np.uint8)
            self.cut[text[:-1], text[1:]] = False
        self.cut[:, 0x80:0xC0] = False  # these bytes continue a character
        self.cut = self.cut.ravel()
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.chunk: dict[bytes, int] = {}
        self.used = np.zeros(0)  # how often a chunk was met, older uses counting less
        self.start = np.zeros(1, np.int64)  # first node of a chunk, and the number of nodes
        self.first = np.zeros(1, np.int64)  # first edge of a node
        self.log_q, self.cum = np.zeros(0), np.zeros(0)
        self.to = np.zeros(0, np.int32)  # node an edge leads to; -1 at the chunk's end
        self.id0, self.n_ids = np.zeros(0, np.int32), np.zeros(0, np.int16)
        self.ids = np.zeros(0, np.uint32)

    def split(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Chunks of normalized texts, the first chunk of every word, the first word of every text (and the numbers of all)."""
        data = np.frombuffer(b"".join(texts) + b"\0\0", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.append(0, ends)  # the last one is the end of all
        mark = np.flatnonzero(data == MARK.encode()[0])
        mark = mark[(data[mark + 1] == MARK.encode()[1]) & (data[mark + 2] == MARK.encode()[2])]
        word = np.zeros(len(data) - 1, bool)
        word[mark[np.diff(mark, prepend=-3) != 3]] = True
        word[begins] = True
        cut = word.copy()
        cut[1:] |= self.cut[(data[:-2].astype(np.uint16) << 8) | data[1:-1]]
        place, words = np.flatnonzero(cut), np.flatnonzero(word)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(place) - 1, [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data)])
        return chunks, np.searchsorted(place, words), np.searchsorted(words, begins)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``split`` with the chunks' numbers; new chunks are learnt, and only then may seldom used ones go."""
        if len(self.chunk) > self.limit:
            self.shrink()
        chunks, word, text = self.split(texts)
        coded = chunks.dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.learn([c for c in names if c not in self.chunk])
        number = np.fromiter(map(self.chunk.__getitem__, names), np.int64, len(names))
        self.used[number] += np.bincount(at, minlength=len(names))
        return number[at], word, text

    def shrink(self) -> None:
        """Forget all but the half of ``limit`` chunks used most."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        names = list(self.chunk)
        self.chunk = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.used = self.used[keep] / 2
        node, at = ranges(self.start[keep], self.start[keep + 1])
        edge, place = ranges(self.first[node], self.first[node + 1])
        ids, n_ids = self.spell(edge), self.n_ids[edge]
        moved = np.full(self.start[-1] + 1, -1, self.to.dtype)  # an edge to -1 reads the last entry
        moved[node] = np.arange(len(node))
        self.start, self.first, self.to = at, place, moved[self.to[edge]]
        self.log_q, self.cum = self.log_q[edge], self.cum[edge]
        self.ids, self.n_ids, self.id0 = ids, n_ids, (np.cumsum(n_ids, dtype=np.int32) - n_ids).astype(np.int32)

    def _edges(self, points: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id, rank at its place) of every piece found; lengths grow together and stop where no piece has the
        prefix.  Every place has one edge of length 1: where no piece is, bytes, with id -1."""
        at = np.arange(len(points))
        h = np.zeros(len(points), np.uint64)
        met = np.zeros(len(points), np.int64)
        found = []
        for b in range(1, self.longest + 1):
            h = extend(h, points[at + b - 1])
            k = self.bucket[h >> np.uint64(44)]
            live = self.prefix[k] == h
            for _ in range(self.fullest - 1):
                k += ~live
                live |= self.prefix[k] == h
            ids = np.where(live, self.prefix_id[k], -1)
            hit = np.flatnonzero((ids >= 0) | (b == 1))
            place = at[hit]
            found.append((place, np.full(len(hit), b), ids[hit], met[place]))
            met[place] += 1
            live = np.flatnonzero(live & (at + b < end[at]))
            at, h = at[live], h[live]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def learn(self, chunks: list[bytes]) -> None:
        """Add the lattices of new chunks, all at once."""
        if not chunks:
            return
        joined = b"".join(chunks)
        points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum([0, *map(len, chunks[:-1])])
        sizes = np.add.reduceat((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80, starts, dtype=np.int64)  # in characters
        m, base, held = len(points), len(self.first) - 1, len(self.ids)
        ends = np.cumsum(sizes)
        end = np.repeat(ends, sizes)
        place, length, ids, rank = self._edges(points, end)
        n_edges = np.bincount(place, minlength=m)
        cut = np.cumsum(n_edges) - n_edges
        order = np.empty(len(place), np.int64)
        order[cut[place] + rank] = np.arange(len(place))  # by place, lengths ascending
        place, length, ids = place[order], length[order], ids[order]
        log_p, n_ids = self.log_ps[ids], np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)  # characters outside the vocabulary: one edge of byte pieces
        if len(bare):
            spelled = [[self.byte[x] for x in chr(c).encode("utf-8", "surrogatepass")] for c in points[place[bare]].tolist()]
            log_p[bare], n_ids[bare] = [sum(self.log_ps[i] for i in w) for w in spelled], list(map(len, spelled))
            ids = np.repeat(ids, n_ids)
            ids[ids < 0] = [i for w in spelled for i in w]
        id0 = held + np.cumsum(n_ids) - n_ids
        to = place + length
        last = to == end[place]
        # Backward masses, from each chunk's end: nodes at the same distance together.
        far = (end - np.arange(m))[place]
        order = np.argsort(far.astype(np.min_scalar_type(int(sizes.max()))), kind="stable")  # short numbers sort by radix
        mass = np.zeros(m + 1)
        target = np.where(last, m, to)
        steps = np.searchsorted(far[order], np.arange(1, int(sizes.max()) + 2))
        for x, y in zip(steps[:-1], steps[1:], strict=True):
            own = order[x:y]
            value = log_p[own] + mass[target[own]]
            node = np.flatnonzero(np.diff(place[own], prepend=-1))
            top = np.maximum.reduceat(value, node)
            size = np.diff(np.append(node, len(own)))
            mass[place[own[node]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), node))
        log_q = log_p + mass[target] - mass[place]
        stop = cut + n_edges
        cum = np.exp(log_q)
        at = cut + 1
        while len(at := at[at < stop[place[at - 1]]]):  # sums within a node, all nodes in step
            cum[at] += cum[at - 1]
            at = at + 1
        cum[stop - 1] = 1.0
        self.chunk.update(zip(chunks, range(len(self.chunk), len(self.chunk) + len(chunks)), strict=True))
        edges = self.first[-1]
        self.used = added(self.used, np.zeros(len(chunks)))
        self.start = added(self.start, base + ends)
        self.first = added(self.first, np.append(edges + cut[1:], edges + len(place)))
        self.log_q, self.cum = added(self.log_q, log_q), added(self.cum, cum)
        self.to = added(self.to, np.where(target == m, -1, base + target))
        self.id0, self.n_ids, self.ids = added(self.id0, id0), added(self.n_ids, n_ids), added(self.ids, ids)

    def walk(self, node: np.ndarray, place: np.ndarray, stop: np.ndarray, numbers: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a segmentation of each word from its node on, which is in the chunk at ``place`` of ``numbers``; the word ends
        before ``stop``.  The edges of all words in order, and how many each word has."""
        count, place = np.zeros(len(node), np.int64), place.copy()
        word, found, step = np.arange(len(node)), [], 0
        while len(node):
            share = uniform(key, 2 * step)
            edge = self.first[node]
            open_ = np.flatnonzero(self.cum[edge] < share)
            while len(open_):  # the last edge of a node ends at 1, which no share passes
                edge[open_] += 1
                open_ = open_[self.cum[edge[open_]] < share[open_]]
            found.append((word, edge))
            node, step = self.to[edge], step + 1
            over = np.flatnonzero(node < 0)
            if len(over):
                ended = word[over]
                at = place[ended] + 1
                place[ended] = at
                more = at < stop[ended]
                node[over[more]] = self.start[numbers[at[more]]]
                count[ended[~more]] = step
                go = np.flatnonzero(node >= 0)
                word, node, key = word[go], node[go], key[go]
        first, edges = np.cumsum(count) - count, np.empty(count.sum(), np.int64)
        for step, (word, edge) in enumerate(found):
            edges[first[word] + step] = edge
        return edges, count

    def spell(self, edges: np.ndarray) -> np.ndarray:
        """Ids of a sequence of edges."""
        n = self.n_ids[edges].astype(np.int64)
        if (n == 1).all():
            return self.ids[self.id0[edges]]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.id0[edges] - ends + n, n) + np.arange(ends[-1])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        return self.spelled(ids).decode("utf-8", "surrogatepass").replace(MARK, " ").removeprefix(" ")

    def spelled(self, ids: np.ndarray) -> bytes:
        """The normalized text of ids, in UTF-8."""
        return self.spelled_each(ids)[0]

    def spelled_each(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``spelled``, and where each id begins there (and the last ends)."""
        if not len(ids):
            return b"", np.zeros(1, np.int64)
        taken = self.bytes.take(pa.array(ids))
        return taken.buffers()[2].to_pybytes(), np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and where each begins there (and the last ends)."""
    at = np.append(0, np.cumsum(stop - start))
    return np.arange(at[-1]) + np.repeat(start - at[:-1], stop - start), at


def uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(key + np.uint64(stream)) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def uniform_one(key: int, stream: int) -> float:
    """``uniform`` of a single key."""
    x = key + stream & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return ((x ^ x >> 31) >> 12) / 2.0**52 + 2.0**-53


def log_sum(x: float, y: float) -> float:
    """log(exp(x) + exp(y))."""
    top, less = max(x, y), min(x, y)
    return top if less == -math.inf or top == math.inf else top + math.log1p(math.exp(less - top))


def waiting(keys: np.ndarray, before: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log waiting times of the groups of other choices, behind log-mass ``before`` and beside an edge of ``q``."""
    return np.log(-np.log(uniform(mix(keys), 1))) - before - log_rest(q)


def log_rest(log_q: np.ndarray) -> np.ndarray:
    """log(1 - exp(log_q))."""
    with np.errstate(divide="ignore"):
        return np.where(log_q > -1e-12, -np.inf, np.log(-np.expm1(np.minimum(log_q, -1e-12))))


class _Path:
    """A drawn segmentation, and the groups of choices its decisions from ``fresh`` on left: ``waits`` are their log waiting
    times, infinite where spent.

    A waiting time is its draw less the log-mass of the group, which falls along the path.  So the groups behind FAR are
    drawn only where none before them is sure to wait less.
    """

    def __init__(self, key: int, edge: np.ndarray, value: float, log_p: float, fresh: int, waits: np.ndarray):
        self.key, self.edge, self.value, self.log_p, self.fresh, self.waits = key, edge, value, log_p, fresh, waits
        self.top: tuple[float, int] | None = None

    def best(self, lat: Lattices) -> tuple[float, int]:
        """Value and decision of the best group."""
        if self.top is None:
            near, whole = len(self.waits), len(self.edge) - self.fresh
            if near < whole and not (near and self.waits.min() < LEAST_WAIT - FAR):
                q = lat.log_q[self.edge]
                keys = np.uint64(self.key) + np.arange(self.fresh + near, len(q), dtype=np.uint64)
                self.waits = np.append(self.waits, waiting(keys, (np.cumsum(q) - q)[-len(keys) :], q[-len(keys) :]))
            d = int(self.waits.argmin()) if whole else -1
            # A group's value falls with its waiting time, so only the least one need be turned into a value.
            self.top = (-log_sum(-self.value, float(self.waits[d])), self.fresh + d) if whole else (-math.inf, 0)
        return self.top

    def spend(self, decision: int) -> None:
        self.waits[decision - self.fresh] = np.inf
        self.top = None


class _Search:
    """Best-first search over one text: complete paths, and the groups of choices they left."""

    def __init__(self, key: int):
        self.key = key
        self.paths: list[_Path] = []
        self.extra: list = []  # (value, path, decision, edges already taken)

    def next_key(self) -> int:
        """Key of the next path's groups."""
        return self.key + (len(self.paths) << 40) + (1 << 60)

    def best(self, lat: Lattices) -> tuple[float, int, int, list[int]] | None:
        """Value, path, decision and taken edges of the best group."""
        first = [path.best(lat) for path in self.paths]
        p = max(range(len(first)), key=lambda i: first[i][0])
        value, d = first[p]
        more = max(self.extra, key=lambda x: x[0], default=None)
        if more is not None and more[0] > value:
            return more
        return (value, p, d, [int(self.paths[p].edge[d])]) if value > -math.inf else None

    def take(self, lat: Lattices) -> tuple[float, np.ndarray] | None:
        """Open the best group: choose among its edges, leave the remaining ones as a group; the value and prefix of the new path."""
        got = self.best(lat)
        if got is None:
            return None
        value, p, d, taken = got
        if any(got is x for x in self.extra):
            self.extra = [x for x in self.extra if x is not got]
        else:
            self.paths[p].spend(d)
        edge = self.paths[p].edge
        node = int(np.searchsorted(lat.first, edge[d], "right")) - 1
        left = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in taken]
        q = [float(lat.log_q[e]) for e in left]
        share = [math.exp(x - max(q)) for x in q]
        key = self.key ^ len(self.paths) * 0x9E3779B97F4A7C15 & MASK
        pick, aim = 0, uniform_one(key, 3) * sum(share)
        while pick < len(left) - 1 and aim > share[pick]:
            aim -= share[pick]
            pick += 1
        if len(left) > 1:
            mass = float(lat.log_q[edge[:d]].sum()) + reduce(log_sum, q[:pick] + q[pick + 1 :])
            wait = math.log(-math.log(uniform_one(key, 5))) - mass
            self.extra.append((-log_sum(-value, wait), p, d, [*taken, left[pick]]))
        return value, np.append(edge[:d], left[pick])


def sample_texts(texts: list[str], keys: list[int], lat: Lattices, k: int = SAMPLES) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """Per normalized text: (log p, value, inclusion, edges) of up to k distinct segmentations, best first."""
    numbers, chunk0, word0 = lat.numbers([t.encode("utf-8", "surrogatepass") for t in texts])
    searches = [_Search(key & (1 << 59) - 1) for key in keys]
    none = np.zeros(0, np.int64)
    for turn in range(k):
        jobs = []  # (text, value, decisions kept, node and chunk to go on from or -1, word)
        for i, s in enumerate(searches):
            if not turn:
                jobs.append((i, -math.log(-math.log(uniform_one(s.key, 7))), none, -1, -1, int(word0[i])))
                continue
            got = s.take(lat)
            if got is None:
                continue
            value, edge = got
            node, passed = int(lat.to[edge[-1]]), int((lat.to[edge] < 0).sum())
            chunk = int(chunk0[word0[i]]) + passed
            word = int(np.searchsorted(chunk0, chunk, "right")) - 1
            if node < 0 and chunk0[word] < chunk:  # at the end of a chunk, within a word
                node = int(lat.start[numbers[chunk]])
            jobs.append((i, value, edge, node, chunk, word))
        if not jobs:
            break
        text = np.array([j[0] for j in jobs])
        first = np.array([j[5] for j in jobs])
        word, at = ranges(first, word0[text + 1])
        place = chunk0[word]
        node = lat.start[numbers[place]]
        for (_, _, _, on, chunk, _), a in zip(jobs, at[:-1].tolist(), strict=True):
            if on >= 0:
                node[a], place[a] = on, chunk
        seeds = mix(np.array([(searches[i].key << 4) + turn + 1 for i in text.tolist()], np.uint64))
        sizes = np.diff(at)
        number = (word - np.repeat(word0[text], sizes)).astype(np.uint64)
        key = mix(np.repeat(seeds, sizes) + number * np.uint64(0x9E3779B97F4A7C15))
        edges, count = lat.walk(node, place, chunk0[word + 1], numbers, key)
        cuts = np.append(0, np.cumsum(count))[at]
        # The groups of the new decisions, those of all paths together as far as they are near.
        q = lat.log_q[edges]
        held = np.array([lat.log_q[j[2]].sum() for j in jobs])
        before = np.append(0.0, np.cumsum(q))
        before = before[:-1] + np.repeat(held - before[cuts[:-1]], np.diff(cuts))
        far = np.append(np.flatnonzero(before <= FAR), len(q))
        near, reach = ranges(cuts[:-1], np.minimum(cuts[1:], far[np.searchsorted(far, cuts[:-1])]))
        starts = np.array([searches[j[0]].next_key() + len(j[2]) for j in jobs], np.uint64)
        keys = np.repeat(starts, np.diff(reach)) + (near - np.repeat(cuts[:-1], np.diff(reach))).astype(np.uint64)
        waits = waiting(keys, before[near], q[near])
        for j, (i, value, kept, *_) in enumerate(jobs):
            a, b = int(cuts[j]), int(cuts[j + 1])
            edge, log_p, s = np.concatenate([kept, edges[a:b]]), float(held[j] + q[a:b].sum()), searches[i]
            s.paths.append(_Path(s.next_key(), edge, value, log_p, len(kept), waits[reach[j] : reach[j + 1]]))
    out = []
    for s in searches:
        after = s.best(lat)
        kappa = after[0] if after else -math.inf
        out.append([(x.log_p, x.value, -math.expm1(-math.exp(min(x.log_p - kappa, 50.0))) if after else 1.0, x.edge) for x in s.paths])
    return out


def sample_table(ids: list, texts: list[str], keys: list[int], lat: Lattices, k: int = SAMPLES) -> pa.RecordBatch:
    """The rows of RESULT for normalized texts."""
    drawn = sample_texts(texts, keys, lat, k)
    rows = [(doc, n, *scores, text.encode("utf-8", "surrogatepass")) for doc, text, found in zip(ids, texts, drawn, strict=True) for n, (*scores, _) in enumerate(found, 1)]
    edges = [edge for found in drawn for *_, edge in found]
    ends = np.cumsum([len(e) for e in edges])
    every = np.concatenate([np.zeros(0, np.int64), *edges])
    flat = lat.spell(every).astype("<u4") if len(every) else np.zeros(0, "<u4")
    at = np.append(0, np.append(0, np.cumsum(lat.n_ids[every], dtype=np.int64))[ends])
    plain, byte = lat.spelled_each(flat)
    raw, cuts, places = flat.tobytes(), at.tolist(), byte[at].tolist()
    raws = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    same = [plain[a:b] == row[-1] for a, b, row in zip(places[:-1], places[1:], rows, strict=True)]
    doc, n, log_p, value, inclusion, _ = zip(*rows, strict=True)
    columns = (doc, n, log_p, value, inclusion, np.diff(at), list(map(zlib.crc32, raws)), raws, same)
    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


@lru_cache(maxsize=1)
def lattices(path: str) -> Lattices:
    """One set of lattices per Python worker."""
    return Lattices(path)


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and sample (from 1): scores, ids as little-endian unsigned 32-bit binary, and whether they
    decode to the text."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model)
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(batch.column(2), 800_000):
                texts = [normalized(t) for t in batch.column(2)[a:b].to_pylist()]
                yield sample_table(ids[a:b], texts, keys[a:b], lat, k)

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.lit(13)).alias("key"), F.col(text_col).alias("text"))
    return source.mapInArrow(draw, RESULT)
