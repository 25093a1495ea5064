"""Whole-text encoding with a public word-BPE tokenizer, one library call per batch of new words.

The tokenizer's pre-tokenizer never joins text across a space or line feed, so a text's ids are the ids of its chunks in
order.  Each distinct part of a chunk is encoded once by the library and remembered (the memory is bounded), which makes
encoding several times cheaper than passing every repetition through it.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
CACHE_UNITS = 400_000

#: A chunk of Latin letters and what may follow it.  The pre-tokenizer always cuts behind a run of letters and the
#: normalizer lower-cases, so the two parts are encoded alone, and letters once for all their cases and endings.
LETTERS = "^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[.,!?;:*$%&#|]*)$"
WORD_END = "</w>"  # fixed value: how the vocabulary marks the last piece of a word
GROUP = 256  # letter runs that one library call encodes as one text


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all spans in order."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class ChunkEncoder:
    """Encodes lists of texts to one flat id array plus lengths.

    A chunk is one or two units (letters, ending); a unit's ids are a slice of ``flat``.  When more than ``limit`` units
    are known, those met in one block only are forgotten.
    """

    def __init__(self, path: str, limit: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for piece, i in vocab.items() if piece.endswith(WORD_END)]] = True
        self.units: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)  # blocks that held the unit
        self.flat = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Drop the units met once, or all where that leaves too many."""
        often = self.met > 1
        if often.sum() > self.limit // 2:
            often[:] = False
        starts, sizes = self.starts[often], self.sizes[often]
        self.flat = self.flat[_spans(starts, sizes)]
        names = [u for u, k in zip(self.units, often.tolist(), strict=True) if k]  # a dict keeps the order of its numbers
        self.units = dict(zip(names, range(len(names)), strict=True))
        self.starts, self.sizes, self.met = np.cumsum(sizes) - sizes, sizes, np.ones(len(names), np.int64)

    def _learn(self, runs: list[str], odd: list[str]) -> None:
        """Encode new units; runs of letters go to the library in groups and are told apart by their last pieces."""
        ids: list[int] = []
        for e in self.tokenizer.encode_batch_fast([" ".join(runs[i : i + GROUP]) for i in range(0, len(runs), GROUP)], add_special_tokens=False):
            ids += e.ids
        ends = np.flatnonzero(self.is_end[np.asarray(ids, np.int64)])
        if len(ends) != len(runs):
            raise ValueError("the tokenizer does not end every run of letters with a word-end piece")
        sizes = [np.diff(ends, prepend=-1)]
        if odd:
            alone = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
            ids += chain.from_iterable(alone)
        size = np.concatenate(sizes)
        self.units.update(zip(chain(runs, odd), count(len(self.units))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
        self.sizes = np.concatenate([self.sizes, size])
        self.met = np.concatenate([self.met, np.zeros(len(size), np.int64)])
        self.flat = np.concatenate([self.flat, np.asarray(ids, np.uint32)])

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """(chunk, 2) unit numbers; -1 where a chunk has one unit."""
        found = pc.extract_regex(chunks, LETTERS)
        plain = pc.is_valid(found)
        run, rest = (pc.if_else(plain, found.field(k), None) for k in ("run", "rest"))
        run_of, rest_of = pc.utf8_lower(run).dictionary_encode(), rest.dictionary_encode()
        other = pc.if_else(plain, None, chunks).dictionary_encode()
        kinds = [run_of, rest_of, other]
        names = [k.dictionary.to_numpy(zero_copy_only=False) for k in kinds]
        get = self.units.get
        known = [np.fromiter(map(get, n, repeat(-1)), np.int64, len(n)) for n in names]
        new = [n[k < 0].tolist() for n, k in zip(names, known, strict=True)]
        if any(new):
            base = len(self.units)
            self._learn(new[0], list(dict.fromkeys(new[1] + new[2])))
            known[0][known[0] < 0] = base + np.arange(len(new[0]))
            known[1:] = [np.fromiter(map(get, n, repeat(-1)), np.int64, len(n)) for n in names[1:]]
        for k in known:
            self.met[k[k >= 0]] += 1
        pairs = np.full((len(chunks), 2), -1, np.int64)
        for column, coded, number in zip((0, 1, 0), kinds, known, strict=True):
            at = coded.indices
            some = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            pairs[some, column] = number[at.drop_null().to_numpy()]
        return pairs

    def encode(self, texts: Sequence[str | None] | pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, ids per text), each text followed by ``end_id`` unless that is None; null is empty."""
        if len(self.units) > self.limit:
            self._forget()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        # The ids of the block's distinct chunks, then of all chunks.
        parts = self._numbers(coded.dictionary)
        size = np.append(self.sizes, 0)[parts]  # no unit has no ids
        own = size.sum(1)
        ids = self.flat[_spans(np.append(self.starts, 0)[parts].ravel(), size.ravel())]
        at = coded.indices.to_numpy()
        n_ids = own[at]
        ends = np.concatenate([[0], np.cumsum(n_ids)])
        edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        lengths = ends[edges[1:]] - ends[edges[:-1]]
        flat = ids[_spans((np.cumsum(own) - own)[at], n_ids)]
        if end_id is None:
            return flat, lengths
        out = np.full(len(flat) + len(texts), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(lengths + 1) - 1] = False
        out[keep] = flat
        return out, lengths + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker, kept between tasks."""
    return ChunkEncoder(path)


def blocks(texts: pa.Array, size: int = 4_000_000):
    """Slices of at most ``size`` bytes (at least one text each), so that memory stays bounded."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, stop
        start = stop
