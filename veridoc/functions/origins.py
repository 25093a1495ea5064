"""Normalised text together with the place that each of its characters came from, through compatibility composition.

Composition joins a letter with what follows it, so a text is read in runs: a character and all that may combine with it.
Runs are composed, folded and lower-cased one by one, each remembered, and every character keeps the run it came from.
Python has the composition tables that Spark lacks; texts go there in Arrow batches.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import fixed_values as V

MARKS = re.compile(V.DIACRITICS + "|ـ")
TRAIL = re.compile(f"(?:{V.DIACRITICS}|ـ)*")
FOLD = str.maketrans(V.FOLD_FROM + V.DIGITS_FROM, V.FOLD_TO + V.DIGITS_TO)


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that may combine with the one before: marks, and the second halves of composed characters."""
    second = {ord(unicodedata.normalize("NFD", chr(c))[-1]) for c in range(0xAC00, 0xAC00 + 588)}  # Hangul vowels and finals come as a rule
    second |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            second.add(int(parts[1], 16))
    joins = []
    for c in range(sys.maxunicode + 1):
        first = ord(unicodedata.normalize("NFKD", chr(c))[0]) if c not in second and unicodedata.decomposition(chr(c)) else c
        if first in second or unicodedata.combining(chr(first)):
            joins.append(chr(c))
    return frozenset(joins)


@lru_cache(maxsize=1)
def run_pattern() -> re.Pattern:
    """A character and all behind it that may combine with it."""
    return re.compile(f"(?s:.[{''.join(map(re.escape, sorted(joining())))}]*)")


@lru_cache(maxsize=1 << 16)
def plain(run: str) -> str:
    """A run composed and folded, not yet in lower case."""
    for source, target in V.LIGATURES.items():
        run = run.replace(source, target)
    return MARKS.sub("", unicodedata.normalize("NFKC", run)).translate(FOLD)


class OneByOne(dict):
    """For ``str.translate``: a character to its folded form if that is one character and joins no other, else to nothing."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        own = c if code < 128 else "" if c in joining() else plain(c)
        self[code] = own if len(own) == 1 and len(own.lower()) == 1 else ""
        return self[code]


ONE_BY_ONE = OneByOne()


def letters_of(text: str) -> str | None:
    """The folded lower-case text where each character stands for the one in its place, else null."""
    if text.isascii():
        return text.lower()
    shown = text.translate(ONE_BY_ONE)
    if len(shown) != len(text):
        return None
    letters = shown.lower()
    return letters if len(letters) == len(text) else None


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """(folded lower-case text, start of the run of each of its characters, end of that run)."""
    found, start, stop = [], [], []
    for m in run_pattern().finditer(text):
        own = plain(m.group())
        found.append(own)
        start += [m.start()] * len(own)
        stop += [m.end()] * len(own)
    shown = "".join(found)
    letters = shown.lower()
    if len(letters) != len(shown):  # a capital that becomes two characters
        sizes = [len(c.lower()) for c in shown]
        start = [s for s, n in zip(start, sizes, strict=True) for _ in range(n)]
        stop = [s for s, n in zip(stop, sizes, strict=True) for _ in range(n)]
    return letters, start, stop


def words_of(letters: str) -> tuple[list[str], list[int]]:
    """Words of a folded text and where they start."""
    words, places = [], []
    for m in re.finditer(r"\w+", letters):
        word = m.group()
        if word.isascii() or word.isalnum() or all(c == "_" or c.isalnum() for c in word):
            words.append(word)
            places.append(m.start())
        else:
            for part in re.finditer(r"[^ ]+", "".join(c if c == "_" or c.isalnum() else " " for c in word)):
                words.append(part.group())
                places.append(m.start() + part.start())
    return words, places


class Normal:
    """A text normalised: ``norm``, and for a place in it the start and end of the run of the text that it came from.

    Only the starts of words are kept; where runs are longer than a character their bounds are kept too.
    """

    def __init__(self, text: str):
        letters = letters_of(text)
        self.start = self.stop = None
        if letters is None:
            letters, self.start, self.stop = folded(text)
        words, self.places = words_of(letters)
        self.norm = " ".join(words)
        self.offsets = list(accumulate((len(w) + 1 for w in words[:-1]), initial=0)) if words else []
        self.sizes = [len(w) for w in words]

    def place(self, at: int) -> int:
        """Place in the folded text; of a space the one behind the word before it."""
        k = bisect_right(self.offsets, at) - 1
        return self.places[k] + at - self.offsets[k]

    def begin(self, at: int) -> int:
        return self.start[self.place(at)] if self.start is not None else self.place(at)

    def end(self, at: int) -> int:
        return self.stop[self.place(at)] if self.stop is not None else self.place(at) + 1


def with_origins(text: str) -> tuple[str, list[int], list[int]]:
    """(normalised text, start of the run of each of its characters, end of that run)."""
    n = Normal(text)
    spots = []
    for place, size in zip(n.places, n.sizes, strict=True):
        spots += range(place, place + size + 1)  # the one behind the word is the space's
    spots = spots[:-1]
    if n.start is None:
        return n.norm, spots, [s + 1 for s in spots]
    return n.norm, [n.start[s] for s in spots], [n.stop[s] for s in spots]


@F.pandas_udf(StructType([StructField("norm", StringType()), StructField("origin", ArrayType(IntegerType()))]))
def normalize_with_map(texts: pd.Series) -> pd.DataFrame:
    """Struct of the normalised text and, for each of its characters, the place (from 0) of the run it came from; null is empty."""
    found = [with_origins(t or "") for t in texts]
    return pd.DataFrame({"norm": [f[0] for f in found], "origin": [f[1] for f in found]})


def cut_wanted(haystack: str, held: Normal, wanted: str) -> str | None:
    """The haystack's first wording that normalises to ``wanted``, with the marks that trail it."""
    at = held.norm.find(wanted) if wanted else -1
    return haystack[held.begin(at) : TRAIL.match(haystack, held.end(at + len(wanted) - 1)).end()] if at >= 0 else None


def cut_verbatim(haystack: str | None, needle: str | None) -> str | None:
    """The haystack's first wording that equals the needle once both are normalised, with the marks that trail it."""
    return cut_wanted(haystack, Normal(haystack), Normal(needle).norm) if haystack and needle else None


def cut_each(haystack: str | None, needles) -> list[str]:
    """``cut_verbatim`` of those needles that the haystack holds; it is normalised once for all of them."""
    if not haystack or needles is None or not len(needles):
        return []
    held = Normal(haystack)
    return [f for n in needles if n and (f := cut_wanted(haystack, held, Normal(n).norm))]


@F.pandas_udf(StringType())
def locate_verbatim(haystacks: pd.Series, needles: pd.Series) -> pd.Series:
    """``cut_verbatim`` of each pair, alike at every length; null without a match or needle."""
    return pd.Series([cut_verbatim(h, n) for h, n in zip(haystacks, needles, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def locate_each(haystacks: pd.Series, needles: pd.Series) -> pd.Series:
    """The wordings of those of a text's needles that it holds, in their order."""
    return pd.Series([cut_each(h, ns) for h, ns in zip(haystacks, needles, strict=True)], dtype=object)
