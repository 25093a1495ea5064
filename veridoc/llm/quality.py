"""Quality rules whose cutoffs are certified on labelled documents.

Base rules are fixed.  Beyond them a document is rejected when its junk score, the largest of several ratios each
divided by its customary limit, reaches the cutoff of its stratum (its language).  Cutoffs are chosen from a fixed
descending list per stratum: going from lenient to strict, a cutoff is certified while the exact (Clopper-Pearson)
upper bound on the false-rejection rate of labelled good documents stays within MAX_FALSE_REJECTION.  Testing stops at
the first failure, so the sequence needs no correction inside a stratum; across strata the error is divided evenly
(Bonferroni); every stratum with labels is certified on its own.  With probability CONFIDENCE no stratum exceeds the limit.  Among certified cutoffs the one that best
separates the labelled classes is used; a stratum with none, or without labels, keeps every document that passes the base rules.

Defined cases: null and empty texts have no word and fail the base rule; very long texts are measured whole; a null stratum
is its own; labels without a known quality, and rows labelled both ways, are ignored; repeated rows get equal verdicts; no
labels or an empty table certify nothing; extra columns of any name pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import every, fresh, write_table

MAX_FALSE_REJECTION = 0.02
CONFIDENCE = 0.95
BROADCAST_STRATA = 100_000  # up to so many cutoffs are broadcast, more are joined by a shuffle
#: Cutoffs of the junk score, from lenient to strict.
CUTOFFS = (8.0, 6.0, 5.0, 4.0, 3.5, 3.0, 2.5, 2.25, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters_upper", "n_bangs")
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(words: list) -> int:
    """Words covered by a window of WINDOW words that occurs at least twice in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    place: dict = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    base = len(place)
    if base == len(words):
        return 0
    code = ids[:n]
    span = base
    for k in range(1, WINDOW):
        if span > (1 << 62) // base:  # rank the codes so far, which keeps them exact
            code = np.unique(code, return_inverse=True)[1]
            span = n
        code = code * base + ids[k : n + k]
        span *= base
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_metrics(text: str | None) -> tuple[int, ...]:
    """The METRICS of one whole text."""
    if not text:
        return (0,) * len(METRICS)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    lower = text.lower()
    if len(lower) == len(text):
        upper = int((_points(text) != _points(lower)).sum())
    else:
        upper = sum(a != a.lower() for a in text)
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), upper, text.count("!"),
    )


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@F.pandas_udf(StructType([StructField(m, LongType()) for m in METRICS]))
def metrics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_metrics(t) for t in texts], columns=list(METRICS), dtype="int64")


def base_failed(m: str) -> Column:
    n, r = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def junk_score(m: str) -> Column:
    """Largest ratio, each over its customary limit; 0 without words."""
    words, chars = F.col(f"{m}.n_words"), F.col(f"{m}.word_chars")
    over = [
        (F.col(f"{m}.n_symbols") / words, 0.1),
        (F.col(f"{m}.n_dup_lines") / F.greatest(F.col(f"{m}.n_lines"), F.lit(1)), 0.3),
        (F.col(f"{m}.n_repeat_words") / words, 0.2),
        (F.col(f"{m}.n_letters_upper") / chars, 0.3),
        (F.col(f"{m}.n_bangs") / words, 0.1),
        (chars / words, 20.0),
    ]
    return F.when(words > 0, F.greatest(*(x / limit for x, limit in over))).otherwise(F.lit(0.0))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound, at level 1 - delta, on a rate with k hits in n trials (Clopper-Pearson)."""
    if n <= 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_choose = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = 0.0 if p >= 1 else float(np.exp(log_choose + i * math.log(p) + (n - i) * math.log1p(-p)).sum())
        low, high = (p, high) if tail > delta else (low, p)
    return high


def choose_cutoff(good: list[int], junk: list[int], n_good: int, n_junk: int, delta: float,
                  limit: float = MAX_FALSE_REJECTION) -> float | None:
    """Best certified cutoff from rejection counts per cutoff, or None."""
    best, gain = None, 0.0
    for cut, g, j in zip(CUTOFFS, good, junk, strict=True):
        if upper_bound(g, n_good, delta) > limit:
            break
        worth = j / max(n_junk, 1) - g / max(n_good, 1)
        if worth > gain:
            best, gain = cut, worth
    return best


def calibrate(scored: DataFrame, stratum: str, label: str, score: str, limit: float = MAX_FALSE_REJECTION,
              confidence: float = CONFIDENCE) -> tuple[DataFrame, int]:
    """Cutoffs (_q_s, _q_cut) of all labelled strata, null where none is certified, and their number."""
    hits = [F.sum((F.col(score) >= c).cast("long")).alias(f"_h{i}") for i, c in enumerate(CUTOFFS)]
    wide = (
        scored.filter(F.col(label).isin(0, 1))
        .groupBy(F.col(stratum).alias("_q_s"))
        .pivot(label, [0, 1])
        .agg(F.count(F.lit(1)).alias("n"), *hits)
    )
    counts = [c for c in wide.columns if c != "_q_s"]
    counts = write_table(wide.select("_q_s", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts)), "quality-counts")
    strata = counts.count()
    delta = (1 - confidence) / max(strata, 1)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cuts = [
                choose_cutoff([r[f"1__h{i}"] for i in range(len(CUTOFFS))], [r[f"0__h{i}"] for i in range(len(CUTOFFS))],
                              r["1_n"], r["0_n"], delta, limit)
                for r in pdf.to_dict("records")
            ]
            yield pd.DataFrame({"_q_s": pdf["_q_s"], "_q_cut": pd.Series(cuts, pdf.index, dtype=object)})

    return write_table(counts.mapInPandas(pick, "_q_s string, _q_cut double"), "quality-cutoffs"), strata


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     stratum: str = "lang", keep: list[str] | None = None, out: str = "quality") -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and a struct ``out`` of METRICS, base_failed and kept, in place of a
    column of that name.

    Metrics are computed once and written with the columns to the shared folder; the labelled part then joins on
    narrow columns only, and the verdict is a plain expression over the written rows.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    found, s, doc, cut, label, lo, hi, junk = fresh([*docs.columns, out], "m", "s", "doc", "cut", "label", "lo", "hi", "junk")
    rows = docs.withColumn(found, metrics(F.col(text_col))).select(*every(names), found, F.col(stratum).cast("string").alias(s), F.col(id_col).alias(doc))
    table = write_table(rows, "quality")
    known = labels.select(F.col(id_col).alias(doc), F.col("quality").alias(label)).groupBy(doc).agg(F.min(label).alias(lo), F.max(label).alias(hi))
    known = known.filter(F.col(lo) == F.col(hi)).select(doc, F.col(lo).alias(label))  # a row labelled both ways has no label
    narrow = table.filter(~base_failed(found)).select(doc, s, junk_score(found).alias(junk))
    cuts, strata = calibrate(narrow.join(known, doc), s, label, junk)
    cuts = cuts.select(F.col("_q_s").alias(label), F.col("_q_cut").alias(cut))
    cuts = F.broadcast(cuts) if strata <= BROADCAST_STRATA else cuts
    judged = table.join(cuts, F.col(s).eqNullSafe(F.col(label)), "left")
    failed = base_failed(found)
    kept = ~failed & (junk_score(found) < F.coalesce(cut, F.lit(math.inf)))
    verdict = F.struct(*(F.col(f"{found}.{m}").alias(m) for m in METRICS), failed.alias("base_failed"), kept.alias("kept"))
    return judged.select(*every(names), verdict.alias(out))
