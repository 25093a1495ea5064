"""Is a circulated quotation authentic?  Its words are looked for, in order, in candidate passages.

Fixed values: the limit of relatedness and the negations that turn a quotation's meaning.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from veridoc.functions.text import locate_verbatim, normalize, split_sentences, tokens
from veridoc.operators.verification import is_verbatim

# Fixed values.
RELATED = 0.45
NEGATIONS = ["لا", "ليس", "ليست", "لم", "لن", "ما", "غير", "ولا", "فلا", "ليسوا"]
SAYS = "(قال|يقول|سئل|سُئل|سؤال|فتوى)"
INTRODUCTION = r'^([^:«"\n]{0,90}?[:：]\s*)'
CLOSING = r"\s*(?:اهـ|ا\.هـ|انتهى(?:\s+كلامه)?)[.\s]*$"
QUOTES = "«»\"“”'"
MIN_TOKENS, WINDOW = 4, 6
OWN_FIRST, DOCUMENTS = 4, 8


def attributed_source(messages: DataFrame, names: DataFrame, query: str = "message_id", text: str = "message") -> DataFrame:
    """First source (by ord) any of whose names a message holds as whole words; names: (source_slug, ord, name)."""
    padded = messages.select(query, F.explode(F.array_distinct(tokens(text))).alias("_h"), F.concat(F.lit(" "), normalize(text), F.lit(" ")).alias("_p"))
    known = names.select("source_slug", "ord", normalize("name").alias("_n"))
    held = padded.join(known.withColumn("_h", F.substring_index("_n", " ", 1)), "_h")  # through the name's first word
    held = held.filter(F.contains(F.col("_p"), F.concat(F.lit(" "), F.col("_n"), F.lit(" "))))
    first = held.groupBy(query).agg(F.min_by("source_slug", "ord").alias("named"))
    return messages.join(first, query, "left")


def split_claim(text: Column, names_in_lead: Column) -> Column:
    """The statement without its introduction, if that names a source or says so, and without closing marks and quotes."""
    lead = F.regexp_extract(text, INTRODUCTION, 1)
    introduced = (lead != "") & (names_in_lead | lead.rlike(SAYS))
    body = F.when(introduced, F.substring(text, F.length(lead) + 1, F.length(text))).otherwise(text)
    body = F.trim(F.regexp_replace(body, CLOSING, ""))
    return F.trim(F.btrim(body, F.lit(QUOTES)))


def common_runs(claim: list[str], passage: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in claim, place in passage, length of the equal run that ends there) wherever the two hold the same word.

    Made once for a claim and a whole text; a window of the text is a range of places.
    """
    places = defaultdict(list)
    for i, word in enumerate(claim):
        places[word].append(i)
    i, j, run = [], [], []
    before: dict[int, int] = {}
    for at, word in enumerate(passage):
        here = {k: before.get(k - 1, 0) + 1 for k in places.get(word, ())}
        i += here
        j += [at] * len(here)
        run += here.values()
        before = here
    return np.array(i, np.int64), np.array(j, np.int64), np.array(run, np.int64)


def covered(runs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, start: int, stop: int) -> int:
    """Words of a claim of ``n`` words in matching blocks of the passage's words ``start`` to ``stop``, in order.

    The longest block is taken first, of equal ones the earliest in the claim, then in the passage; then what lies before and
    behind it on both sides.
    """
    total, todo = 0, [(runs, 0, n, start, stop)]
    while todo:
        (i, j, run), low, high, left, right = todo.pop()
        inside = (i >= low) & (i < high) & (j >= left) & (j < right)
        i, j, run = i[inside], j[inside], run[inside]
        if not len(i):
            continue
        size = np.minimum(run, np.minimum(i - low, j - left) + 1)
        k = np.lexsort((j, i, -size))[0]
        m = int(size[k])
        a, b = int(i[k]) - m + 1, int(j[k]) - m + 1
        total += m
        todo += [((i, j, run), low, a, left, b), ((i, j, run), a + m, high, b + m, right)]
    return total


def best_window(claim: list[str], sentences: list[list[str]], most: int) -> tuple[int, int, float]:
    """(first sentence from 0, number of sentences, coverage) of the window that covers the claim best; the shortest, then earliest."""
    n, count = len(claim), len(sentences)
    words = [w for s in sentences for w in s]
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sentences])]).astype(np.int64)
    runs = common_runs(claim, words)
    hits = np.searchsorted(np.unique(runs[1]), edges)  # words of the passage that the claim holds, up to each sentence
    best = (0, 1, -1)
    for size in range(1, min(most, count) + 1):
        for at in range(count - size + 1):
            bound = min(n, int(hits[at + size] - hits[at]))
            if bound > best[2]:
                got = covered(runs, n, int(edges[at]), int(edges[at + size])) if bound else 0
                if got > best[2]:
                    best = (at, size, got)
    return best[0], best[1], best[2] / n if n else 0.0


def ordered_coverage(claim: list[str], passage: list[str]) -> float:
    """Share of the claim's words in matching blocks of the passage, in order; 0 without words."""
    return covered(common_runs(claim, passage), len(claim), 0, len(passage)) / len(claim) if claim else 0.0


WINDOWS = StructType([StructField("at", IntegerType()), StructField("size", IntegerType()), StructField("coverage", DoubleType())])


@F.pandas_udf(WINDOWS)
def find_window(claims: pd.Series, passages: pd.Series, most: pd.Series) -> pd.DataFrame:
    rows = [best_window(list(c), [list(s) for s in p], int(m)) for c, p, m in zip(claims, passages, most, strict=True)]
    return pd.DataFrame(rows, columns=["at", "size", "coverage"])


def closest_passages(pairs: DataFrame, key: list[str], claim: str = "claim", content: str = "content") -> DataFrame:
    """Per pair the window of up to WINDOW sentences that covers the claim best; the shortest, then earliest, wins.

    ``key`` names a pair; the windows of a pair are compared where its row stands, on one table of common runs.
    """
    sentences = split_sentences(content)
    cut = pairs.withColumn("_s", F.when(F.size(sentences) == 0, F.array(F.coalesce(content, F.lit("")))).otherwise(sentences))
    most = F.least(F.greatest(F.size(split_sentences(claim)), F.lit(1)) + 1, F.lit(WINDOW))
    found = cut.withColumn("_w", find_window(tokens(claim), F.transform("_s", lambda s: tokens(s)), most))
    passage = F.array_join(F.slice("_s", F.col("_w.at") + 1, F.col("_w.size")), " ")
    return found.select(*pairs.columns, passage.alias("passage"), F.col("_w.coverage").alias("coverage"))


def decide(matches: DataFrame, query: str = "message_id") -> DataFrame:
    """One verdict per message that has matches: columns claim, named, source_slug, passage, coverage, rank and, if a judge
    has looked at the pair, label (entailed, contradicted or neutral)."""
    same = is_verbatim(tokens("claim"), tokens("passage"), NEGATIONS)
    label = F.col("label") if "label" in matches.columns else F.lit(None).cast("string")
    verdict = (
        F.when(same, "verbatim").when(label == "entailed", "meaning").when(label == "contradicted", "contradicted").otherwise("similar")
    )
    own = F.coalesce(F.col("source_slug") == F.col("named"), F.col("named").isNull())
    rated = matches.filter(F.col("coverage") >= RELATED).withColumn("_v", verdict).withColumn("_own", own)
    first = lambda flag: F.min_by(F.when(flag, F.struct("_v", "passage", "source_slug", "coverage")), F.when(flag, F.col("rank")))
    per = rated.groupBy(query).agg(first(F.col("_own")).alias("a"), first(~F.col("_own")).alias("b"))
    sure = lambda m: F.coalesce(m["_v"].isin("verbatim", "meaning"), F.lit(False))
    a, b = F.col("a"), F.col("b")
    final = (
        F.when(a.isNull(), F.when(sure(b), "misattributed").otherwise("not_found"))
        .when(a["_v"].isin("verbatim", "meaning", "contradicted"), a["_v"]).when(sure(b), "misattributed").otherwise(a["_v"])
    )
    chosen = F.when(a.isNull() & ~sure(b), F.lit(None)).when(a.isNull() | (~a["_v"].isin("verbatim", "meaning", "contradicted") & sure(b)), b).otherwise(a)
    out = matches.select(query).distinct().join(per, query, "left")
    return out.select(query, F.coalesce(final, F.lit("not_found")).alias("verdict"), chosen["passage"].alias("passage"), F.round(chosen["coverage"], 2).alias("coverage"))


def candidate_documents(ranked: DataFrame, own: DataFrame, query: str = "message_id", document: str = "doc_id") -> DataFrame:
    """(query, document, rank) of the first DOCUMENTS distinct documents: the named source's OWN_FIRST best units before all others.

    ranked, own: (query, document, rank), units found everywhere and in the named source alone.
    """
    lead = own.filter(F.col("rank") <= OWN_FIRST).select(query, document, F.lit(0).alias("turn"), "rank")
    both = lead.unionByName(ranked.select(query, document, F.lit(1).alias("turn"), "rank"))
    first = both.groupBy(query, document).agg(F.min(F.struct("turn", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("at", document))
    return first.withColumn("place", place).filter(F.col("place") <= DOCUMENTS).select(query, document, F.col("place").alias("rank"))


def attribution_report(messages: DataFrame, matches: DataFrame, query: str = "message_id") -> DataFrame:
    """Verdict, passage, the passage's own wording of a verbatim claim, and rounded coverage, for every message (query, claim, named).

    Claims of fewer than MIN_TOKENS words are not judged: verdict too_short.  matches: (query, source_slug, passage, coverage, rank[, label]).
    """
    asked = messages.select(query, "claim", "named", (F.size(tokens("claim")) < MIN_TOKENS).alias("_short"))
    judged = decide(matches.join(asked.filter(~F.col("_short")).drop("_short"), query), query)
    out = asked.join(judged, query, "left")
    verdict = F.when(F.col("_short"), "too_short").otherwise(F.coalesce("verdict", F.lit("not_found")))
    quote = F.when(F.col("verdict") == "verbatim", locate_verbatim("passage", "claim"))
    return out.select(query, "claim", "named", verdict.alias("verdict"), "passage", quote.alias("quote"), "coverage")
