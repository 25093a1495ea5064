"""Deterministic verification of claims against evidence, the answer gate, and quotation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.origins import locate_each
from veridoc.functions.text import ELLIPSIS, normalize, quote_segments

MIN_QUOTE_CHARS, MIN_SUPPORT = 12, 0.6


def citation_valid(claims: DataFrame, evidence: DataFrame, query: str = "question_id", claim: str = "claim_id") -> DataFrame:
    """Per claim whether it has refs and each is in its question's evidence."""
    refs = claims.select(query, claim, F.explode_outer("refs").alias("ref"))
    known = evidence.select(query, "ref").distinct().withColumn("_known", F.lit(1))
    found = refs.join(known, [query, "ref"], "left").groupBy(query, claim)
    return found.agg((F.count("ref") > 0).alias("_any"), (F.count("ref") == F.count("_known")).alias("_all")).select(
        query, claim, (F.col("_any") & F.col("_all")).alias("valid")
    )


def quoted_in(quote: Column, text: Column) -> Column:
    """Whether all segments of the quotation occur in the text in order, both normalized, long enough together."""
    segments = quote_segments(quote)
    body = normalize(text)

    def step(at: Column, s: Column) -> Column:
        found = F.call_function("locate", s, body, at)
        return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(s))

    end = F.aggregate(segments, F.lit(1), step)
    long = F.aggregate(segments, F.lit(0), lambda n, s: n + F.length(s)) >= MIN_QUOTE_CHARS
    return (F.size(segments) > 0) & long & (end > 0)


def supported(valid: Column, grounded: Column, lexical: Column, entailment: Column) -> Column:
    """Valid, grounded, lexically supported (or not applicable) and not contradicted."""
    return valid & grounded & (lexical.isNull() | (lexical >= MIN_SUPPORT)) & entailment.isin("entailed", "verbatim", "neutral")


def gate(questions: DataFrame, claims: DataFrame, query: str = "question_id") -> DataFrame:
    """One decision a question: weak_evidence without claims, verification_failed if the summary is unsupported or any
    claim contradicted, else answer; with the number of kept claims."""
    per = claims.groupBy(query).agg(
        F.bool_or((F.col("role") == "summary") & F.col("supported")).alias("_summary"),
        F.bool_or(F.col("entailment") == "contradicted").alias("_against"),
        F.count_if(F.col("supported")).alias("kept"),
    )
    decision = (
        F.when(F.col("_summary").isNull(), "weak_evidence")
        .when(~F.col("_summary") | F.col("_against"), "verification_failed")
        .otherwise("answer")
    )
    return questions.select(query).join(per, query, "left").select(query, decision.alias("decision"), F.coalesce("kept", F.lit(0)).alias("kept"))


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching [start, end) spans of a key as one."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    island = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    return island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def is_verbatim(claim_tokens: Column, passage_tokens: Column, negations: list[str]) -> Column:
    """A contiguous run of the passage equal to the claim and not preceded by a negation."""
    n, m = F.size(claim_tokens), F.size(passage_tokens)
    at = F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1)))
    no = F.array(*(F.lit(x) for x in negations))

    def hit(i: Column) -> Column:
        same = F.slice(passage_tokens, i, n) == claim_tokens
        return same & ((i == 1) | ~F.array_contains(no, F.get(passage_tokens, i - 2)))

    return (n > 0) & (n <= m) & F.exists(at, hit)


def source_quote(answer: Column, quote: Column) -> Column:
    """The source's own wording of each quoted segment found, joined by an ellipsis; null if none is.

    Segments are normalised where they are looked up, as the answer is.
    """
    return F.nullif(F.array_join(locate_each(answer, F.split(quote, ELLIPSIS)), " … "), F.lit(""))
