"""Failure classes, consistency, weight choice, case rules and summaries over evaluated questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.operators.scan import values_at

from veridoc.operators.evaluation import bucket

VOCABULARY_COVERAGE, CURRENT_WEIGHT = 0.5, 0.25
WEIGHTS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25)


def _share(what: Column) -> Column:
    return F.round(100 * F.avg(F.coalesce(what, F.lit(False)).cast("int")), 6)


def term_coverage_best(questions: DataFrame, accepted: DataFrame, document_terms: DataFrame, query: str = "question_id", document: str = "doc_id") -> DataFrame:
    """(query, term_coverage): the best share of a question's terms that one accepted document holds; 0 without terms or documents.

    questions: (query, terms array); accepted: (query, document); document_terms: (document, term), one row a pair.
    """
    asked = questions.select(query, F.explode(F.array_distinct("terms")).alias("term")).join(accepted.select(query, document).distinct(), query)
    met = asked.join(document_terms.select(document, "term").distinct(), [document, "term"], "left_semi")
    most = met.groupBy(query, document).agg(F.count(F.lit(1)).alias("n")).groupBy(query).agg(F.max("n").alias("n"))
    n = F.size(F.array_distinct("terms"))
    share = F.when(n > 0, F.coalesce("n", F.lit(0)) / n).otherwise(F.lit(0.0))
    return questions.join(most, query, "left").select(query, share.alias("term_coverage"))


def failure_class(rows: DataFrame, item: str = "item", variant: str = "variant") -> DataFrame:
    """Rows with ``failure``: null when right; gate, ranking, the variant's own class, vocabulary or exact_wording otherwise.

    rows: (item, variant, first_rank, sufficient, in_evidence, term_coverage), one row an item and variant.
    """
    first = rows.filter(F.col(variant) == "original").select(item, (F.col("first_rank") == 1).alias("_hit"))
    alone = F.coalesce("_hit", F.lit(False)) | (F.col(variant) == "original")
    own = F.col(variant).isin("english", "typo", "colloquial", "short")
    named = (
        F.when((F.col("first_rank") == 1) & F.col("sufficient"), F.lit(None).cast("string"))
        .when(F.col("first_rank") == 1, "gate").when(F.col("in_evidence"), "ranking").when(own, F.col(variant))
        .when((F.col("term_coverage") >= VOCABULARY_COVERAGE) & alone, "exact_wording").otherwise("vocabulary")
    )
    return rows.join(first, item, "left").withColumn("failure", named).drop("_hit")


def consistency(rows: DataFrame, item: str = "item", variant: str = "variant") -> DataFrame:
    """One row of percentages: rephrasings first and in the first three, agreeing with the original's first, and items whose
    variants are all in the first three.  rows: (item, variant, first_rank, top), ``top`` being the first document found."""
    first = rows.filter(F.col(variant) == "original").select(item, F.col("top").alias("_top"))
    again = rows.filter(F.col(variant) != "original").join(first, item)
    found = again.agg(
        _share(F.col("first_rank") == 1).alias("top1"), _share(F.col("first_rank") <= 3).alias("top3"), _share(F.col("top").eqNullSafe(F.col("_top"))).alias("agreement")
    )
    every = rows.groupBy(item).agg(F.bool_and(F.coalesce(F.col("first_rank") <= 3, F.lit(False))).alias("_all"))
    return found.join(every.agg(_share(F.col("_all")).alias("robust")))  # two single rows


def weight_grid(candidates: DataFrame, query: str = "question_id", weights: tuple[float, ...] = WEIGHTS, deep: int = 6) -> DataFrame:
    """Per weight: hits in the first 1, 3 and 5, counts of classes A, B and C, wrong firsts (D), and top-3 hits of short and indirect.

    candidates: (query, variant, item, dense, coverage, accepted).  Ranks per weight need one window; no row is compared with another.
    """
    weighted = candidates.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    score = F.round(F.col("dense") + F.col("weight") * F.col("coverage"), 9)
    rank = F.row_number().over(Window.partitionBy("weight", query).orderBy(score.desc(), "item"))
    best = weighted.withColumn("_r", rank).groupBy("weight", query, "variant").agg(F.min(F.when(F.col("accepted"), F.col("_r"))).alias("first_rank"))
    kind = bucket(F.col("first_rank"), F.coalesce(F.col("first_rank") <= deep, F.lit(False)))
    rows = best.withColumn("kind", kind)
    hit = lambda k: F.count_if(F.col("first_rank") <= k)
    of = lambda v: F.count_if((F.col("variant") == v) & (F.col("first_rank") <= 3)).alias(f"{v}_top3")
    counts = [F.count_if(F.col("kind") == b).alias(b) for b in "ABC"]
    return rows.groupBy("weight").agg(
        F.count(F.lit(1)).alias("n"), *(hit(k).alias(f"top{k}") for k in (1, 3, 5)), *counts, F.count_if(F.coalesce(F.col("first_rank") != 1, F.lit(True))).alias("D"), of("short"), of("indirect")
    )


def _against(grid: DataFrame, current: float) -> DataFrame:
    base = grid.filter(F.abs(F.col("weight") - current) < 1e-9)
    columns = ("A", "B", "C", "D", "short_top3", "indirect_top3")
    return grid.join(base.select(*(F.col(c).alias(f"_{c}") for c in columns)))  # the base is one row


def _eligible() -> Column:
    return (F.col("A") <= F.col("_A")) & (F.col("_short_top3") - F.col("short_top3") <= 1) & (F.col("_indirect_top3") - F.col("indirect_top3") <= 1)


def choose_weight(grid: DataFrame, current: float = CURRENT_WEIGHT) -> DataFrame:
    """Of the weights that lose no more in A and at most one short and one indirect hit: least D, then least B, then most C."""
    kept = _against(grid, current).filter(_eligible())
    return kept.orderBy("D", "B", F.col("C").desc(), "weight").limit(1).select(*grid.columns)


def adopt_weight(validated: DataFrame, chosen: DataFrame, current: float = CURRENT_WEIGHT) -> DataFrame:
    """(weight, adopted): on the validation half the chosen weight needs more C and no more D, B or A, and stays eligible."""
    better = (F.col("C") > F.col("_C")) & (F.col("D") <= F.col("_D")) & (F.col("B") <= F.col("_B")) & _eligible()
    return _against(validated, current).join(chosen.select("weight"), "weight", "left_semi").select("weight", better.alias("adopted"))


def hard_case_pass(cases: DataFrame) -> DataFrame:
    """Cases with ``passed`` by the rule of their category.

    cases: (category, outcome, summary, cited array, expect, avoid, verified, parent_ok, cited_categories array, expect_categories array).
    """
    has = lambda c: F.coalesce(F.array_contains("cited", F.col(c)), F.lit(False))
    held = F.col("outcome").isin("abstention", "clarification")
    rule = (
        F.when(F.col("category") == "discrimination", (F.col("outcome") == "answer") & has("expect") & ~has("avoid"))
        .when(F.col("category") == "false_positive", held)
        .when(F.col("category") == "no_evidence", held & (F.coalesce("summary", F.lit("")) == ""))
        .when(F.col("category") == "multi_turn", F.col("parent_ok") & F.col("verified") & F.arrays_overlap("cited_categories", "expect_categories"))
    )
    return cases.withColumn("passed", F.coalesce(rule, F.lit(False)))


def cited_documents(claims: DataFrame, pattern: str, query: str = "question_id") -> DataFrame:
    """(query, documents): distinct ids, cut from the urls that kept claims cite, in order.  claims: (query, kept, urls array)."""
    found = claims.filter("kept").select(query, F.explode("urls").alias("url"))
    ids = found.select(query, F.nullif(F.regexp_extract("url", pattern, 1), F.lit("")).alias("id")).filter("id IS NOT NULL")
    return ids.groupBy(query).agg(F.array_sort(F.collect_set("id")).alias("documents"))


def outcome_regression(results: DataFrame, cited: DataFrame, query: str = "question_id") -> DataFrame:
    """One row a question: ``ok`` if the outcome is as expected and, where asked for, a cited title holds the text, with claim counts.

    results: (query, outcome, expected, title_contains); cited: (query, kept, supported, title).
    """
    j = results.join(cited, query, "left")
    named = F.bool_or(F.coalesce(F.col("kept") & F.contains(F.col("title"), F.col("title_contains")), F.lit(False)))
    told = j.groupBy(query, "outcome", "expected", "title_contains").agg(
        named.alias("_named"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if(F.col("kept") & ~F.col("supported")).alias("unsupported_shown")
    )
    ok = (F.col("outcome") == F.col("expected")) & (F.coalesce("title_contains", F.lit("")).eqNullSafe(F.lit("")) | F.col("_named"))
    return told.select(query, ok.alias("ok"), "kept", "rejected", "unsupported_shown")


def extractive_rule_replay(rows: DataFrame, terms: tuple[float, ...] = (0.0, 0.66, 1.0), closeness: tuple[float, ...] = (0.0, 0.83, 0.87)) -> DataFrame:
    """Per rule (least coverage, least closeness): right, wrong and out-of-corpus questions answered.

    rows: (coverage, dense, correct, in_corpus), one row a question; each row is counted under every rule.
    """
    ruled = rows.withColumn("least_coverage", F.explode(F.array(*map(F.lit, terms)))).withColumn("least_dense", F.explode(F.array(*map(F.lit, closeness))))
    given = (F.col("coverage") >= F.col("least_coverage")) & (F.col("dense") >= F.col("least_dense"))
    n = lambda c: F.count_if(given & c)
    return ruled.groupBy("least_coverage", "least_dense").agg(
        n(F.col("in_corpus") & F.col("correct")).alias("correct"), n(F.col("in_corpus") & ~F.col("correct")).alias("wrong"), n(~F.col("in_corpus")).alias("outside_answered")
    )


def variant_summary(rows: DataFrame, variant: str = "variant") -> DataFrame:
    """Per variant: verified and right, wrong source, abstained, negatives answered, unsupported shown.

    rows: (variant, outcome, verified, correct, negative, unsupported).
    """
    answer = F.col("outcome") == "answer"
    return rows.groupBy(variant).agg(
        F.count_if(~F.col("negative") & answer & F.col("verified") & F.col("correct")).alias("verified_correct"),
        F.count_if(~F.col("negative") & answer & ~F.col("correct")).alias("wrong_source"),
        F.count_if(~F.col("negative") & (F.col("outcome") == "abstention")).alias("abstained"),
        F.count_if(F.col("negative") & answer).alias("negatives_answered"), F.sum("unsupported").cast("long").alias("unsupported_shown"),
    )


def rank_documents(found: DataFrame, query: str = "query_id", document: str = "doc_id", score: str = "score") -> DataFrame:
    """(query, document, score, rank): documents by their best unit, ties by id."""
    best = found.groupBy(query, document).agg(F.max(score).alias(score))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), document)))


def compare_embedders(ranks: DataFrame, model: str = "model", variant: str = "variant", ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Percentages of first accepted documents within k per model and variant, and per model over all.  ranks: (model, variant, first_rank)."""
    rates = [_share(F.col("first_rank") <= k).alias(f"top{k}") for k in ks]
    grouped = ranks.cube(model, variant).agg(F.grouping(model).alias("_g"), F.count(F.lit(1)).alias("n"), *rates).filter("_g = 0").drop("_g")
    return grouped.withColumn(variant, F.coalesce(F.col(variant).cast("string"), F.lit("ALL")))


def phase_latency(timings: DataFrame, phases: list[str], mode: str = "mode") -> DataFrame:
    """min, median, p95 and max of each phase over the questions that reached generation; a missing time is left out.

    The percentiles are taken from counts of each distinct time, scanned in parts.
    """
    long = timings.filter(F.col(mode) != "none").unpivot([], phases, "phase", "ms")
    return values_at(long, "phase", "ms", {"median": F.ceil(F.col("n") * 0.5), "p95": F.ceil(F.col("n") * 0.95)}).drop("n")


def cost_projection(calls: DataFrame, questions: int | Column, repeats: float = 0.0, task: str = "task") -> DataFrame:
    """Per task and over all: mean tokens, calls and cost a question, and cost with a share of repeats served from the cache.

    calls: (task, input_tokens, output_tokens, cost), one row a call.
    """
    n = F.lit(questions) if isinstance(questions, int) else questions
    out = calls.rollup(task).agg(
        F.round(F.avg("input_tokens"), 6).alias("mean_in"), F.round(F.avg("output_tokens"), 6).alias("mean_out"),
        F.round(F.count(F.lit(1)) / n, 6).alias("calls_per_question"), F.round(F.sum(F.col("input_tokens") + F.col("output_tokens")) / n, 6).alias("tokens_per_question"),
        F.round(F.sum("cost") / n, 9).alias("cost_per_question"), F.round(F.sum("cost") / n * (1 - repeats), 9).alias("cost_with_cache"),
    )
    return out.withColumn(task, F.coalesce(F.col(task), F.lit("all")))
