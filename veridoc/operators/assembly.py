"""From evidence and checked claims to the stored answer: eligibility, notes, payload, trace and what is read aloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import concise, sanitize
from veridoc.operators.answering import also_answered, pick_details, pick_summary, priority_window, score_sentences

MIN_DENSE, RELATED_COVERAGE, TRACED = 0.83, 0.75, 20
RETRIED = ("no_source", "weak_evidence", "verification_failed")


def _listed(rows: DataFrame, query: str, order: str, value: Column, name: str) -> DataFrame:
    """(query, name): the values of each question in order."""
    held = rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("_h"))
    return held.select(query, F.transform("_h", lambda x: x["v"]).alias(name))


def eligible(dense: Column, coverage: Column, n_terms: Column, least: float = MIN_DENSE) -> Column:
    """Close enough and, for several terms, holding all of them: only such evidence may be quoted without a model."""
    return (F.coalesce(dense, F.lit(0.0)) >= least) & ((n_terms < 2) | (coverage >= 1.0))


def answering_refs(evidence: DataFrame, query: str = "question_id", least: float = MIN_DENSE) -> DataFrame:
    """(query, refs): evidence that is close and holds most terms, in rank order."""
    fine = (F.coalesce("dense", F.lit(0.0)) >= least) & ((F.col("n_terms") < 2) | (F.col("coverage") >= RELATED_COVERAGE))
    return _listed(evidence.filter(fine), query, "rank", F.col("ref"), "refs")


def generate_extractive(questions: DataFrame, evidence: DataFrame, query: str = "question_id", least: float = MIN_DENSE,
                        similarity: Column | None = None) -> DataFrame:
    """One draft per question: ``insufficient``, ``note``, ``claims`` (role, text, ref) and ``refs``.

    questions: (query, language); evidence: (query, doc_id, rank, ref, priority, dense, coverage, terms, content).  Only Arabic
    questions are answered.  ``similarity`` may compare question and sentence; without it the passage's own closeness stands in.
    """
    window = priority_window(evidence, query).filter(eligible(F.col("dense"), F.col("coverage"), F.size("terms"), least))
    sentences = score_sentences(window, similarity=F.col("dense") if similarity is None else similarity)
    top = pick_summary(sentences, query)
    more = pick_details(sentences, top, query)
    shown = concise("sentence", F.col("terms"))
    rows = top.select(query, F.lit(0).alias("k"), F.lit("summary").alias("role"), shown.alias("text"), "ref").unionByName(
        more.select(query, F.col("ordinal").alias("k"), F.lit("detail").alias("role"), shown.alias("text"), "ref")
    )
    claims = _listed(rows, query, "k", F.struct("role", "text", "ref"), "claims")
    refs = answering_refs(evidence.withColumn("n_terms", F.size("terms")), query, least)
    out = questions.join(claims, query, "left").join(refs, query, "left")
    arabic = F.col("language").startswith("ar")
    note = F.when(~arabic, "cross-lingual match cannot be verified").when(F.col("claims").isNull(), "no sentence addresses the key terms")
    told = arabic & F.col("claims").isNotNull()
    return out.select(query, (~told).alias("insufficient"), note.alias("note"), F.when(told, F.col("claims")).alias("claims"), F.when(told, F.col("refs")).alias("refs"))


def needs_priority_rerun(evidence: DataFrame, answering: DataFrame, claims: DataFrame, conflicts: DataFrame, query: str = "question_id") -> DataFrame:
    """(query, rerun): whether the answer must rest on the top-priority sources alone.

    answering: (query, ref); claims: (query, ordinal, ref), one row per cited ref; conflicts: (query, conflict).
    """
    least = evidence.groupBy(query).agg(F.min(F.coalesce("priority", F.lit(99))).alias("_least"))
    marked = evidence.join(least, query).select(query, "ref", (F.coalesce("priority", F.lit(99)) == F.col("_least")).alias("_top"))
    whole = marked.groupBy(query).agg(F.bool_and("_top").alias("_all"))
    top = marked.filter("_top").select(query, "ref", F.lit(True).alias("_hit"))
    answers = answering.join(top, [query, "ref"], "left_semi").select(query).distinct().withColumn("_answers", F.lit(True))
    cited = claims.join(top, [query, "ref"], "left").groupBy(query, "ordinal").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("_on"))
    low = cited.groupBy(query).agg((~F.bool_and("_on")).alias("_low"))
    joined = whole.join(conflicts.select(query, "conflict"), query, "left").join(answers, query, "left").join(low, query, "left")
    rest = F.coalesce("_answers", F.lit(False)) & F.coalesce("_low", F.lit(False))
    return joined.select(query, (~F.col("_all") & (F.coalesce("conflict", F.lit(False)) | rest)).alias("rerun"))


def order_cited(evidence: DataFrame, cited: DataFrame, summary: DataFrame, query: str = "question_id") -> DataFrame:
    """(query, refs): cited evidence, that of the summary first, then by rank.  cited, summary: (query, ref)."""
    kept = evidence.join(cited.select(query, "ref").distinct(), [query, "ref"])
    first = kept.join(summary.select(query, "ref", F.lit(0).alias("_s")).distinct(), [query, "ref"], "left")
    place = F.struct(F.coalesce("_s", F.lit(1)).alias("s"), F.col("rank").alias("r"))
    return _listed(first.withColumn("_o", place), query, "_o", F.col("ref"), "refs")


def evidence_text(cited: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Texts of the grounded evidence of each claim, or of all it cites where none is grounded, joined in rank order."""
    one = F.struct(F.col("rank").alias("r"), F.col(text).alias("t"))
    held = cited.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("grounded"), one))).alias("_g"), F.array_sort(F.collect_list(one)).alias("_a")
    )
    chosen = F.when(F.size("_g") > 0, F.col("_g")).otherwise(F.col("_a"))
    return held.select(*keys, F.array_join(F.transform(chosen, lambda x: x["t"]), " ").alias("evidence_text"))


def verification_notes(valid: Column, grounded: Column, applicable: Column, lexical: Column, least: float, entailment: Column) -> Column:
    """The reasons against a claim in order, joined by "; "; null if there is none."""
    weak = F.when(applicable & (lexical < least), F.concat(F.lit("claim terms not supported by evidence (lexical "), F.format_number(lexical, 2), F.lit(")")))
    label = F.when(~entailment.isin("entailed", "verbatim", "not_checked"), F.concat(F.lit("entailment="), entailment))
    reasons = F.concat_ws("; ", F.when(~valid, F.lit("cites evidence that was not provided")), F.when(~grounded, F.lit("quote not found in the cited evidence")), weak, label)
    return F.nullif(reasons, F.lit(""))


def judge_pairs(claims: DataFrame, cited: DataFrame, query: str = "question_id") -> DataFrame:
    """(query, ordinal, premise, hypothesis) of claims still to be checked, sanitised.  cited: (query, ordinal, rank, content)."""
    open_ = claims.filter("entailment = 'not_checked' AND valid AND grounded")
    held = cited.groupBy(query, "ordinal").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_c"))
    premise = F.array_join(F.transform("_c", lambda x: x["content"]), "\n")
    return open_.join(held, [query, "ordinal"]).select(query, "ordinal", sanitize(premise).alias("premise"), sanitize("text").alias("hypothesis"))


def extractive_first(extractive: DataFrame, external: DataFrame, query: str = "question_id") -> DataFrame:
    """The extractive draft where its gate says answer, else the external one where there is one, else the extractive."""
    a = extractive.select(query, F.struct("decision", "text").alias("_x"))
    b = external.select(query, F.struct("decision", "text").alias("_y"))
    mine = (F.col("_x.decision") == "answer") | F.col("_y").isNull()
    joined = a.join(b, query, "left").withColumn("mode", F.when(mine, "extractive").otherwise("external"))
    chosen = F.when(mine, F.col("_x")).otherwise(F.col("_y"))
    return joined.select(query, "mode", chosen["decision"].alias("decision"), chosen["text"].alias("text"))


def evidence_payload(evidence: DataFrame) -> Column:
    """One evidence row as it is stored: rounded scores, and the question only with a document's first unit."""
    score = {"dense": 4, "sparse": 4, "fused": 5, "hybrid": 4, "coverage": 3, "rerank": 4}
    scores = [F.round(n, places).alias(n) for n, places in score.items() if n in evidence.columns]
    shown = [c for c in ("ref", "unit_id", "doc_id", "source_slug", "title", "url", "content") if c in evidence.columns]
    question = [F.when(F.col("ordinal") == 0, F.col("question")).alias("question")] if "question" in evidence.columns else []
    return F.struct(*shown, *question, F.struct(*scores).alias("scores"))


def assemble_answer(questions: DataFrame, claims: DataFrame, evidence: DataFrame, answering: DataFrame, query: str = "question_id") -> DataFrame:
    """One nested row per question, ready to be stored.

    questions: (query, outcome, reason, mode); claims: (query, ordinal, role, text, ref, kept); evidence: (query, rank, ref, url, …);
    answering: (query, ref).  Summary, details and also_answered belong to answers, evidence to answers and abstentions.
    """
    told = claims.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("ordinal", "role", "text", "ref", "kept"))).alias("claims"))
    held = _listed(evidence, query, "rank", evidence_payload(evidence), "evidence")
    cited = evidence.join(claims.filter("kept").select(query, "ref").distinct(), [query, "ref"], "left_semi")
    other = also_answered(evidence.join(answering.select(query, "ref").distinct(), [query, "ref"], "left_semi"), cited, query)
    also = _listed(other, query, "rank", F.col("ref"), "also_answered")
    joined = questions.join(told, query, "left").join(held, query, "left").join(also, query, "left")
    answer = F.col("outcome") == "answer"
    of = lambda role: F.transform(F.filter("claims", lambda c: c["kept"] & (c["role"] == role)), lambda c: c["text"])
    return joined.select(
        query, "outcome", "reason", F.coalesce("mode", F.lit("none")).alias("mode"),
        F.when(answer, F.get(of("summary"), F.lit(0))).alias("summary"),
        F.when(answer, F.coalesce(of("detail"), F.array())).otherwise(F.array()).alias("details"),
        "claims", F.when(F.col("outcome").isin("answer", "abstention"), F.col("evidence")).alias("evidence"),
        F.when(answer, F.coalesce("also_answered", F.array())).otherwise(F.array()).alias("also_answered"),
    )


def retry_candidates(answers: DataFrame, fresh: DataFrame, query: str = "question_id") -> DataFrame:
    """Abstentions for lack of evidence or of a passing check whose search for further documents added some.  fresh: (query, doc_id)."""
    lacking = answers.filter((F.col("outcome") == "abstention") & F.col("reason").isin(*RETRIED))
    return lacking.join(fresh.groupBy(query).agg(F.countDistinct("doc_id").alias("new_documents")), query)


def merge_retried(answers: DataFrame, again: DataFrame, query: str = "question_id") -> DataFrame:
    """Answers with those of the second run in place of the first, tokens of both added.  Both sides have the same columns."""
    spent = ("input_tokens", "output_tokens")
    first = answers.select(query, *(F.col(c).alias(f"_{c}") for c in spent))
    kept = answers.join(again, query, "left_anti")
    redone = again.join(first, query)
    for c in spent:
        redone = redone.withColumn(c, F.col(c) + F.coalesce(f"_{c}", F.lit(0))).drop(f"_{c}")
    return kept.unionByName(redone)


def trace_rows(stages: DataFrame, candidates: DataFrame, query: str = "question_id") -> DataFrame:
    """(query, stage, ord, status, output): stage rows as they are, the retrieval stage with its TRACED best candidates."""
    best = _listed(candidates.filter(F.col("rank") <= TRACED), query, "rank", F.col("unit_id").cast("string"), "_best")
    output = F.when(F.col("stage") == "retrieval", F.coalesce(F.array_join("_best", ","), F.lit(""))).otherwise(F.col("output"))
    return stages.join(best, query, "left").select(query, "stage", "ord", "status", output.alias("output"))


def lookup_answer(answers: DataFrame, answer_id: str | int, key: str = "question_id") -> DataFrame:
    """The stored answer of one id; the filter reaches the scan."""
    return answers.filter(F.col(key) == answer_id)


def spoken_text(outcome: Column, language: Column, summary: Column, details: Column, question: Column, options: Column, message: Column) -> Column:
    """What is read aloud: an answer's sentences, a question back with its options, or the reason's message."""
    answer = F.trim(F.concat_ws(" ", F.coalesce(summary, F.lit("")), details))
    asked = F.when(language == "en", F.concat(question, F.lit(" "), F.array_join(options, " or "), F.lit("?")))
    asked = asked.otherwise(F.concat(question, F.lit(" "), F.array_join(options, " أو "), F.lit("؟")))
    back = F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, question).otherwise(asked)
    return F.when(outcome == "answer", answer).when((outcome == "clarification") & question.isNotNull(), back).otherwise(F.coalesce(message, F.lit("")))
