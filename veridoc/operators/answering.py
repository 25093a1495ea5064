"""Extractive answers, claim shaping, prompts and answer assembly, per question and set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions import fixed_values as V
from veridoc.functions.text import all_stems, bind, content_terms, detect_language, light_stem, person_core, quotable_sentences, sanitize, term_overlap

WINDOW, SUMMARY_OVERLAP, DETAIL_OVERLAP, DETAIL_SCORE, DETAILS = 4, 0.66, 0.34, 0.35, 3
# The stages of a trace in the groups they are shown in, and the interfaces a question may come from.
GROUPS = {
    "question": ["pii"], "analysis": ["language", "normalization", "intent", "sensitivity", "clarification"], "sources": ["live_search", "retrieval"],
    "evidence": ["rerank"], "claims": ["generation", "claims"], "verification": ["verification"], "answer": ["safety_gate"],
}
LOCALES, CHANNELS = ("ar", "en", "ur", "hi", "bn", "tr", "id", "ms", "uz", "kk", "ha"), ("text", "voice")


def priority_window(evidence: DataFrame, query: str = "question_id") -> DataFrame:
    """Of the first WINDOW evidence rows those of the least source priority among them; a missing priority is 99."""
    p = F.coalesce("priority", F.lit(99))
    first = evidence.filter(F.col("rank") <= WINDOW).withColumn("_p", p)
    return first.withColumn("_least", F.min("_p").over(Window.partitionBy(query))).filter("_p = _least").drop("_p", "_least")


def score_sentences(evidence: DataFrame, text: str = "content", terms: str = "terms", similarity: Column | None = None) -> DataFrame:
    """Quotable sentences with overlap and score: 0.6 similarity, 0.3 overlap, 0.05 for an early place and 0.05 for a high rank."""
    cut = evidence.select("*", F.posexplode(quotable_sentences(text)).alias("idx", "sentence"))
    overlap = term_overlap(F.col(terms), all_stems("sentence"))
    place = F.when(F.col("idx") == 0, 1.0).when(F.col("idx") == 1, 0.5).otherwise(0.0)
    near = F.lit(0.0) if similarity is None else similarity
    score = 0.6 * near + 0.3 * F.col("overlap") + 0.05 * place + 0.05 * (1 - (F.col("rank") - 1) / WINDOW)
    return cut.withColumn("overlap", overlap).withColumn("score", score)


def pick_summary(sentences: DataFrame, query: str = "question_id") -> DataFrame:
    """The best sentence that overlaps enough (wholly for a single term), first by rank and place on ties."""
    need = F.when(F.size("terms") == 1, 1.0).otherwise(SUMMARY_OVERLAP)
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), "rank", "idx")
    return sentences.filter(F.col("overlap") >= need).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def pick_details(sentences: DataFrame, summary: DataFrame, query: str = "question_id", document: str = "doc_id") -> DataFrame:
    """Up to DETAILS further sentences of the summary's document, best first, then in document order."""
    s = summary.select(query, F.col(document).alias("_d"), F.col("sentence").alias("_s"))
    fine = (F.col(document) == F.col("_d")) & (F.col("sentence") != F.col("_s")) & (F.col("overlap") >= DETAIL_OVERLAP) & (F.col("score") >= DETAIL_SCORE)
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), "rank", "idx")
    kept = sentences.join(s, query).filter(fine).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= DETAILS)
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy(query).orderBy("rank", "idx"))).drop("_d", "_s", "_k")


def shape_claims(drafts: DataFrame, most: int = 4, query: str = "question_id") -> DataFrame:
    """Drafts without empty texts; the first summary stays one, later ones become details; at most ``most`` details."""
    real = drafts.filter(F.trim("text") != "")
    nth = F.row_number().over(Window.partitionBy(query, "role").orderBy("ordinal"))
    role = F.when((F.col("role") == "summary") & (nth == 1), "summary").otherwise("detail")
    turned = real.withColumn("_r", role).drop("role").withColumnRenamed("_r", "role")
    k = F.row_number().over(Window.partitionBy(query, "role").orderBy("ordinal"))
    return turned.withColumn("_k", k).filter((F.col("role") == "summary") | (F.col("_k") <= most)).drop("_k")


def build_prompts(questions: DataFrame, evidence: DataFrame, query: str = "question_id") -> DataFrame:
    """One text per question: the question and its delimited, sanitised evidence in rank order."""
    block = F.concat(F.lit("<evidence ref="), F.col("ref"), F.lit(">\n"), sanitize("title"), F.lit("\n"), sanitize("content"), F.lit("\n</evidence>"))
    parts = evidence.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))).alias("_e"))
    text = F.array_join(F.transform(F.coalesce("_e", F.array().cast("array<struct<rank:int,text:string>>")), lambda e: e["text"]), "\n")
    return questions.join(parts, query, "left").select(query, F.concat(F.lit("Question: "), sanitize("question"), F.lit("\n"), text).alias("prompt"))


def top_priority(evidence: DataFrame, query: str = "question_id") -> DataFrame:
    """Evidence of the least source priority of its question."""
    p = F.coalesce("priority", F.lit(99))
    return evidence.withColumn("_p", p).withColumn("_m", F.min("_p").over(Window.partitionBy(query))).filter("_p = _m").drop("_p", "_m")


def also_answered(answering: DataFrame, cited: DataFrame, query: str = "question_id") -> DataFrame:
    """Answering evidence whose url no kept claim cites, one per url, in rank order."""
    rest = answering.join(cited.select(query, "url").distinct(), [query, "url"], "left_anti")
    return rest.withColumn("_k", F.row_number().over(Window.partitionBy(query, "url").orderBy("rank"))).filter("_k = 1").drop("_k")


def lexical_support(claim: Column, evidence: Column, question: Column) -> Column:
    """Share of the claim's own terms that the evidence holds, as a stem or but for affixes of person, to three places.

    Own terms are those that are neither of the question nor query noise, yes or no.  Without own terms or evidence, and where
    claim and evidence are of different languages, support is 1: the check does not apply.
    """
    allowed = F.array_union(content_terms(question), F.array(*(light_stem(F.lit(w)) for w in (*V.QUERY_NOISE, *V.YES_NO))))
    own = F.array_except(content_terms(claim), allowed)

    def share(terms: Column) -> Column:
        held = F.array_distinct(all_stems(evidence))
        cores = bind(held, lambda h: F.array_union(h, F.transform(h, lambda t: F.concat(F.lit("core "), person_core(t)))))
        found = bind(cores, lambda h: F.filter(terms, lambda t: F.array_contains(h, t) | F.array_contains(h, F.concat(F.lit("core "), person_core(t)))))
        return F.round(F.size(found) / F.size(terms), 3)

    said = F.coalesce(evidence, F.lit(""))
    applies = (F.trim(said) != "") & (detect_language(F.coalesce(claim, F.lit(""))) == detect_language(said))
    return F.when(applies, bind(own, lambda t: F.when(F.size(t) == 0, F.lit(1.0)).otherwise(share(t)))).otherwise(F.lit(1.0))


def validate_questions(questions: DataFrame, text: str = "question", least: int = 2, most: int = 1000) -> DataFrame:
    """Questions with ``problem``: null when accepted.  A locale and a channel, where there are such columns, must be known or null."""
    n = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    problem = F.when(n < least, "too short").when(n > most, "too long")
    for column, known in (("locale", LOCALES), ("channel", CHANNELS)):
        if column in questions.columns:
            problem = problem.when(~F.coalesce(F.col(column).isin(*known), F.lit(True)), f"unknown {column}")
    return questions.withColumn("problem", problem)


def validate_replies(replies: DataFrame, option: str = "option_id", text: str = "text") -> DataFrame:
    """Replies to a clarification with ``problem``: an option of at most 64 characters or a text of at most 300 is needed."""
    said, chosen = F.trim(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(option), F.lit(""))
    problem = F.when(F.length(chosen) > 64, "option too long").when(F.length(said) > 300, "text too long").when((said == "") & (chosen == ""), "nothing said")
    return replies.withColumn("problem", problem)


def group_stages(trace: DataFrame, query: str = "question_id") -> DataFrame:
    """(query, place, group, status): every question's seven groups in order; blocked if a stage is blocked or failed, empty without stages."""
    pairs = F.create_map(*(F.lit(x) for g, stages in GROUPS.items() for s in stages for x in (s, g)))
    told = trace.withColumn("group", pairs[F.col("stage")]).filter("group IS NOT NULL").groupBy(query, "group").agg(
        F.when(F.bool_or(F.col("status").isin("blocked", "failed")), "blocked").otherwise("done").alias("status")
    )
    every = trace.select(query).distinct().select(query, F.posexplode(F.array(*map(F.lit, GROUPS))).alias("place", "group"))
    return every.join(told, [query, "group"], "left").select(query, "place", "group", F.coalesce("status", F.lit("empty")).alias("status"))
