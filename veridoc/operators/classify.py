"""Lexicon matching and rule-based classification of questions.

A lexicon is a small table (kind, topic, ord, term).  Matching is an equi-join on token variants for single words and a
containment join for phrases, so it scales with the questions; the lexicon's size is the rule files' size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import fixed_values as V
from veridoc.functions.text import normalize, tokens

LEVELS = ("general", "sensitive_topic", "personal_case", "high_risk")


def token_variants(c: str | Column) -> Column:
    """Tokens, tokens without a leading clitic, and tokens without an article prefix."""
    t = tokens(c)
    bare = F.transform(t, lambda x: F.when(F.length(x) > 3, F.regexp_replace(x, f"^[{V.CLITICS}]", "")).otherwise(x))
    cut = F.transform(t, lambda x: F.regexp_replace(x, f"^(?:{'|'.join(V.PREFIXES)})(?=.{{2,}}$)", ""))
    return F.array_distinct(F.concat(t, bare, cut))


def term_hits(questions: DataFrame, lexicon: DataFrame, query: str = "question_id", text: str = "question") -> DataFrame:
    """(question, kind, topic, ord, term) of every lexicon term a question holds."""
    terms = lexicon.select("kind", "topic", "ord", "term", normalize("term").alias("_n")).filter("_n <> ''")
    single, phrase = terms.filter(~F.col("_n").contains(" ")), terms.filter(F.col("_n").contains(" "))
    asked = questions.select(query, F.explode(token_variants(text)).alias("_v"))
    bare = F.when(F.col("_n").startswith("ال"), F.expr("substring(_n, 3)"))
    forms = single.withColumn("_v", F.explode(F.array_compact(F.array(F.col("_n"), bare))))
    one = asked.join(forms, "_v").select(query, "kind", "topic", "ord", "term").distinct()
    padded = questions.select(query, F.concat(F.lit(" "), normalize(text), F.lit(" ")).alias("_p"))
    held = F.contains(F.col("_p"), F.concat(F.lit(" "), F.col("_n"), F.lit(" ")))
    # Phrases meet questions through their first word, not through a product of both tables.
    heads = padded.select(query, "_p", F.explode(F.array_distinct(F.split(F.trim("_p"), " "))).alias("_h"))
    many = heads.join(phrase.withColumn("_h", F.substring_index("_n", " ", 1)), "_h").filter(held)
    return one.unionByName(many.select(query, "kind", "topic", "ord", "term")).distinct()


def matches(questions: DataFrame, lexicon: DataFrame, query: str = "question_id", text: str = "question") -> DataFrame:
    """``questions`` with the lexicon terms each holds (``matched``), in the lexicon's order; equal terms of two entries come twice."""
    hits = term_hits(questions, lexicon, query, text)
    own = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term", "kind", "topic"))), lambda h: h["term"])
    found = hits.groupBy(F.col(query).alias("_q")).agg(own.alias("matched"))
    return questions.join(found, F.col(query) == F.col("_q"), "left").drop("_q").withColumn("matched", F.coalesce("matched", _NONE()))


def _NONE() -> Column:  # noqa: N802
    return F.array().cast("array<string>")


def classify_sensitivity(questions: DataFrame, lexicon: DataFrame, query: str = "question_id", text: str = "question") -> DataFrame:
    """One row per question: level, topics, terms and markers, each in the order of the lexicon.

    A high-risk term settles the level; topics and terms are then those of high risk alone, and markers are not looked at.
    """
    hits = term_hits(questions, lexicon, query, text)
    of = lambda kind, field: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", F.col(field).alias("x"))))), lambda h: h["x"])
    per = hits.groupBy(F.col(query).alias("_q")).agg(
        of("high_risk", "term").alias("_risk"), F.array_distinct(of("topic", "topic")).alias("_topics"),
        of("topic", "term").alias("_terms"), of("personal", "term").alias("_markers"),
    )
    out = questions.select(query).join(per, F.col(query) == F.col("_q"), "left")
    for c in ("_risk", "_topics", "_terms", "_markers"):
        out = out.withColumn(c, F.coalesce(c, _NONE()))
    risk, some = F.size("_risk") > 0, F.size("_topics") > 0
    level = F.when(risk, "high_risk").when(some & (F.size("_markers") > 0), "personal_case").when(some, "sensitive_topic").otherwise("general")
    return out.select(
        query, level.alias("level"), F.when(risk, F.array(F.lit("high_risk"))).otherwise(F.col("_topics")).alias("topics"),
        F.when(risk, F.col("_risk")).otherwise(F.col("_terms")).alias("terms"), F.when(risk, _NONE()).otherwise(F.col("_markers")).alias("markers"),
    )


def max_level(a: Column, b: Column) -> Column:
    """The graver of two levels."""
    names = F.array(*(F.lit(x) for x in LEVELS))
    return F.element_at(names, F.greatest(F.array_position(names, a), F.array_position(names, b)).cast("int"))


def raise_with_labels(rules: DataFrame, labels: DataFrame, query: str = "question_id") -> DataFrame:
    """An external label (level, topics) may only raise the level; topics are joined and sorted.

    A label of a sensitive topic or a personal case that names no topic counts as general.
    """
    own = F.coalesce("topics", _NONE()) if "topics" in labels.columns else _NONE()
    l = labels.select(F.col(query).alias("_q"), F.col("level").alias("_l"), own.alias("_t"))
    vague = F.col("_l").isin("sensitive_topic", "personal_case") & (F.size("_t") == 0)
    joined = rules.join(l, F.col(query) == F.col("_q"), "left")
    raised = max_level(F.col("level"), F.when(vague, "general").otherwise(F.coalesce("_l", F.lit("general"))))
    topics = F.array_sort(F.array_union("topics", F.coalesce("_t", _NONE())))
    return joined.withColumn("level", raised).withColumn("topics", topics).drop("_q", "_l", "_t")


def missing_slot(questions: DataFrame, rules: DataFrame, query: str = "question_id", text: str = "question") -> DataFrame:
    """First rule (by ord) with a trigger, its context if it has any, a first-person marker if it asks for one, and no exception.

    rules: (rule, ord, role, term) with roles when, context, unless, and first_person, whose terms are the markers; a rule without
    rows of that role does not ask for one.
    """
    asks = lambda role: F.bool_or(F.col("role") == role)
    needs = rules.groupBy("rule", "ord").agg(asks("context").alias("_context"), asks("first_person").alias("_person"))
    hits = term_hits(questions, rules.select(F.col("role").alias("kind"), F.col("rule").alias("topic"), "ord", "term"), query, text)
    per = hits.groupBy(query, F.col("topic").alias("rule"), "ord").agg(*(F.bool_or(F.col("kind") == r).alias(r) for r in ("when", "context", "unless", "first_person")))
    met = F.col("when") & (~F.col("_context") | F.col("context")) & (~F.col("_person") | F.col("first_person")) & ~F.col("unless")
    first = per.join(needs, ["rule", "ord"]).filter(met).groupBy(F.col(query).alias("_q")).agg(F.min_by("rule", "ord").alias("rule"))
    return questions.select(query).join(first, F.col(query) == F.col("_q"), "left").drop("_q")


def route(questions: DataFrame) -> DataFrame:
    """Outcome per question from kind, level, slot, verdict and decision columns, in order of precedence."""
    outcome = (
        F.when(F.col("kind") == "greeting", "small_talk").when(F.col("kind") == "out_of_scope", "out_of_scope")
        .when(F.col("level").isin("high_risk", "personal_case"), "escalation").when(F.col("slot").isNotNull(), "clarification")
        .when(F.col("verdict") != "sufficient", "abstention").when(F.col("decision") == "answer", "answer").otherwise("abstention")
    )
    return questions.withColumn("outcome", outcome)
