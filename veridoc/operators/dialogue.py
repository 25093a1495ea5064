"""Courtesy, intent, replies to clarifications, escalation and localised messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import bind, normalize

MAX_GENERAL_REPLY, READINGS = 400, 3


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def small_talk(text: str | Column, phrases: dict[str, str], fillers: list[str]) -> Column:
    """Kinds of courtesy that make up the whole message, distinct and in order; null if anything else is said or nothing is.

    ``phrases`` maps a normalised phrase to its kind; at each place the longest phrase is taken, else one filler word.
    """
    longest = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    parts = F.regexp_extract_all(normalize(text), F.lit(rf"({longest}|[^ ]+)(?: |\z)"), F.lit(1))
    kind, filler = _lookup(phrases), F.array(*map(F.lit, fillers))

    def judge(found: Column) -> Column:
        foreign = F.exists(found, lambda p: kind[p].isNull() & ~F.array_contains(filler, p))
        kinds = F.array_distinct(F.filter(F.transform(found, lambda p: kind[p]), lambda k: k.isNotNull()))
        return F.when(~foreign & (F.size(kinds) > 0), kinds)

    return bind(parts, judge)


def courtesy_reply(kinds: Column, replies: dict[str, str], invite: str, again: str, after: list[str], separator: str = ". ") -> Column:
    """The replies in order, then an invitation unless the last kind is bye; after thanks and the like, the second invitation."""
    said, last = _lookup(replies), F.element_at(kinds, -1)
    text = F.array_join(F.transform(kinds, lambda k: said[k]), separator)
    asked = F.when(last.isin(*after), F.lit(". " + again)).otherwise(F.lit(". " + invite))
    return F.concat(text, F.when(last == "bye", F.lit("")).otherwise(asked))


def classify_intent(courtesy: Column, religious: Column) -> Column:
    """greeting when the message is courtesy only, else by its religious terms."""
    return F.when(courtesy.isNotNull(), "greeting").when(F.coalesce(religious, F.lit(False)), "fiqh_question").otherwise("unknown")


def localized_reason(rows: DataFrame, messages: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """Rows with ``message`` in their language, in English where that is missing.  messages: (code, language, message), unique."""
    m = messages.select(F.col("code").alias("_c"), F.col("language").alias("_l"), F.col("message").alias("_m"))
    own = rows.join(m, (F.col(code) == F.col("_c")) & (F.col(language) == F.col("_l")), "left").drop("_c", "_l")
    english = m.filter("_l = 'en'").select("_c", F.col("_m").alias("_e"))
    return own.join(english, F.col(code) == F.col("_c"), "left").withColumn("message", F.coalesce("_m", "_e")).drop("_c", "_m", "_e")


def topic_labels(found: DataFrame, labels: DataFrame, query: str = "question_id") -> DataFrame:
    """Per question the labels of its topics in its language (English where missing), in order; unknown topics have none.

    found: (query, ord, topic, language); labels: (topic, language, label).
    """
    names = labels.select(F.col("topic").alias("code"), "language", F.col("label").alias("message"))
    named = localized_reason(found, names, "topic").filter("message IS NOT NULL")
    listed = named.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("ord", "message"))).alias("_l"))
    return listed.select(query, F.transform("_l", lambda x: x["message"]).alias("labels"))


def sensitive_notice(labels: Column, template: Column, language: Column) -> Column:
    """The notice with its topic names in place of ``{topics}``, joined as the language does."""
    names = F.when(language.isin("ar", "ur"), F.array_join(labels, "، ")).otherwise(F.array_join(labels, ", "))
    return F.replace(template, F.lit("{topics}"), names)


def completion_text(replies: DataFrame, options: DataFrame) -> DataFrame:
    """Replies with ``completion``: the free text if any, else the chosen option's text; null for an unknown option.

    replies: (rule_id, option_id, free_text, language); options: (rule_id, option_id, append_ar, append_en), unique.
    """
    free = F.nullif(F.trim("free_text"), F.lit(""))
    given = F.when(F.col("language") == "en", F.col("append_en")).otherwise(F.col("append_ar"))
    joined = replies.join(options.select("rule_id", "option_id", "append_ar", "append_en"), ["rule_id", "option_id"], "left")
    return joined.withColumn("completion", F.coalesce(free, given)).drop("append_ar", "append_en")


def verified_bodies(cases: DataFrame, bodies: DataFrame, query: str = "question_id") -> DataFrame:
    """(query, body_id, place): active bodies that share a topic with the case, by id.  Both sides hold an array ``topics``."""
    asked = cases.select(query, F.explode("topics").alias("topic"))
    offered = bodies.filter("active").select("body_id", F.explode("topics").alias("topic"))
    met = asked.join(offered, "topic").select(query, "body_id").distinct()
    return met.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("body_id")))


def build_escalation(cases: DataFrame, bodies: DataFrame, related: DataFrame, query: str = "question_id", document: str = "doc_id") -> DataFrame:
    """Cases with the bodies that fit, at most READINGS related documents in rank order, and the code of their message."""
    met = verified_bodies(cases, bodies, query).groupBy(query).agg(F.array_sort(F.collect_list("body_id")).alias("bodies"))
    first = related.groupBy(query, document).agg(F.min("rank").alias("_rank"))
    best = first.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy("_rank"))).filter(F.col("_n") <= READINGS)
    read = best.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(document).alias("d")))).alias("_r"))
    joined = cases.join(met, query, "left").join(read, query, "left")
    readings = F.coalesce(F.transform("_r", lambda x: x["d"]), F.array())
    code = F.when(F.col("bodies").isNotNull(), "escalation").otherwise("no_verified_bodies")
    return joined.select(*cases.columns, F.coalesce("bodies", F.array()).alias("bodies"), readings.alias("readings"), code.alias("code"))


def general_reply(text: Column, invite: Column, fallback: Column) -> Column:
    """A short reply without its questions, then the invitation; the fallback where nothing is left or it is too long."""
    kept = F.trim(F.regexp_replace(text, r"[^.!?؟।۔]*[?؟]\s*", ""))
    fits = (F.length(kept) > 0) & (F.length(kept) <= MAX_GENERAL_REPLY)
    return F.when(fits, F.concat_ws(" ", kept, invite)).otherwise(fallback)
