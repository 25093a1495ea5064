"""Usage, cost, budget and governance aggregates over event-like logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.operators.scan import running

COOLDOWN_SECONDS = 60


def price_lookup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with their model's prices a million tokens; a model without an input or output price is unpriced.

    prices: model, price_in, price_cached, price_out; a missing cached price falls back to the input price.
    """
    both = F.col("price_in").isNotNull() & F.col("price_out").isNotNull()
    p = prices.select("model", *(F.when(both, c).alias(n) for n, c in (
        ("price_in", F.col("price_in")), ("price_cached", F.coalesce("price_cached", "price_in")), ("price_out", F.col("price_out")))))
    return usage.join(p, "model", "left")


def estimate_cost(tokens_in: Column, cached: Column, tokens_out: Column) -> Column:
    """Cost of a call from its prices, null where unpriced."""
    fresh = F.greatest(tokens_in - cached, F.lit(0))
    return (fresh * F.col("price_in") + cached * F.col("price_cached") + tokens_out * F.col("price_out")) / 1e6


def request_usage(usage: DataFrame, key: str) -> DataFrame:
    """Totals per request; one unpriced call makes the cost null."""
    call = F.col("api_call")
    total = lambda c: F.coalesce(F.sum(F.when(call, F.col(c))), F.lit(0))
    unpriced = F.bool_or(call & F.col("cost").isNull())
    return usage.groupBy(key).agg(
        F.count_if(call).alias("api_calls"), F.count_if(F.col("status") == "cache_hit").alias("cache_hits"),
        F.count_if(F.col("status") == "budget_exceeded").alias("refusals"),
        total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"),
        F.when(~unpriced, F.round(F.coalesce(F.sum(F.when(call, F.col("cost"))), F.lit(0.0)), 6)).alias("cost"),
    )


def cache_key(provider: Column, model: Column, settings: Column, task: Column, system: Column, user: Column, schema: Column, max_tokens: Column, version: int = 1) -> Column:
    """SHA-256 of the request as JSON with sorted keys.  ``settings`` and ``schema`` are JSON texts whose own keys are sorted."""
    told = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    parts = {
        "max_tokens": max_tokens.cast("string"), "model": told(model), "provider": told(provider), "schema": schema, "settings": settings,
        "system": told(system), "task": told(task), "user": told(user), "v": F.lit(str(version)),
    }
    pieces = [F.concat(F.lit(f'"{name}": '), F.coalesce(value, F.lit("null"))) for name, value in sorted(parts.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}")), 256)


def today_totals(usage: DataFrame, as_of: Column) -> DataFrame:
    """Calls and cost since the start of the day of ``as_of``."""
    today = usage.filter(F.col("api_call") & (F.col("ts") >= F.date_trunc("DAY", as_of)) & (F.col("ts") <= as_of))
    return today.agg(F.count(F.lit(1)).alias("api_calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


def usage_report(calls: DataFrame, answers: DataFrame, as_of: Column, session: str = "session_id") -> DataFrame:
    """Per scope, ``today`` (since the start of the day of ``as_of``) and every session: questions, those resolved without a model,
    calls, hits and their rate, refusals, tokens, cost, cost a question, unpriced calls.

    calls: (session, ts, status, api_call, input_tokens, output_tokens, cost); answers: (session, ts, model_calls), an answer whose
    model calls were not recorded being left out.  Rates without a denominator are null.
    """
    def scoped(df: DataFrame) -> DataFrame:
        today = F.when((F.col("ts") >= F.date_trunc("DAY", as_of)) & (F.col("ts") <= as_of), F.lit("today"))
        return df.withColumn("scope", F.explode(F.array_compact(F.array(today, F.concat(F.lit("session "), F.col(session).cast("string"))))))

    call = F.col("api_call")
    total = lambda c: F.coalesce(F.sum(F.when(call, F.col(c))), F.lit(0))
    made = scoped(calls).groupBy("scope").agg(
        F.count_if(call).alias("api_calls"), F.count_if(F.col("status") == "cache_hit").alias("cache_hits"),
        F.count_if(F.col("status") == "budget_exceeded").alias("refusals"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("_cost"), F.count_if(call & F.col("cost").isNull()).alias("unpriced_calls"),
    )
    asked = scoped(answers.filter(F.col("model_calls").isNotNull())).groupBy("scope").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("model_calls") == 0).alias("resolved_without")
    )
    both = made.join(asked, "scope", "full_outer")
    counts = [c for c in both.columns if c not in ("scope", "_cost")]
    both = both.na.fill(0, counts).na.fill(0.0, ["_cost"])
    some = lambda c: F.nullif(c, F.lit(0))
    near = lambda c, digits: F.round(F.round(c, 9), digits)  # noqa: E731  halves go up, whatever the order of adding left behind
    return both.select(
        "scope", *counts, near(F.col("cache_hits") / some(F.col("api_calls") + F.col("cache_hits")), 3).alias("hit_rate"),
        near(F.col("_cost"), 4).alias("cost"), near(F.col("_cost") / some(F.col("questions")), 5).alias("cost_per_question"),
    )


def budget_gate(usage: DataFrame, max_calls: int = 0, max_cost: float = 0.0, pending: str | None = None) -> DataFrame:
    """Each call with the calls and the cost made before it that day; refused once either limit is reached; 0 switches a limit off.

    From the first refusal of a day on every call of that day is refused, so both totals stand still.  ``pending`` names the question
    a call belongs to: costs count when their question is over, so those of the question's own earlier calls are left out.
    Costs are summed in nano-units, so that no order of adding matters.
    """
    nano = F.coalesce(F.round(F.col("cost") * 1e9).cast("long"), F.lit(0)) if "cost" in usage.columns else F.lit(0).cast("long")
    rows = usage.select(
        "event_id", "ts", "api_call", F.date_trunc("DAY", F.col("ts")).alias("day"), (F.col(pending) if pending else F.lit(0)).alias("asked"),
        F.col("api_call").cast("long").alias("call"), F.when(F.col("api_call"), nano).otherwise(0).alias("nano"),
    )
    before = running(rows, ["day"], ["ts", "event_id"], {"calls": ("call", "sum"), "spent": ("nano", "sum")})
    if pending:
        own = Window.partitionBy("day", "asked").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        before = before.withColumn("spent", F.col("spent") - F.coalesce(F.sum("nano").over(own), F.lit(0)))
    full = (F.lit(max_calls > 0) & (F.col("calls") >= max_calls)) | (F.lit(max_cost > 0) & (F.col("spent") >= round(max_cost * 1e9)))
    told = before.withColumn("refused", F.col("api_call") & full)
    first = told.filter("refused").groupBy(F.col("day").alias("_day")).agg(F.min_by(F.struct("calls", "spent", "ts", "event_id"), F.struct("ts", "event_id")).alias("stop"))
    told = told.join(first, F.col("day") == F.col("_day"), "left")  # a row for each day
    late = F.col("stop").isNotNull() & (F.struct("ts", "event_id") >= F.struct("stop.ts", "stop.event_id"))
    held = lambda name: F.when(late, F.col(f"stop.{name}")).otherwise(F.col(name))
    return told.select("event_id", held("calls").alias("made"), (held("spent") / 1e9).alias("spent"), (F.col("api_call") & (F.col("refused") | late)).alias("refused"))


def cooldown_filter(usage: DataFrame, failed: Column, seconds: int = COOLDOWN_SECONDS, key: str = "model") -> DataFrame:
    """Calls refused because a failure of the same model happened within ``seconds`` before them."""
    at = F.col("ts").cast("timestamp").cast("double")
    rows = usage.select("event_id", "ts", key, at.alias("_at"), F.when(failed, at).alias("_failed"))
    last = running(rows, [key], ["ts", "event_id"], {"_last": ("_failed", "max")})
    return last.select("event_id", F.coalesce(F.col("_at") - F.col("_last") < seconds, F.lit(False)).alias("refused"))


def routing_simulation(answers: DataFrame) -> DataFrame:
    return answers.groupBy("outcome").agg(F.count(F.lit(1)).alias("questions"))


def sources_with_counts(sources: DataFrame, docs: DataFrame, units: DataFrame) -> DataFrame:
    """Documents, disabled documents and units of each source, zeros included."""
    d = docs.groupBy(F.col("source_slug").alias("slug")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "disabled").alias("disabled")
    )
    u = units.groupBy(F.col("source_slug").alias("slug")).agg(F.count(F.lit(1)).alias("units"))
    out = sources.join(d, "slug", "left").join(u, "slug", "left")
    return out.na.fill(0, ["documents", "disabled", "units"])


def list_sources(sources: DataFrame) -> DataFrame:
    """Approved, then pending, then the rest; by priority with missing ones last."""
    rank = F.when(F.col("status") == "approved", 0).when(F.col("status") == "pending", 1).otherwise(2)
    return sources.orderBy(rank, F.col("priority").asc_nulls_last(), "slug")


def outcome_share(answers: DataFrame) -> DataFrame:
    counted = answers.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


GAP_REASONS = ("no_source", "weak_evidence", "verification_failed", "unresolved_conflict")


def content_gaps(questions: DataFrame, answers: DataFrame, normalized: Column, as_of: Column, days: int = 30, limit: int = 10) -> DataFrame:
    """Most frequent questions of the last ``days`` days that were abstained from for want of content, by normalised text:
    the least wording and reason, how many, and when last; more first, then later ones, then the key."""
    lately = (F.col("at") > as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("at") <= as_of)
    rows = answers.filter((F.col("outcome") == "abstention") & F.col("reason").isin(*GAP_REASONS)).withColumn("_now", as_of).filter(lately)
    gaps = rows.drop("_now").join(questions, "question_id").groupBy(normalized.alias("key"))
    found = gaps.agg(F.min("question").alias("question"), F.min("reason").alias("reason"), F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    return found.orderBy(F.col("n").desc(), F.col("last").desc(), "key").limit(limit)


def overview_totals(sources: DataFrame, documents: DataFrame, units: DataFrame, questions: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: approved sources, active documents, units, questions, and questions of the last ``days`` days."""
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    recent = F.count_if((F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= as_of))
    parts = [
        total(sources.filter("status = 'approved'"), "sources"), total(documents.filter("status = 'active'"), "documents"),
        total(units, "units"), questions.agg(F.count(F.lit(1)).alias("questions"), recent.alias("questions_lately")),
    ]
    return reduce(DataFrame.join, parts)  # single rows


def citations_by_source(answers: DataFrame, evidence: DataFrame, claims: DataFrame, query: str = "question_id") -> DataFrame:
    """(source_slug, answers): answers of which a kept claim cites evidence of the source.

    answers: (query, outcome); evidence: (query, ref, source_slug); claims: (query, kept, refs).
    """
    cited = claims.filter("kept").select(query, F.explode("refs").alias("ref")).distinct()
    found = evidence.join(cited, [query, "ref"], "left_semi").join(answers.filter("outcome = 'answer'"), query, "left_semi")
    return found.groupBy("source_slug").agg(F.countDistinct(query).alias("answers"))


def delete_sources(gone: DataFrame, sources: DataFrame, documents: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, documents and units without the sources in ``gone`` (slug) and all that is theirs."""
    names = gone.select(F.col("slug").alias("source_slug")).distinct()
    kept = documents.join(names, "source_slug", "left_anti")
    return sources.join(gone.select("slug").distinct(), "slug", "left_anti"), kept, units.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")


def sessionize(events: DataFrame, key: str = "session_id") -> DataFrame:
    """First and last time and last status of each session."""
    return events.groupBy(key).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("status", F.struct("ts", "event_id")).alias("last_status")
    )


def sources_searched(sources: DataFrame, units: DataFrame) -> DataFrame:
    """Whether each source was searched, or why not."""
    n = units.groupBy(F.col("source_slug").alias("slug")).agg(F.count(F.lit(1)).alias("units"))
    state = F.when(F.col("status") != "approved", F.col("status")).when(F.col("units") == 0, "not_indexed").otherwise("searched")
    return sources.join(n, "slug", "left").na.fill(0, ["units"]).select("slug", "units", state.alias("state"))
