"""Status changes with their audit trail, listings, the answer cache, and rules on outcomes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.operators.scan import numbered

MIN_CLAIM_TOKENS = 4


def set_status(rows: DataFrame, changes: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with their new status, audit rows from/to).  changes: key, new_status, actor; an equal status is no change."""
    joined = rows.join(changes.select(key, "new_status", "actor"), key, "left")
    moved = F.col("new_status").isNotNull() & (F.col("new_status") != F.col("status"))
    audit = joined.filter(moved).select(F.lit("status.changed").alias("action"), F.col(key).alias("target"), "actor",
                                        F.col("status").alias("from_status"), F.col("new_status").alias("to_status"), at.alias("at"))
    return joined.withColumn("status", F.coalesce("new_status", "status")).select(*rows.columns), audit


def audit_latest(audit: DataFrame, limit: int = 100, at: str = "at", key: str = "id") -> DataFrame:
    """The newest audit rows."""
    return audit.orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit)


def audit_filter(audit: DataFrame, what: str = "all", action: str = "action") -> DataFrame:
    """All rows, those on questions, or those on sources and documents."""
    kinds = {"all": F.lit(True), "questions": F.col(action).startswith("question."), "governance": F.col(action).rlike(r"^(source|document)\.")}
    return audit.filter(kinds[what])


def admin_sources(sources: DataFrame) -> DataFrame:
    """Sources with their place: by priority, those without one last, then slug."""
    last = sources.withColumn("_none", F.col("priority").isNull())
    return numbered(last, ["_none", "priority", "slug"], "place").drop("_none")


def outcome_counts(answers: DataFrame, at: str, as_of: Column, days: int = 30) -> DataFrame:
    """Outcomes of the last ``days`` days."""
    recent = answers.filter((F.col(at) > as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col(at) <= as_of))
    return recent.groupBy("outcome").agg(F.count(F.lit(1)).alias("answers"))


def invalidate_embeddings(units: DataFrame, model: str) -> DataFrame:
    """Units whose vector is of another model lose vector and model."""
    fine = F.col("model").eqNullSafe(F.lit(model))
    return units.withColumn("embedding", F.when(fine, F.col("embedding"))).withColumn("model", F.when(fine, F.col("model")))


def cache_lookup(requests: DataFrame, cache: DataFrame, ttl_seconds: int, key: str = "key", at: str = "ts") -> DataFrame:
    """Requests with whether the cache holds their key, stored before the request and younger than the time to live."""
    stored = cache.select(key, F.col("created_at").alias("_stored"))
    age = F.col(at).cast("double") - F.col("_stored").cast("double")
    return requests.join(stored, key, "left").withColumn("hit", F.coalesce((age >= 0) & (age < ttl_seconds), F.lit(False))).drop("_stored")


def cache_evict(cache: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """The cache without keys stored by questions that ended without a verified answer."""
    return cache.join(answers.filter(F.col("outcome") != "answer").select(key), key, "left_anti")


def verify_integrity(snapshots: DataFrame, computed: Column, declared: str = "content_sha256") -> DataFrame:
    """Rows whose declared hash is not the computed one."""
    return snapshots.filter(~F.col(declared).eqNullSafe(computed))


def apply_entailment(claims: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """External labels for claims that are not checked yet, cite validly and are grounded; without a label they stay so."""
    open_ = (F.col("entailment") == "not_checked") & F.col("valid") & F.col("grounded")
    joined = claims.join(labels.select(*keys, F.col("label").alias("_label")), keys, "left")
    return joined.withColumn("entailment", F.when(open_, F.coalesce("_label", "entailment")).otherwise(F.col("entailment"))).drop("_label")


def feedback(claims: DataFrame, query: str = "question_id") -> DataFrame:
    """One text per question with a line for each unsupported claim, in order."""
    line = F.concat(F.lit("- "), F.col("text"))
    lines = claims.filter(~F.col("supported")).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("_l"))
    return lines.select(query, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("feedback"))


def too_short(claims: DataFrame, tokens: Column, least: int = MIN_CLAIM_TOKENS) -> DataFrame:
    """Claims of too few tokens to be looked up."""
    return claims.filter(F.size(tokens) < least)


def may_clarify(language: Column, kind: Column, level: Column, parent: Column) -> Column:
    """Whether a question may be asked back: Arabic or English, no greeting, not personal or high-risk, not a reply itself."""
    return language.isin("ar", "en") & (kind != "greeting") & level.isin("general", "sensitive_topic") & parent.isNull()


def apply_scope_label(kind: Column, label: Column, language: Column) -> Column:
    """An external label puts only an unknown question out of scope; a greeting in another language is unknown."""
    own = F.when((kind == "greeting") & ~language.isin("ar", "en"), F.lit("unknown")).otherwise(kind)
    return F.when((own == "unknown") & F.coalesce(label == "not_religious", F.lit(False)), F.lit("out_of_scope")).otherwise(own)


def best_of_rewrites(runs: DataFrame, query: str = "question_id") -> DataFrame:
    """Of each question's runs (variant 0 is the original) the sufficient one, then the higher score; ties keep the original."""
    order = Window.partitionBy(query).orderBy(F.col("sufficient").desc(), F.col("score").desc(), "variant")
    return runs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def weighted_coverage(candidates: DataFrame, terms: DataFrame, held: DataFrame, idf: DataFrame, unseen: float, query: str = "question_id",
                      unit: str = "unit_id") -> DataFrame:
    """Share of the terms' idf that a candidate holds.  terms: (query, term); held: (unit, term); a term without idf counts ``unseen``."""
    own = terms.join(idf.select("term", "idf"), "term", "left").na.fill({"idf": unseen})
    total = own.groupBy(query).agg(F.sum("idf").alias("_all"))
    hit = candidates.select(query, unit).join(own, query).join(held.select(unit, "term").distinct(), [unit, "term"])
    got = hit.groupBy(query, unit).agg(F.sum("idf").alias("_got"))
    share = F.round(F.coalesce(F.col("_got"), F.lit(0.0)) / F.col("_all"), 9)
    return candidates.join(total, query).join(got, [query, unit], "left").withColumn("weighted_coverage", share).drop("_all", "_got")


def nearest_documents(found: DataFrame, documents: DataFrame, k: int, query: str = "query_id", item: str = "vec_id", document: str = "doc_id") -> DataFrame:
    """Of ranked items the best of each document, the k best documents with refs E1, E2, …"""
    best = Window.partitionBy(query, document).orderBy("rank")
    firsts = found.join(documents, item).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    return firsts.withColumn("doc_rank", place).filter(F.col("doc_rank") <= k).withColumn("ref", F.concat(F.lit("E"), "doc_rank"))


def outcome_rates(answers: DataFrame, variant: str) -> DataFrame:
    """Percentages of each outcome per variant and over all."""
    rate = lambda o: F.round(100 * F.avg((F.col("outcome") == o).cast("int")), 6).alias(o)
    out = answers.rollup(variant).agg(F.count(F.lit(1)).alias("n"), *map(rate, ("answer", "abstention", "clarification", "escalation")))
    return out.withColumn(variant, F.coalesce(F.col(variant).cast("string"), F.lit("all")))


def cache_store(cache: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """The cache with the entries in place of older ones of their key; of several entries with one key the newest is kept."""
    newest = Window.partitionBy(key).orderBy(F.col("created_at").desc())
    fresh = entries.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(*cache.columns)
    return cache.join(fresh, key, "left_anti").select(*cache.columns).unionByName(fresh)


def source_detail(sources: DataFrame, documents: DataFrame, slug: str, most: int = 500, source: str = "source_slug") -> DataFrame:
    """One source with its first ``most`` documents by title."""
    listed = documents.filter(F.col(source) == slug).orderBy("title", "doc_id").limit(most)
    own = sources.filter(F.col("slug") == slug)
    return own.join(listed.withColumnRenamed(source, "slug").drop("status", "priority"), "slug", "left")
