"""Registered queries of status changes, the cache, and rules on outcomes and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.functions.shared import written
from veridoc.operators import governance as g
from veridoc.operators import retrieval, sparse
from veridoc.plans.queries import _APPROVED, _POST, _SPARSE, _TERMS, _TOP, NORM, _approved, _asked_terms, _nearest, _questions, query, table
from veridoc.sources.views import view

_CLAIM = "SELECT question_id, turn AS ordinal, question AS text, turn % 3 = 0 AS supported, question_id % 2 = 0 AS valid, turn % 2 = 0 AS grounded, CASE WHEN turn % 4 = 0 THEN 'verbatim' ELSE 'not_checked' END AS entailment FROM v_question_log"


def _claims(spark, d):
    q = view(spark, d, "v_question_log").select("question_id", F.col("turn").alias("ordinal"), F.col("question").alias("text"), "session_id")
    return q.select("*", (F.col("ordinal") % 3 == 0).alias("supported"), (F.col("question_id") % 2 == 0).alias("valid"), (F.col("ordinal") % 2 == 0).alias("grounded"),
                    F.when(F.col("ordinal") % 4 == 0, "verbatim").otherwise("not_checked").alias("entailment"))


def _changes(spark, d):
    return view(spark, d, "v_sources").filter("priority is not null").select("slug", F.when(F.col("priority") % 2 == 0, "blocked").otherwise("approved").alias("new_status"), F.lit("x").alias("actor"))


@query("SELECT slug, CASE WHEN priority IS NULL THEN status WHEN priority % 2 = 0 THEN 'blocked' ELSE 'approved' END AS status FROM v_sources")
def D9_set_status(spark, d):
    rows, _ = g.set_status(view(spark, d, "v_sources"), _changes(spark, d), "slug", F.lit("now"))
    return rows.select("slug", "status")


@query("SELECT slug AS target, status AS from_status, 'blocked' AS to_status FROM v_sources WHERE priority % 2 = 0 AND status <> 'blocked'")
def D9_status_audit(spark, d):
    return g.set_status(view(spark, d, "v_sources"), _changes(spark, d), "slug", F.lit("now"))[1].select("target", "from_status", "to_status")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def D10_audit_latest(spark, d):
    return g.audit_latest(table(spark, d, "events").select("event_id", "ts"), 100, "ts", "event_id")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'question.view' WHEN 'click' THEN 'source.click' ELSE 'document.other' END AS action FROM events WHERE event_type <> 'view'")
def D11_audit_filter(spark, d):
    action = F.when(F.col("event_type") == "view", "question.view").when(F.col("event_type") == "click", "source.click").otherwise("document.other")
    return g.audit_filter(table(spark, d, "events").select("event_id", action.alias("action")), "governance")


@query("SELECT slug, row_number() OVER (ORDER BY priority NULLS LAST, slug) AS place FROM v_sources")
def D4_admin_sources(spark, d):
    return g.admin_sources(view(spark, d, "v_sources")).select("slug", "place")


@query("""SELECT event_type AS outcome, count(*) AS answers FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def D6_outcome_counts(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    joined = e.join(F.broadcast(last)).withColumnRenamed("event_type", "outcome")
    return g.outcome_counts(joined, "ts", F.col("last"), 7)


@query("SELECT vec_id, label % 2 = 0 AS kept FROM embeddings")
def D15_invalidate_embeddings(spark, d):
    e = table(spark, d, "embeddings").withColumn("model", F.when(F.col("label") % 2 == 0, "new").otherwise("old"))
    return g.invalidate_embeddings(e, "new").select("vec_id", F.col("embedding").isNotNull().alias("kept"))


_CACHE = "SELECT user_id AS key, min(ts) AS created_at FROM events GROUP BY 1"


@query(f"SELECT e.event_id, e.ts >= c.created_at AND e.ts < c.created_at + INTERVAL 1 DAY AS hit FROM events e JOIN ({_CACHE}) c ON c.key = e.user_id")
def U7_cache_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    cache = e.groupBy("key").agg(F.min("ts").alias("created_at"))
    return g.cache_lookup(e, cache, 86400).select("event_id", "hit")


@query("SELECT conv_id AS key FROM (SELECT DISTINCT conv_id FROM v_answers) c WHERE conv_id NOT IN (SELECT conv_id FROM v_answers WHERE outcome <> 'answer')")
def U9_cache_evict(spark, d):
    a = view(spark, d, "v_answers").select(F.col("conv_id").alias("key"), "outcome")
    return g.cache_evict(a.select("key").distinct(), a)


@query("SELECT n.doc_id FROM v_docs_next n JOIN v_docs o ON o.doc_id = n.doc_id WHERE o.body <> n.body")
def S2_verify_integrity(spark, d):
    old = view(spark, d, "v_docs").select("doc_id", "content_sha256")
    found = view(spark, d, "v_docs_next").join(old, "doc_id")
    return g.verify_integrity(found, F.sha2(F.concat(F.lit("\n\n"), "body"), 256)).select("doc_id")


@query(f"SELECT question_id, CASE WHEN entailment = 'not_checked' AND valid AND grounded AND question_id % 5 < 3 THEN 'entailed' ELSE entailment END AS entailment FROM ({_CLAIM}) c")
def X8_apply_entailment(spark, d):
    c = _claims(spark, d)
    labels = c.filter("question_id % 5 < 3").select("question_id", "ordinal", F.lit("entailed").alias("label"))
    return g.apply_entailment(c, labels, ["question_id", "ordinal"]).select("question_id", "entailment")


@query("SELECT session_id AS question_id, string_agg('- ' || question, chr(10) ORDER BY turn) AS feedback FROM v_question_log WHERE turn % 3 <> 0 GROUP BY 1")
def X11_feedback(spark, d):
    return g.feedback(_claims(spark, d).drop("question_id").withColumnRenamed("session_id", "question_id"))


@query(f"SELECT question_id FROM v_question_log WHERE len(list_filter(string_split({NORM.format('question')}, ' '), lambda t: t <> '')) < 12")
def A3_too_short(spark, d):
    return g.too_short(view(spark, d, "v_question_log"), text.tokens("question"), 12).select("question_id")


@query("SELECT question_id, turn % 3 <> 2 AND question_id % 5 <> 0 AND question_id % 7 < 5 AND parent_id IS NULL AS may_clarify FROM v_question_log")
def O2_may_clarify(spark, d):
    q = view(spark, d, "v_question_log")
    language = F.when(F.col("turn") % 3 == 0, "ar").when(F.col("turn") % 3 == 1, "en").otherwise("fr")
    kind = F.when(F.col("question_id") % 5 == 0, "greeting").otherwise("unknown")
    level = F.when(F.col("question_id") % 7 < 5, "general").otherwise("high_risk")
    return q.select("question_id", g.may_clarify(language, kind, level, F.col("parent_id")).alias("may_clarify"))


@query("""SELECT question_id, CASE WHEN (CASE WHEN kind = 'greeting' AND language = 'fr' THEN 'unknown' ELSE kind END) = 'unknown' AND question_id % 2 = 0 THEN 'out_of_scope'
    WHEN kind = 'greeting' AND language = 'fr' THEN 'unknown' ELSE kind END AS kind FROM (SELECT question_id, CASE question_id % 3 WHEN 0 THEN 'greeting' WHEN 1 THEN 'unknown' ELSE 'fiqh_question' END AS kind,
      CASE WHEN turn % 4 = 0 THEN 'fr' ELSE 'en' END AS language FROM v_question_log) q""")
def C11_apply_scope_label(spark, d):
    n = F.col("question_id") % 3
    kind = F.when(n == 0, "greeting").when(n == 1, "unknown").otherwise("fiqh_question")
    label = F.when(F.col("question_id") % 2 == 0, "not_religious")
    language = F.when(F.col("turn") % 4 == 0, "fr").otherwise("en")
    return view(spark, d, "v_question_log").select("question_id", g.apply_scope_label(kind, label, language).alias("kind"))


@query("""SELECT conv_id AS question_id, turn AS variant FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (length(text) % 2 = 0) DESC, length(text) DESC, turn) AS n FROM conversations) c WHERE n = 1""")
def R19_best_of_rewrites(spark, d):
    runs = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("variant"), (F.length("text") % 2 == 0).alias("sufficient"), F.length("text").alias("score"))
    return g.best_of_rewrites(runs).select("question_id", "variant")


_IDF = f"SELECT term, ln(1 + (SELECT count(*) FROM ({_APPROVED}) n) / count(DISTINCT unit_id)) AS idf FROM ({_POST}) p GROUP BY term"
_WEIGHTED = f"""SELECT s.question_id, s.unit_id, round(coalesce(w.got, 0.0) / a.total, 9) AS weighted_coverage FROM ({_SPARSE}) s
    JOIN (SELECT question_id, sum(coalesce(i.idf, ln(1 + (SELECT count(*) FROM ({_APPROVED}) m)))) AS total FROM (SELECT question_id, unnest(terms) AS term FROM ({_TERMS}) x) t LEFT JOIN ({_IDF}) i ON i.term = t.term GROUP BY 1) a
      ON a.question_id = s.question_id
    LEFT JOIN (SELECT t.question_id, p.unit_id, sum(i.idf) AS got FROM (SELECT question_id, unnest(terms) AS term FROM ({_TERMS}) y) t JOIN ({_POST}) p ON p.term = t.term JOIN ({_IDF}) i ON i.term = t.term GROUP BY 1, 2) w
      ON w.question_id = s.question_id AND w.unit_id = s.unit_id"""


def _weighted(spark, d):
    import math

    a = written(_approved(spark, d).select("unit_id", text.stems("content").alias("stems")), "unit-stems")
    n, questions = a.count(), _questions(spark, d)
    terms = questions.select("question_id", F.explode("terms").alias("term"))
    found = written(retrieval.sparse_scan(questions, a), "sparse-found")  # few rows, so the units they name are found without a shuffle
    held = a.join(found.select("unit_id").distinct(), "unit_id", "left_semi").select("unit_id", F.explode("stems").alias("term"))
    df = retrieval.document_frequency(a, terms)
    idf = df.select("term", F.log(1 + F.lit(n) / F.col("df")).alias("idf"))
    return g.weighted_coverage(found, terms, held, idf, math.log(1 + n))


@query(f"SELECT question_id, unit_id, round(weighted_coverage, 6) AS weighted_coverage FROM ({_WEIGHTED}) w")
def R21_weighted_coverage(spark, d):
    return _weighted(spark, d).select("question_id", "unit_id", F.round("weighted_coverage", 6).alias("weighted_coverage"))


@query(f"""SELECT question_id, unit_id, CAST(score AS BIGINT) AS score, place FROM (SELECT question_id, unit_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS place FROM (
    SELECT q.question_id, p.unit_id, sum(w) AS score FROM (SELECT question_id, unnest(terms) AS term FROM ({_TERMS}) x) q
    JOIN (SELECT term, unit_id, CAST(round(ln(1 + (SELECT count(*) FROM ({_APPROVED}) n) / count(*) OVER (PARTITION BY term)) * 1000000) AS BIGINT) AS w FROM ({_POST}) p) p ON p.term = q.term GROUP BY 1, 2) s) r WHERE place <= 64""")
def R22_sparse_by_idf(spark, d):
    """The 64 best of all units that hold a term of the question, by the idf of the terms they hold."""
    units = _approved(spark, d)
    asked = _asked_terms(spark, d)
    index = sparse.blocked_index(units, only=asked)
    terms = sparse.weighted_terms(asked, sparse.term_counts(index), units.count())
    found = sparse.search(terms, index, 64, present=True)
    return found.select("question_id", "unit_id", "score", F.col("rank").cast("long").alias("place"))


@query(f"""SELECT query_id, label AS doc_id, vec_id, concat('E', row_number() OVER (PARTITION BY query_id ORDER BY rank)) AS ref FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM ({_TOP}) t WHERE rank <= 40) x WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3""")
def R26_nearest_documents(spark, d):
    documents = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("doc_id"))
    return g.nearest_documents(_nearest(spark, d, 40), documents, 3).select("query_id", "doc_id", "vec_id", "ref")


@query("""SELECT coalesce(CAST(turn AS VARCHAR), 'all') AS turn, count(*) AS n, round(100 * avg(CAST(outcome = 'answer' AS INT)), 6) AS answer, round(100 * avg(CAST(outcome = 'abstention' AS INT)), 6) AS abstention,
    round(100 * avg(CAST(outcome = 'clarification' AS INT)), 6) AS clarification, round(100 * avg(CAST(outcome = 'escalation' AS INT)), 6) AS escalation FROM v_answers GROUP BY ROLLUP (turn)""")
def E3_outcome_rates(spark, d):
    return g.outcome_rates(view(spark, d, "v_answers").select("turn", "outcome"), "turn")
