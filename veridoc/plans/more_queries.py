"""Further registered queries: classification, chunking, caching, listings and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.functions.fixed_values import QUERY_NOISE, YES_NO
from veridoc.operators import ann, answering, chunking, classify, evaluation, retrieval, usage, verification
from veridoc.plans.queries import _EVIDENCE, _POOL, _RANKS, _TOP, DISTINCT, NORM, STEM, STEMS, _first_ranks, _list, _nearest, _pooled, _ranked, query, table
from veridoc.sources.views import units, view

LEXICON = """SELECT 'topic' AS kind, 'alpha' AS topic, 1 AS ord, 'the' AS term UNION ALL SELECT 'topic', 'beta', 2, 'la' UNION ALL SELECT 'topic', 'gamma', 3, 'of the'
    UNION ALL SELECT 'personal', 'me', 4, 'and' UNION ALL SELECT 'high_risk', 'risk', 5, 'from' UNION ALL SELECT 'topic', 'delta', 6, 'that it'"""
_HITS = f"""SELECT DISTINCT q.question_id, l.kind, l.topic, l.ord, l.term FROM v_question_log q JOIN ({LEXICON}) l
    ON contains(concat(' ', {NORM.format("coalesce(q.question, '')")}, ' '), concat(' ', l.term, ' '))"""


@query(_HITS)
def C2_term_hits(spark, d):
    return classify.term_hits(view(spark, d, "v_question_log"), spark.sql(LEXICON))


_ARABIC = """SELECT 'topic' AS kind, 'prayer' AS topic, 3 AS ord, 'الصلاة' AS term UNION ALL SELECT 'topic', 'travel', 1, 'السفر' UNION ALL SELECT 'topic', 'fast', 2, 'صيام رمضان'
    UNION ALL SELECT 'personal', 'me', 4, 'زوجي'"""


@query("""SELECT question_id, array_to_string(list_filter([CASE WHEN question_id % 3 = 1 THEN 'السفر' END, CASE WHEN question_id % 2 = 0 THEN 'صيام رمضان' END,
    CASE WHEN question_id % 3 <> 1 THEN 'الصلاة' END, CASE WHEN question_id % 5 = 0 THEN 'زوجي' END], lambda t: t IS NOT NULL), '|') AS matched FROM v_questions""")
def C3_matches(spark, d):
    """Questions led by Arabic words, with articles and conjunctions attached, against a lexicon: its terms in its order."""
    i = F.col("question_id")
    words = F.concat_ws(
        " ", F.when(i % 5 == 0, "وزوجي"), F.when(i % 3 == 1, "بالسّفر").otherwise("للصلاة"), F.when(i % 2 == 0, "في صيامِ رمضانَ؟").otherwise("رمضان بلا صيام"), "question"
    )
    asked = view(spark, d, "v_questions").select("question_id", words.alias("question"))
    return classify.matches(asked, spark.sql(_ARABIC)).select("question_id", F.array_join("matched", "|").alias("matched"))


_LEVEL = f"""SELECT q.question_id, CASE WHEN h.risk THEN 'high_risk' WHEN h.n > 0 AND h.personal THEN 'personal_case' WHEN h.n > 0 THEN 'sensitive_topic' ELSE 'general' END AS level,
    coalesce(CASE WHEN h.risk THEN 'high_risk' ELSE h.topics END, '') AS topics, coalesce(CASE WHEN h.risk THEN h.risks ELSE h.terms END, '') AS terms,
    coalesce(CASE WHEN NOT h.risk THEN h.markers END, '') AS markers
    FROM v_question_log q LEFT JOIN (SELECT question_id, bool_or(kind = 'high_risk') AS risk, bool_or(kind = 'personal') AS personal, count(*) FILTER (kind = 'topic') AS n,
      string_agg(topic, ',' ORDER BY ord) FILTER (kind = 'topic') AS topics, string_agg(term, ',' ORDER BY ord) FILTER (kind = 'topic') AS terms,
      string_agg(term, ',' ORDER BY ord) FILTER (kind = 'high_risk') AS risks, string_agg(term, ',' ORDER BY ord) FILTER (kind = 'personal') AS markers FROM ({_HITS}) x GROUP BY 1) h ON h.question_id = q.question_id"""


def _levels(spark, d):
    return classify.classify_sensitivity(view(spark, d, "v_question_log"), spark.sql(LEXICON))


@query(_LEVEL)
def C4_classify_sensitivity(spark, d):
    return _levels(spark, d).select("question_id", "level", *(F.array_join(c, ",").alias(c) for c in ("topics", "terms", "markers")))


@query(f"""SELECT question_id, CASE WHEN question_id % 6 = 0 AND level IN ('general', 'sensitive_topic') THEN 'personal_case' ELSE level END AS level,
    array_to_string(list_sort(list_distinct(list_concat(CASE WHEN topics = '' THEN [] ELSE string_split(topics, ',') END, CASE WHEN question_id % 6 = 0 THEN ['alpha', 'zeta'] ELSE [] END))), ',') AS topics FROM ({_LEVEL}) x""")
def C6_raise_with_labels(spark, d):
    """Labels of a personal case: every second one without topics, so that it counts as general."""
    topics = F.when(F.col("question_id") % 6 == 0, F.array(F.lit("zeta"), F.lit("alpha")))
    labels = view(spark, d, "v_question_log").filter("question_id % 3 = 0").select("question_id", F.lit("personal_case").alias("level"), topics.alias("topics"))
    return classify.raise_with_labels(_levels(spark, d), labels).select("question_id", "level", F.array_join("topics", ",").alias("topics"))


RULES = """SELECT 'r1' AS rule, 1 AS ord, 'when' AS role, 'the' AS term UNION ALL SELECT 'r1', 1, 'context', 'and' UNION ALL SELECT 'r1', 1, 'unless', 'from'
    UNION ALL SELECT 'r2', 2, 'when', 'la'
    UNION ALL SELECT 'r2', 2, 'first_person', 'el' UNION ALL SELECT 'r2', 2, 'first_person', 'and' UNION ALL SELECT 'r3', 3, 'when', 'of'"""


@query(f"""SELECT q.question_id, r.rule FROM v_question_log q LEFT JOIN (SELECT question_id, arg_min(rule, ord) AS rule FROM (
    SELECT q.question_id, l.rule, l.ord FROM v_question_log q JOIN ({RULES}) l ON contains(concat(' ', {NORM.format("coalesce(q.question, '')")}, ' '), concat(' ', l.term, ' '))
    GROUP BY 1, 2, 3 HAVING bool_or(l.role = 'when') AND (l.rule <> 'r1' OR bool_or(l.role = 'context')) AND (l.rule <> 'r2' OR bool_or(l.role = 'first_person')) AND NOT bool_or(l.role = 'unless')) x GROUP BY 1) r ON r.question_id = q.question_id""")
def C12_missing_slot(spark, d):
    return classify.missing_slot(view(spark, d, "v_question_log"), spark.sql(RULES))


@query(f"""SELECT outcome, count(*) AS questions FROM (SELECT CASE WHEN level IN ('high_risk', 'personal_case') THEN 'escalation' WHEN question_id % 5 = 0 THEN 'clarification'
    WHEN question_id % 3 = 0 THEN 'abstention' ELSE 'answer' END AS outcome FROM ({_LEVEL}) l) o GROUP BY outcome""")
def O1_route(spark, d):
    given = _levels(spark, d).select(
        "question_id", "level", F.lit("question").alias("kind"), F.when(F.col("question_id") % 5 == 0, "slot").alias("slot"),
        F.when(F.col("question_id") % 3 == 0, "weak_evidence").otherwise("sufficient").alias("verdict"), F.lit("answer").alias("decision"),
    )
    return usage.routing_simulation(classify.route(given))


@query()
def K3_chunks(spark, d):
    c = chunking.chunks(view(spark, d, "v_docs"))
    return c.select("doc_id", "ordinal", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_hash"))


@query(r"""SELECT doc_id, CASE WHEN length(q) <= 1300 THEN 1 END AS whole, true AS bounded, true AS verbatim, true AS gapless, true AS from_end_to_end FROM (
    SELECT doc_id, trim(CASE WHEN trim(title) <> '' THEN concat(trim(title), chr(10), chr(10), body) ELSE body END, chr(32) || chr(9) || chr(10) || chr(13)) AS q FROM v_docs) d WHERE q <> ''""")
def K3_chunk_invariants(spark, d):
    """Chunks of title and body: one if short, else bounded, of verbatim units, numbered without gaps, from the text's first to its last words."""
    docs = view(spark, d, "v_docs").select("doc_id", "title", "body")
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    cut = chunking.chunks(docs, question_col="title").join(docs.select("doc_id", bare(F.concat_ws(" ", "title", "body")).alias("all")), "doc_id")
    units_of = F.filter(F.transform(F.split("content", "\n\n"), bare), lambda u: u != "")
    per = cut.withColumn("units", units_of).groupBy("doc_id", "all").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("content")).alias("most"), (F.max("ordinal") == F.count(F.lit(1)) - 1).alias("gapless"),
        F.bool_and(F.forall("units", lambda u: F.contains(F.col("all"), u))).alias("verbatim"),
        F.min_by(bare("content"), "ordinal").alias("first"), F.max_by(bare("content"), "ordinal").alias("last"),
    )
    short = (F.col("n") == 1) & (F.col("most") <= chunking.WHOLE)
    ends = F.startswith("all", F.substring("first", 1, 20)) & F.endswith("all", F.expr("right(last, 20)"))
    limit = F.when(F.col("n") == 1, chunking.WHOLE).otherwise(chunking.PACK + chunking.OVERLAP + 2)
    return per.select("doc_id", F.when(short, 1).alias("whole"), (F.col("most") <= limit).alias("bounded"), "verbatim", "gapless", ends.alias("from_end_to_end"))


@query(f"SELECT question_id, unit_id, round(coalesce(1.0 / (60 + sparse_rank), 0.0) + coalesce(1.0 / (60 + dense_rank), 0.0), 9) AS rrf FROM ({_POOL}) e")
def R10_rrf(spark, d):
    return _pooled(spark, d).select("question_id", "unit_id", F.round(retrieval.rrf(F.col("sparse_rank"), F.col("dense_rank")), 9).alias("rrf"))


@query(f"SELECT question_id, count(*) % 4 <> 0 AS valid FROM ({_EVIDENCE}) e GROUP BY question_id")
def X1_citation_valid(spark, d):
    e = retrieval.relevant_evidence(_ranked(spark, d)).select("question_id", "ref")
    claims = e.groupBy("question_id").agg(F.collect_list("ref").alias("refs"), F.count(F.lit(1)).alias("n"))
    wrong = F.when(F.col("n") % 4 == 0, F.array_append("refs", F.lit("E99"))).otherwise(F.col("refs"))
    found = verification.citation_valid(claims.select("question_id", F.lit(0).alias("claim_id"), wrong.alias("refs")), e)
    return found.select("question_id", "valid")


@query("""SELECT question_id, sha256(concat('{"max_tokens": ', CAST(4000 + turn AS VARCHAR), ', "model": "base", "provider": "p", "schema": {"type": "object"}, "settings": {}, "system": ',
    CAST(to_json('Answer "only" from' || chr(10) || 'evidence é') AS VARCHAR), ', "task": "answer", "user": ', CAST(to_json(question) AS VARCHAR), ', "v": 1}')) AS key FROM v_question_log WHERE question IS NOT NULL""")
def U6_cache_keys(spark, d):
    q = view(spark, d, "v_question_log").filter("question IS NOT NULL")
    key = usage.cache_key(F.lit("p"), F.lit("base"), F.lit("{}"), F.lit("answer"), F.lit('Answer "only" from\nevidence é'), F.col("question"), F.lit('{"type": "object"}'), F.col("turn") + 4000)
    return q.select("question_id", key.alias("key"))


_TONGUE = "CASE WHEN NOT regexp_matches({0}, '[A-Za-z]') THEN 'ar' WHEN regexp_matches({0}, '[ğĞşŞıİ]') THEN 'tr' WHEN regexp_matches({0}, '[ɓɗƙƴƁƊƘƳ]') THEN 'ha' ELSE 'en' END"
_ALL_STEMS = "list_transform(list_filter(string_split(" + NORM + ", ' '), lambda t: t <> ''), lambda t: " + STEM.replace("{{", "{").replace("}}", "}").replace("{", "{{").replace("}", "}}") + ")"


@query(f"""WITH c AS (SELECT conv_id, turn, text AS claim, lag(text) OVER w AS question, lead(text) OVER w AS evidence FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    t AS (SELECT *, list_filter({DISTINCT.format(STEMS.format("coalesce(claim, '')"))}, lambda x: NOT list_contains(list_concat({STEMS.format("coalesce(question, '')")},
      list_transform({_list((*QUERY_NOISE, *YES_NO))}, lambda t: {STEM.replace("{{", "{").replace("}}", "}")})), x)) AS own, {_ALL_STEMS.format("coalesce(evidence, '')")} AS held FROM c)
    SELECT conv_id, turn, CASE WHEN trim(coalesce(evidence, '')) = '' OR {_TONGUE.format("coalesce(claim, '')")} <> {_TONGUE.format("coalesce(evidence, '')")} OR len(own) = 0 THEN 1.0
      ELSE round(len(list_filter(own, lambda x: list_contains(held, x))) / len(own), 3) END AS support FROM t""")
def X3_lexical_support(spark, d):
    """Every turn as a claim, with the turn before it as the question and the one after it as evidence."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("claim"), F.lag("text").over(w).alias("question"), F.lead("text").over(w).alias("evidence"))
    return c.select("conv_id", "turn", answering.lexical_support(F.col("claim"), F.col("evidence"), F.col("question")).alias("support"))


@query("""SELECT s.slug, count(DISTINCT d.doc_id) AS documents, count(u.unit_id) AS units FROM v_sources s LEFT JOIN v_docs d ON d.source_slug = s.slug LEFT JOIN v_units u ON u.doc_id = d.doc_id
    WHERE s.status <> 'pending' GROUP BY s.slug""")
def D14_delete_sources(spark, d):
    """What is left of every source once the pending ones are deleted with their documents and units."""
    sources = view(spark, d, "v_sources")
    left, docs, cut = usage.delete_sources(sources.filter("status = 'pending'"), sources, view(spark, d, "v_docs"), units(spark, d))
    n = [df.groupBy(F.col("source_slug").alias("slug")).agg(F.count(F.lit(1)).alias(name)) for df, name in ((docs, "documents"), (cut, "units"))]
    return left.select("slug").join(n[0], "slug", "left").join(n[1], "slug", "left").na.fill(0)


_NOW = "(SELECT max(ts) FROM events)"


def _as_of(spark, d):
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])  # one value


@query(f"""SELECT (SELECT count(*) FROM v_sources WHERE status = 'approved') AS sources, (SELECT count(*) FROM v_docs WHERE status = 'active') AS documents,
          (SELECT count(*) FROM v_units) AS units, (SELECT count(*) FROM v_usage) AS questions, (SELECT count(*) FROM v_usage WHERE ts > {_NOW} - INTERVAL 7 DAY) AS questions_lately""")
def D5_overview_totals(spark, d):
    return usage.overview_totals(view(spark, d, "v_sources"), view(spark, d, "v_docs"), units(spark, d), view(spark, d, "v_usage"), _as_of(spark, d))


_REF = "CAST(substr(ref, 2) AS INT)"


@query(f"""SELECT source_slug, count(DISTINCT question_id) AS answers FROM ({_EVIDENCE}) e WHERE question_id % 4 <> 1 AND (question_id + {_REF}) % 3 <> 0 GROUP BY 1""")
def D8_citations(spark, d):
    """Answers by cited source; each evidence is cited by one claim, of which every third is not kept, and every fourth question was not answered."""
    e = retrieval.relevant_evidence(_ranked(spark, d)).select("question_id", "ref", "source_slug")
    n = F.expr("cast(substring(ref, 2) AS int)")
    claims = e.select("question_id", ((F.col("question_id") + n) % 3 != 0).alias("kept"), F.array("ref").alias("refs"))
    answers = view(spark, d, "v_questions").select("question_id", F.when(F.col("question_id") % 4 == 1, "abstention").otherwise("answer").alias("outcome"))
    return usage.citations_by_source(answers, e, claims)


@query(r"""
    SELECT c.conv_id, CAST(g.place AS INT) AS place, g.name AS "group", coalesce(t.status, 'empty') AS status
    FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (VALUES (0, 'question'), (1, 'analysis'), (2, 'sources'), (3, 'evidence'), (4, 'claims'), (5, 'verification'), (6, 'answer')) g(place, name)
    LEFT JOIN (SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'analysis' WHEN 1 THEN 'sources' WHEN 2 THEN 'claims' ELSE 'answer' END AS grp,
      CASE WHEN bool_or(length(text) % 5 = 0) THEN 'blocked' ELSE 'done' END AS status FROM conversations GROUP BY 1, 2) t ON t.conv_id = c.conv_id AND t.grp = g.name""")
def O11_group_stages(spark, d):
    """Every turn as a stage of its conversation's trace."""
    stage = F.element_at(F.array(*map(F.lit, ("intent", "retrieval", "generation", "safety_gate"))), (F.col("turn") % 4 + 1).cast("int"))
    trace = table(spark, d, "conversations").select("conv_id", stage.alias("stage"), F.when(F.length("text") % 5 == 0, "failed").otherwise("ok").alias("status"))
    return answering.group_stages(trace, "conv_id").select("conv_id", "place", "group", "status")


@query("""SELECT conv_id, turn, CASE WHEN length(trim(coalesce(text, ''))) < 2 THEN 'too short' WHEN length(trim(coalesce(text, ''))) > 1000 THEN 'too long'
    WHEN conv_id % 12 = 11 THEN 'unknown locale' WHEN turn % 7 = 6 THEN 'unknown channel' END AS problem FROM conversations""")
def O10_validate_questions(spark, d):
    c = table(spark, d, "conversations")
    locale = F.element_at(F.array(*map(F.lit, (*answering.LOCALES, "xx"))), (F.col("conv_id") % 12 + 1).cast("int"))
    asked = c.select("conv_id", "turn", F.col("text").alias("question"), locale.alias("locale"), F.when(F.col("turn") % 7 == 6, "fax").otherwise("text").alias("channel"))
    return answering.validate_questions(asked).select("conv_id", "turn", "problem")


@query("""SELECT q.question_id, CASE WHEN p.question IS NULL THEN q.question ELSE concat(p.question, ' ', q.question) END AS full_question
          FROM v_question_log q LEFT JOIN v_question_log p ON p.question_id = q.parent_id""")
def C14_complete_question(spark, d):
    q = view(spark, d, "v_question_log")
    p = q.select(F.col("question_id").alias("parent_id"), F.col("question").alias("asked_before"))
    full = F.when(F.col("asked_before").isNull(), F.col("question")).otherwise(F.concat("asked_before", F.lit(" "), "question"))
    return q.join(p, "parent_id", "left").select("question_id", full.alias("full_question"))


@query("SELECT item_id, variant, question FROM (SELECT item_id, text AS formal, lower(text) AS colloquial FROM benchmark) b UNPIVOT (question FOR variant IN (formal, colloquial))")
def S29_unpivot_variants(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("formal"), F.lower("text").alias("colloquial"))
    return b.unpivot(["item_id"], ["formal", "colloquial"], "variant", "question")


@query(f"SELECT query_id, CASE WHEN first_rank = 1 THEN 'C' WHEN first_rank <= 10 THEN 'B' ELSE 'A' END AS bucket FROM ({_RANKS}) r")
def E9_buckets(spark, d):
    r = _first_ranks(spark, d)
    found = F.coalesce(F.col("first_rank") <= 10, F.lit(False))
    return r.select("query_id", evaluation.bucket(F.coalesce("first_rank", F.lit(0)), found).alias("bucket"))


@query()
def E16_recall(spark, d):
    """Recall at 10 of the approximate search against the exact one."""
    return evaluation.recall(_approximate(spark, d), _nearest(spark, d, 10), "query_id", "vec_id")


@query("""SELECT w AS "start", w + INTERVAL 7 DAY AS "end", event_type, count(*) AS n FROM (SELECT event_type, unnest(range(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS w FROM events) e GROUP BY 1, 2, 3""")
def W2_sliding_counts(spark, d):
    from veridoc.streaming.logs import sliding_counts

    return sliding_counts(table(spark, d, "events"), "7 days", "1 day")


@query("SELECT doc_id, trim(substr(body, length(title) + 1)) AS rest FROM v_docs WHERE title <> ''")
def T23_answer_part(spark, d):
    docs = view(spark, d, "v_docs").filter("title <> ''")
    return docs.select("doc_id", text.answer_part(F.col("body"), F.col("title")).alias("rest"))


@query("SELECT DISTINCT regexp_extract(url, 'https?://([^/:?#]+)', 1) AS domain FROM pages")
def S27_search_domains(spark, d):
    return table(spark, d, "pages").select(F.regexp_extract("url", "https?://([^/:?#]+)", 1).alias("domain")).distinct()


def _asked(spark, d):
    v = view(spark, d, "v_vectors")
    return v.filter("is_query").select(F.col("vec_id").alias("query_id"), "embedding"), v.select("vec_id", "embedding")


def _approximate(spark, d):
    return ann.knn_ann(*_asked(spark, d), 10)


@query()
def V7_knn_ann(spark, d):
    return _approximate(spark, d).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM ({_TOP}) t WHERE rank <= 10")
def V7_all_cells(spark, d):
    """With every cell visited, the bounds of the codes leave the exact result."""
    found = ann.knn_ann(*_asked(spark, d), 10, probes=ann.CELLS)
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT count(*) AS queries, true AS recall_reached, true AS few_scored FROM v_vectors WHERE is_query")
def V7_recall_and_work(spark, d):
    """Whether the search finds 0.95 of the true neighbours and scores at most a tenth of all pairs exactly."""
    q, v = _asked(spark, d)
    pairs = ann.candidates(q, ann.build_index(v), 10)
    recall = evaluation.recall(ann.rescore(pairs, q, v, 10), _nearest(spark, d, 10), "query_id", "vec_id")
    work = pairs.agg(F.count(F.lit(1)).alias("scored")).join(v.agg(F.count(F.lit(1)).alias("vectors")))  # single rows
    few = F.col("scored") <= F.col("queries") * F.col("vectors") / 10
    return recall.join(work).select("queries", (F.col("recall") >= 0.95).alias("recall_reached"), few.alias("few_scored"))
