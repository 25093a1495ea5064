"""Registered queries of the engine's own operators over the standard tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import pii, text, vectors
from veridoc.functions.fixed_values import QUERY_NOISE, STOPWORDS
from veridoc.functions.shared import written
from veridoc.operators import evaluation, ingest, retrieval, sparse, usage, verification
from veridoc.sources.views import oracle, units, view

FLAGSHIP = "R11_hybrid_retrieval"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


# SQL forms of the text functions, for texts without Arabic script.
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
STOP = f"(list_contains({_list(STOPWORDS)}, t) OR (length(t) > 2 AND regexp_matches(t, '^[وفبل]') AND list_contains({_list(STOPWORDS)}, substr(t, 2))))"
STEM = "regexp_replace(t, '^(.{{3,}}?)(?:ing|ed|es|s)$', '\\1')"
STEMS = (
    "list_filter(list_transform(list_filter(string_split(" + NORM + f", ' '), lambda t: length(t) >= 2 AND NOT {STOP.replace('{', '{{').replace('}', '}}')}), "
    f"lambda t: {STEM}), lambda s: length(s) >= 2)"
)
NOISE_STEMS = STEMS.replace("length(t) >= 2 AND NOT", f"length(t) >= 2 AND NOT list_contains({_list(QUERY_NOISE)}, t) AND NOT")
DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


# --- text -------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({NORM.format('body')}) AS norm_hash, length({NORM.format('body')}) AS norm_chars FROM v_docs")
def T6_normalize(spark, d):
    n = text.normalize("body")
    return view(spark, d, "v_docs").select("doc_id", F.sha2(n, 256).alias("norm_hash"), F.length(n).cast("long").alias("norm_chars"))


@query(f"SELECT doc_id, CAST(len(list_filter(string_split({NORM.format('body')}, ' '), lambda t: t <> '')) AS BIGINT) AS n_tokens FROM v_docs")
def T7_tokens(spark, d):
    return view(spark, d, "v_docs").select("doc_id", F.size(text.tokens("body")).cast("long").alias("n_tokens"))


@query(f"SELECT question_id, array_to_string({DISTINCT.format(NOISE_STEMS.format('question'))}, ' ') AS terms FROM v_questions")
def T11_content_terms(spark, d):
    q = retrieval.query_terms(view(spark, d, "v_questions"))
    return q.select("question_id", F.array_join("terms", " ").alias("terms"))


@query(f"SELECT doc_id, sha256(array_to_string({STEMS.format('body')}, ' ')) AS stems_hash FROM v_docs")
def T12_search_text(spark, d):
    return view(spark, d, "v_docs").select("doc_id", F.sha2(text.search_text("body"), 256).alias("stems_hash"))


@query(r"""SELECT doc_id, 0.0 AS arabic, CASE WHEN regexp_matches(body, '[A-Za-z]') THEN 1.0 ELSE 0.0 END AS latin FROM v_docs""")
def T14_script_ratio(spark, d):
    r = text.script_ratio("body")
    return view(spark, d, "v_docs").select("doc_id", r["arabic"].alias("arabic"), r["latin"].alias("latin"))


@query("""SELECT doc_id, CASE WHEN NOT regexp_matches(body, '[A-Za-z]') THEN 'tr' WHEN regexp_matches(body, '[ğĞşŞıİ]') THEN 'tr'
          WHEN regexp_matches(body, '[ɓɗƙƴƁƊƘƳ]') THEN 'ha' ELSE 'tr' END AS detected FROM v_docs""")
def T15_detect_language(spark, d):
    return view(spark, d, "v_docs").select("doc_id", text.detect_language("body", "tr").alias("detected"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS flat_hash FROM v_docs")
def T20_flat(spark, d):
    return view(spark, d, "v_docs").select("doc_id", F.sha2(text.flat("body"), 256).alias("flat_hash"))


@query("SELECT event_id, substr(sha256(concat('salt:', session_id)), 1, 32) AS hashed FROM v_usage")
def T22_hash_identifier(spark, d):
    return view(spark, d, "v_usage").select("event_id", text.hash_identifier(F.col("session_id").cast("string"), "salt").alias("hashed"))


@query(r"SELECT doc_id, sha256(regexp_replace(body, '(sk-[A-Za-z0-9_-]{6,}|bearer\s+[A-Za-z0-9._-]+|x-api-key:\s*\S+)', '[REDACTED]', 'gi')) AS redacted_hash FROM v_docs")
def T21_redact_secrets(spark, d):
    return view(spark, d, "v_docs").select("doc_id", F.sha2(text.redact_secrets("body"), 256).alias("redacted_hash"))


@query("SELECT page_id, sha256(translate(html, '<>', '‹›')) AS shown_hash FROM pages")
def T24_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.sanitize("html"), 256).alias("shown_hash"))


@query()
def T13_split_sentences(spark, d):
    s = view(spark, d, "v_docs").select("doc_id", F.posexplode(text.split_sentences("body")).alias("ordinal", "sentence"))
    return s.select("doc_id", "ordinal", F.length("sentence").alias("chars"), F.sha2("sentence", 256).alias("sentence_hash"))


# --- personal data ----------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, sha256(regexp_replace(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g')) AS redacted_hash FROM v_docs")
def P1_redact_email(spark, d):
    from veridoc.functions.fixed_values import EMAIL

    return view(spark, d, "v_docs").select("doc_id", F.sha2(F.regexp_replace("body", EMAIL, "[EMAIL]"), 256).alias("redacted_hash"))


@query(r"""SELECT doc_id, ordinal, kind FROM (
    SELECT doc_id, generate_subscripts(runs, 1) - 1 AS ordinal, unnest(runs) AS raw, NULL AS x FROM (
      SELECT doc_id, regexp_extract_all(body, '\+?\d(?:[\s.\-]?\d){6,22}') AS runs FROM v_docs) r) s,
    LATERAL (SELECT regexp_replace(raw, '\D', '', 'g') AS g) t,
    LATERAL (SELECT CASE WHEN regexp_matches(g, '^(?:966|00966)?0?5\d{8}$') OR starts_with(raw, '+') THEN 'phone'
      WHEN regexp_matches(g, '^[12]\d{9}$') THEN 'national_id'
      WHEN length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i:
        CASE WHEN (length(g) - i) % 2 = 1 THEN CASE WHEN CAST(substr(g, i, 1) AS INT) * 2 > 9 THEN CAST(substr(g, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(g, i, 1) AS INT) * 2 END
        ELSE CAST(substr(g, i, 1) AS INT) END)) % 10 = 0 THEN 'card_number'
      WHEN length(g) >= 9 THEN CASE WHEN regexp_matches(g, '^[09]') THEN 'phone' ELSE 'id_number' END END AS kind) k""")
def P3_classify_number(spark, d):
    from veridoc.functions.fixed_values import NUMBER_RUN

    runs = view(spark, d, "v_docs").select("doc_id", F.posexplode(F.regexp_extract_all("body", F.lit(NUMBER_RUN), F.lit(0))).alias("ordinal", "raw"))
    return runs.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), pii.classify_number(F.col("raw")).alias("kind"))


@query()
def P7_redact(spark, d):
    r = view(spark, d, "v_docs").select("doc_id", pii.redact("body").alias("r"))
    return r.select("doc_id", F.sha2("r.text", 256).alias("redacted_hash"), F.array_join("r.types", ",").alias("types"))


@query()
def P8_pii_report(spark, d):
    return pii.pii_report(view(spark, d, "v_docs").select(pii.redact("body")["types"].alias("types")))


# --- sources and ingestion --------------------------------------------------------------------------------------------


@query("SELECT doc_id, content_sha256 FROM v_docs")
def S3_content_hash(spark, d):
    docs = view(spark, d, "v_docs")
    return docs.select("doc_id", ingest.content_hash(F.lit(None).cast("string"), F.col("body")).alias("content_sha256"))


@query("""SELECT coalesce(b.doc_id, u.doc_id) AS doc_id, coalesce(b.source_slug, u.source_slug) AS source_slug,
          sha256(CASE WHEN u.doc_id IS NOT NULL THEN u.body ELSE b.body END) AS body_hash
          FROM v_docs b FULL JOIN v_docs_next u ON b.doc_id = u.doc_id""")
def S6_upsert(spark, d):
    base = view(spark, d, "v_docs").select("doc_id", "source_slug", "body")
    merged = ingest.upsert(base, view(spark, d, "v_docs_next"), ["doc_id"], ["body"])
    return merged.select("doc_id", "source_slug", F.sha2("body", 256).alias("body_hash"))


_CHANGES = """SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.body = n.body AND o.doc_id % 7 <> 0 THEN 'unchanged' ELSE 'updated' END AS change
              FROM v_docs_next n LEFT JOIN v_docs o ON o.doc_id = n.doc_id"""


def _changes(spark, d):
    body_hash = F.sha2("body", 256).alias("content_sha256")
    old = view(spark, d, "v_docs").select("doc_id", body_hash, (F.col("doc_id") % 7).alias("n_current_chunks"))
    return ingest.classify_changes(old, view(spark, d, "v_docs_next").select("doc_id", body_hash), ["doc_id"])


@query(_CHANGES)
def S8_classify_changes(spark, d):
    return _changes(spark, d).select("doc_id", "change")


@query(f"SELECT change, count(*) AS documents FROM ({_CHANGES}) c GROUP BY change")
def S9_seed_report(spark, d):
    return ingest.seed_report(_changes(spark, d))


@query("SELECT source_slug, external_id, content_sha256 FROM v_docs")
def S13_manifest(spark, d):
    return ingest.manifest(view(spark, d, "v_docs"))


@query("""SELECT o.source_slug, o.external_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN n.body <> o.body THEN 'changed' ELSE 'present' END AS state
          FROM v_docs o LEFT JOIN v_docs_next n ON n.doc_id = o.doc_id AND n.source_slug = o.source_slug""")
def S14_manifest_diff(spark, d):
    key = lambda df: df.select("source_slug", F.col("doc_id").cast("string").alias("external_id"), F.sha2("body", 256).alias("content_sha256"))
    return ingest.manifest_diff(key(view(spark, d, "v_docs")), key(view(spark, d, "v_docs_next")))


@query(r"""SELECT page_id, target, min(place) AS place FROM (
    SELECT page_id, unnest(l) AS target, generate_subscripts(l, 1) - 1 AS place FROM (
      SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS l FROM pages) x) y GROUP BY page_id, target""")
def S18_extract_links(spark, d):
    found = ingest.extract_links(table(spark, d, "pages"), r'<a href="(/[^"]*)"')
    return found.select("page_id", "target", F.col("place").cast("long").alias("place"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def S19_page_title(spark, d):
    return table(spark, d, "pages").select("page_id", ingest.page_title(F.col("html")).alias("title"))


@query("SELECT doc_id, parent FROM (SELECT doc_id, doc_id // 3 AS parent FROM documents) t WHERE doc_id NOT IN (SELECT doc_id // 3 FROM documents)")
def S20_leaf_nodes(spark, d):
    tree = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 3").alias("parent"))
    return tree.join(ingest.leaf_nodes(tree, "doc_id", "parent"), "doc_id")


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS categories FROM documents GROUP BY source")
def S21_merge_categories(spark, d):
    merged = ingest.merge_categories(table(spark, d, "documents"), "source", "lang")
    return merged.select("source", F.array_join("categories", ",").alias("categories"))


@query("""SELECT turn, source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) r
          ORDER BY turn, source, doc_id LIMIT 100""")
def S22_round_robin_sample(spark, d):
    return ingest.round_robin_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 100)


@query("SELECT slug, CASE WHEN status = 'blocked' THEN 'skipped (blocked)' WHEN priority IS NULL THEN 'live search' WHEN priority > 8 THEN 'skipped (no ingestion adapter)' ELSE 'ingest' END AS route FROM v_sources")
def S10_route_sources(spark, d):
    how = F.when(F.col("priority").isNull(), "live_search").when(F.col("priority") > 8, "other").otherwise("snapshots")
    return ingest.route_sources(view(spark, d, "v_sources").withColumn("ingestion", how), ["snapshots"])


@query(r"""SELECT page_id, array_to_string(list_distinct_kept, ' ') AS urls FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_kept FROM (
    SELECT page_id, list_transform(regexp_extract_all(concat(url, ' and ', url, '.'), 'https?://[^\s<>"'']+'), lambda u: regexp_replace(regexp_replace(u, '[.,;:)\]}]+$', ''), '[?&]utm_[^&#]*', '', 'g')) AS l FROM pages) x) y""")
def S25_extract_urls(spark, d):
    twice = F.concat("url", F.lit(" and "), "url", F.lit("."))
    return table(spark, d, "pages").select("page_id", F.array_join(ingest.extract_urls(twice), " ").alias("urls"))


# --- vectors ----------------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
_COS = f"({_DOT.format('q.embedding', 'v.embedding')} / (sqrt({_DOT.format('q.embedding', 'q.embedding')}) * sqrt({_DOT.format('v.embedding', 'v.embedding')})))"
_KNN = f"""SELECT q.vec_id AS query_id, v.vec_id AS vec_id, v.label AS label, q.label AS query_label, {_COS} AS score
           FROM v_vectors q, v_vectors v WHERE q.is_query"""
_TOP = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ({_KNN}) k"
_REST = f"SELECT query_id, vec_id, label, query_label, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ({_TOP}) a WHERE vec_id <> query_id"


def _nearest(spark, d, k):
    v = view(spark, d, "v_vectors")
    q = v.filter("is_query").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.knn_exact(q, v, k)


def _others(spark, d, k):
    """The nearest vectors but for the query itself."""
    from pyspark.sql import Window

    found = _nearest(spark, d, k + 1).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


@query(f"SELECT vec_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt({_DOT.format('embedding', 'embedding')}), 6) AS first FROM embeddings")
def V1_unit(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.unit(F.col("embedding"))[0], 6).alias("first"))


@query(f"SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM ({_TOP}) t WHERE rank <= 10")
def V6_knn_exact(spark, d):
    return _nearest(spark, d, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT count(*) AS wrong FROM embeddings WHERE len(embedding) <> 64")
def V5_dim_check(spark, d):
    return vectors.dim_check(table(spark, d, "embeddings"), "embedding", 64).agg(F.count(F.lit(1)).alias("wrong"))


# --- retrieval --------------------------------------------------------------------------------------------------------

_APPROVED = "SELECT u.*, s.priority FROM v_units u JOIN v_sources s ON s.slug = u.source_slug WHERE s.status = 'approved' AND u.status = 'active'"
_POST = f"SELECT term, unit_id, count(*) AS hits FROM (SELECT unit_id, unnest({STEMS.format('content')}) AS term FROM ({_APPROVED}) a) p GROUP BY term, unit_id"
_TERMS = f"SELECT question_id, {DISTINCT.format(NOISE_STEMS.format('question'))} AS terms FROM v_questions"
_SPARSE = f"""SELECT question_id, unit_id, CAST(hits AS BIGINT) AS hits, CAST(rank AS BIGINT) AS rank, round((hits * 0.1) / (hits * 0.1 + 1), 9) AS sparse_score FROM (
    SELECT question_id, unit_id, hits, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, unit_id) AS rank FROM (
      SELECT t.question_id, p.unit_id, sum(p.hits) AS hits FROM (SELECT question_id, unnest(terms) AS term FROM ({_TERMS}) x) t
      JOIN ({_POST}) p ON p.term = t.term GROUP BY 1, 2) h) r WHERE rank <= 24"""


def _approved(spark, d):
    return retrieval.approved(units(spark, d), view(spark, d, "v_sources"))


def _questions(spark, d):
    return retrieval.query_terms(view(spark, d, "v_questions"))


def _sparse(spark, d):
    return retrieval.sparse_scan(_questions(spark, d), _approved(spark, d))


def _asked_terms(spark, d):
    return _questions(spark, d).select("question_id", F.explode("terms").alias("term"))


@query(f"SELECT unit_id, doc_id, source_slug, CAST(priority AS INT) AS priority FROM ({_APPROVED}) a")
def R1_approved_units(spark, d):
    return _approved(spark, d).select("unit_id", "doc_id", "source_slug", "priority")


@query(_SPARSE)
def R5_sparse_search(spark, d):
    found = _sparse(spark, d)
    return found.select("question_id", "unit_id", "hits", F.col("rank").cast("long").alias("rank"), "sparse_score")


@query(_SPARSE)
def R5_pruned_search(spark, d):
    """The same by an index in blocks, of which only those are read that may reach the best."""
    index = sparse.blocked_index(_approved(spark, d), only=_asked_terms(spark, d))
    found = sparse.search(_asked_terms(spark, d).withColumn("weight", F.lit(1).cast("long")), index, retrieval.CANDIDATES)
    score = F.round(retrieval.cover_density(F.col("score")), 9).alias("sparse_score")
    return found.select("question_id", "unit_id", F.col("score").alias("hits"), F.col("rank").cast("long").alias("rank"), score)


DIM = 64
_BUCKETS = f"CAST(concat('0x', substr(sha256(term), 1, 8)) AS BIGINT) % {DIM} AS b, CAST(count(*) AS DOUBLE) AS c"
_QB = f"SELECT question_id, {_BUCKETS} FROM (SELECT question_id, unnest({DISTINCT.format(STEMS.format('question'))}) AS term FROM v_questions) t GROUP BY 1, 2"
_UB = f"SELECT unit_id, {_BUCKETS} FROM (SELECT unit_id, unnest({DISTINCT.format(STEMS.format('content'))}) AS term FROM ({_APPROVED}) a) t GROUP BY 1, 2"
_COSINES = f"""SELECT question_id, unit_id, round(sum(q.c * u.c) / (any_value(q.n) * any_value(u.n)), 9) AS dense FROM
    (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY question_id)) AS n FROM ({_QB}) x) q
    JOIN (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY unit_id)) AS n FROM ({_UB}) y) u USING (b) GROUP BY 1, 2"""
_DENSE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, unit_id) AS rank FROM ({_COSINES}) c) d WHERE rank <= 24"
_POOL = f"""SELECT p.*, coalesce(c.dense, 0.0) AS dense FROM (SELECT coalesce(d.question_id, s.question_id) AS question_id, coalesce(d.unit_id, s.unit_id) AS unit_id,
    d.rank AS dense_rank, s.rank AS sparse_rank FROM ({_DENSE}) d FULL JOIN ({_SPARSE}) s ON s.question_id = d.question_id AND s.unit_id = d.unit_id) p
    LEFT JOIN ({_COSINES}) c ON c.question_id = p.question_id AND c.unit_id = p.unit_id"""
_SCORED = f"""SELECT s.question_id, s.unit_id, s.sparse_rank, s.dense_rank, s.dense, u.doc_id, u.source_slug,
    CASE WHEN len(t.terms) = 0 THEN 0.0 ELSE len(list_intersect(t.terms, list_distinct({STEMS.format('u.content')}))) / len(t.terms) END AS coverage,
    CASE WHEN len(t.terms) = 0 THEN 0.0 ELSE len(list_intersect(t.terms, list_distinct({STEMS.format('u.title')}))) / len(t.terms) END AS title_coverage, len(t.terms) AS n_terms
    FROM ({_POOL}) s JOIN v_units u ON u.unit_id = s.unit_id JOIN ({_TERMS}) t ON t.question_id = s.question_id"""
_HYBRID = f"SELECT *, s AS hybrid, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, unit_id) AS rank FROM (SELECT *, round(dense + 0.05 * coverage + 0.1 * title_coverage, 9) AS s FROM ({_SCORED}) c) h"


def _embedded(spark, d):
    """Questions, and approved units with their stems and term-hash vectors, written once for all that reads them."""
    q = _questions(spark, d).withColumn("embedding", vectors.hash_embed(text.content_terms("question"), DIM))
    u = _approved(spark, d).select("unit_id", "doc_id", "source_slug", "title", "content", text.stems("content").alias("stems"))
    return q, written(u.withColumn("embedding", vectors.hash_embed(F.array_distinct("stems"), DIM)), "unit-index")


@query(f"""SELECT q.question_id, r.i AS bucket, round(coalesce(x.c / x.n, 0.0), 6) AS weight FROM v_questions q, range({DIM}) r(i)
    LEFT JOIN (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY question_id)) AS n FROM ({_QB}) b) x ON x.question_id = q.question_id AND x.b = r.i""")
def V2_hash_embed(spark, d):
    q = view(spark, d, "v_questions").select("question_id", F.posexplode(vectors.hash_embed(text.content_terms("question"), DIM)).alias("bucket", "weight"))
    return q.select("question_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


@query(f"SELECT question_id, unit_id, dense AS dense_score, rank FROM ({_DENSE}) d")
def R3_dense_search(spark, d):
    q, u = _embedded(spark, d)
    found = retrieval.dense_search(q, u)
    return found.select("question_id", "unit_id", F.round("dense_score", 9).alias("dense_score"), F.col("rank").cast("long").alias("rank"))


def _pooled(spark, d, index=None):
    """Candidates of both searches, written once: they are few, so what is joined to them is not shuffled."""
    q, u = index or _embedded(spark, d)
    sparse = written(retrieval.sparse_scan(q, u), "sparse-found")
    both = [df.select(key, F.col("embedding").alias(name)) for df, key, name in ((q, "question_id", "_q"), (u, "unit_id", "_u"))]
    carried = F.round(vectors.cosine(F.col("_q"), F.col("_u")), retrieval.DIGITS).alias("dense_score")
    sparse = sparse.join(both[0], "question_id").join(both[1], "unit_id").select("question_id", "unit_id", "hits", "rank", "sparse_score", carried)
    return written(retrieval.pool(retrieval.dense_search(q, u), sparse, ["question_id", "unit_id"]), "pooled")


@query(f"SELECT question_id, unit_id, dense_rank, sparse_rank, dense AS dense_score FROM ({_POOL}) p")
def R9_pool(spark, d):
    p = _pooled(spark, d)
    return p.select("question_id", "unit_id", *(F.col(c).cast("long").alias(c) for c in ("dense_rank", "sparse_rank")), "dense_score")


def _ranked(spark, d):
    """Candidates of both searches with coverage and hybrid rank."""
    from pyspark.sql import Window

    q, u = index = _embedded(spark, d)
    joined = _pooled(spark, d, index).join(u.drop("embedding"), "unit_id").join(q.select("question_id", "terms"), "question_id")
    scored = retrieval.with_coverage(joined).drop("stems")
    hybrid = F.round(retrieval.hybrid_score(F.col("dense_score"), F.col("coverage"), F.col("title_coverage")), 9)
    order = Window.partitionBy("question_id").orderBy(F.col("hybrid").desc(), "unit_id")
    return written(scored.withColumn("hybrid", hybrid).withColumn("rank", F.row_number().over(order)), "ranked")


@query(f"SELECT question_id, unit_id, round(coverage, 6) AS coverage, round(title_coverage, 6) AS title_coverage, hybrid, CAST(rank AS BIGINT) AS rank FROM ({_HYBRID}) h")
def R11_hybrid_retrieval(spark, d):
    return _ranked(spark, d).select(
        "question_id", "unit_id", F.round("coverage", 6).alias("coverage"), F.round("title_coverage", 6).alias("title_coverage"),
        "hybrid", F.col("rank").cast("long").alias("rank"),
    )


_RELEVANT = "((n_terms < 2 AND title_coverage = 1) OR (dense >= 0.5 AND (coverage >= 0.34 OR dense >= 0.62)))"
_STRONG = "(dense >= 0.72 OR (n_terms < 2 AND title_coverage = 1) OR (dense >= 0.55 AND (n_terms < 2 OR coverage >= 0.5)))"
_EVIDENCE = f"""SELECT *, concat('E', row_number() OVER (PARTITION BY question_id ORDER BY rank)) AS ref FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY best DESC, rank) AS turn FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, best ORDER BY rank) AS place, max(best) OVER (PARTITION BY question_id, doc_id) AS owns FROM (
      SELECT *, CASE WHEN f = 1 AND row_number() OVER (PARTITION BY question_id, f = 1 ORDER BY rank) <= 6 THEN 1 ELSE 0 END AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id, source_slug ORDER BY rank) AS f FROM ({_HYBRID}) h WHERE {_RELEVANT}) a) b) c
  WHERE best = 1 OR place + owns <= 2) e WHERE turn <= 6"""


@query(f"SELECT question_id, unit_id, CAST(rank AS BIGINT) AS rank, ref FROM ({_EVIDENCE}) e")
def R15_select_evidence(spark, d):
    return retrieval.relevant_evidence(_ranked(spark, d)).select("question_id", "unit_id", F.col("rank").cast("long").alias("rank"), "ref")


@query(f"SELECT question_id, unit_id, {_RELEVANT} AS relevant, {_STRONG} AS strong FROM ({_HYBRID}) h")
def R14_relevant(spark, d):
    r = _ranked(spark, d)
    own = {name: retrieval.judged(test, r) for name, test in (("relevant", retrieval.is_relevant), ("strong", retrieval.is_strong))}
    return r.select("question_id", "unit_id", *(c.alias(n) for n, c in own.items()))


@query(f"""SELECT q.question_id, coalesce(c.candidates, 0) AS candidates, coalesce(c.dense_hits, 0) AS dense_hits, coalesce(c.sparse_hits, 0) AS sparse_hits,
    coalesce(e.evidence, 0) AS evidence, round(coalesce(c.dense, 0.0), 6) AS best_dense, round(coalesce(c.best, 0.0), 6) AS best_coverage,
    CASE WHEN c.candidates IS NULL THEN 'no_source' WHEN e.evidence IS NULL OR NOT e.strong THEN 'weak_evidence' ELSE 'sufficient' END AS verdict
    FROM v_questions q LEFT JOIN (SELECT question_id, count(*) AS candidates, count(dense_rank) AS dense_hits, count(sparse_rank) AS sparse_hits, max(dense) AS dense,
      max(CASE WHEN n_terms >= 2 THEN coverage END) AS best FROM ({_HYBRID}) h GROUP BY 1) c ON c.question_id = q.question_id
    LEFT JOIN (SELECT question_id, count(*) AS evidence, bool_or({_STRONG}) AS strong FROM ({_EVIDENCE}) e GROUP BY 1) e ON e.question_id = q.question_id""")
def R17_sufficiency(spark, d):
    ranked = _ranked(spark, d)
    out = retrieval.sufficiency(view(spark, d, "v_questions"), ranked, retrieval.relevant_evidence(ranked))
    return out.withColumn("best_coverage", F.round("best_coverage", 6)).withColumn("best_dense", F.round("best_dense", 6))


@query(f"SELECT term, df, round(ln(1 + (SELECT count(*) FROM ({_APPROVED}) n) / df), 6) AS idf FROM (SELECT term, count(DISTINCT unit_id) AS df FROM ({_POST}) p GROUP BY term) x")
def R20_idf(spark, d):
    a = _approved(spark, d)
    found = retrieval.idf(retrieval.postings(a), a.count())
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""SELECT question_id, doc_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY first) AS BIGINT) AS doc_rank FROM (
    SELECT question_id, doc_id, min(rank) AS first FROM ({_HYBRID}) h GROUP BY 1, 2) f""")
def R24_distinct_documents(spark, d):
    return retrieval.distinct_documents(_ranked(spark, d)).select("question_id", "doc_id", F.col("doc_rank").cast("long").alias("doc_rank"))


@query("""SELECT s.slug, coalesce(u.n, 0) AS units, CASE WHEN s.status <> 'approved' THEN s.status WHEN u.n IS NULL THEN 'not_indexed' ELSE 'searched' END AS state
          FROM v_sources s LEFT JOIN (SELECT source_slug, count(*) AS n FROM v_units GROUP BY 1) u ON u.source_slug = s.slug""")
def R25_sources_searched(spark, d):
    return usage.sources_searched(view(spark, d, "v_sources"), units(spark, d))


# --- verification -----------------------------------------------------------------------------------------------------

_CLAIMS = """SELECT u.conv_id * 1000 + u.turn AS question_id, a.text AS evidence,
    CASE WHEN (u.conv_id + u.turn) % 3 = 0 THEN concat(substr(a.text, 1, 20), ' … ', substr(a.text, 30, 15)) WHEN (u.conv_id + u.turn) % 3 = 1 THEN concat('x', substr(u.text, 1, 20)) ELSE substr(a.text, 5, 5) END AS quote
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""


def _claims(spark, d):
    c = table(spark, d, "conversations")
    u, a = c.filter("role = 'user'").alias("u"), c.filter("role = 'assistant'").alias("a")
    j = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    which = (F.col("u.conv_id") + F.col("u.turn")) % 3
    said = F.col("a.text")
    quote = (
        F.when(which == 0, F.concat(F.substring(said, 1, 20), F.lit(" … "), F.substring(said, 30, 15)))
        .when(which == 1, F.concat(F.lit("x"), F.substring("u.text", 1, 20)))
        .otherwise(F.substring(said, 5, 5))
    )
    return j.select((F.col("u.conv_id") * 1000 + F.col("u.turn")).alias("question_id"), said.alias("evidence"), quote.alias("quote"))


_SEG = f"list_filter(list_transform(string_split_regex(quote, '\\.\\.\\.|…'), lambda s: {NORM.format('s')}), lambda s: s <> '')"
_GROUNDED = f"""SELECT question_id, coalesce(CASE WHEN len(seg) = 0 OR list_sum(list_transform(seg, lambda s: length(s))) < 12 THEN false
    WHEN len(seg) = 1 THEN position(seg[1] IN body) > 0
    ELSE position(seg[1] IN body) > 0 AND position(seg[2] IN substr(body, position(seg[1] IN body) + length(seg[1]))) > 0 END, false) AS grounded
    FROM (SELECT question_id, {_SEG} AS seg, {NORM.format('evidence')} AS body FROM ({_CLAIMS}) c) s"""


@query(_GROUNDED)
def X2_grounded(spark, d):
    return _claims(spark, d).select("question_id", verification.quoted_in(F.col("quote"), F.col("evidence")).alias("grounded"))


@query(f"""SELECT question_id, CASE WHEN question_id % 5 = 0 THEN 'weak_evidence' WHEN NOT grounded OR question_id % 7 = 0 THEN 'verification_failed' ELSE 'answer' END AS decision,
    CASE WHEN question_id % 5 = 0 THEN 0 WHEN grounded AND question_id % 7 <> 0 THEN 1 ELSE 0 END AS kept FROM ({_GROUNDED}) g""")
def X10_gate(spark, d):
    c = _claims(spark, d).withColumn("grounded", verification.quoted_in(F.col("quote"), F.col("evidence")))
    label = F.when(F.col("question_id") % 7 == 0, "contradicted").otherwise("entailed")
    claims = c.filter("question_id % 5 <> 0").withColumn("role", F.lit("summary")).withColumn("entailment", label)
    ok = verification.supported(F.lit(True), F.col("grounded"), F.lit(None).cast("double"), F.col("entailment"))
    return verification.gate(c, claims.withColumn("supported", ok)).withColumn("kept", F.col("kept").cast("int"))


@query("""SELECT page_id, CAST(min("start") AS BIGINT) AS "start", CAST(max("end") AS BIGINT) AS "end" FROM (
    SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY "start", "end") AS island FROM (
      SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY page_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n
      FROM (SELECT user_id AS page_id, event_id % 997 AS "start", event_id % 997 + event_id % 9 AS "end" FROM events) s) x) y GROUP BY page_id, island""")
def T27_merge_spans(spark, d):
    spans = table(spark, d, "events").select(
        F.col("user_id").alias("page_id"), (F.col("event_id") % 997).alias("start"), (F.col("event_id") % 997 + F.col("event_id") % 9).alias("end")
    )
    return verification.merge_spans(spans, "page_id")


# --- usage, budget and governance -------------------------------------------------------------------------------------

_COST = "CASE WHEN model = 'base' THEN (greatest(input_tokens - cached_input_tokens, 0) * 0.75 + cached_input_tokens * 0.075 + output_tokens * 4.5) / 1e6 END"


def _priced(spark, d):
    prices = spark.sql("SELECT 'base' AS model, 0.75D AS price_in, 0.075D AS price_cached, 4.5D AS price_out UNION ALL SELECT 'unpriced', 1D, NULL, NULL")
    rows = usage.price_lookup(view(spark, d, "v_usage"), prices)
    return rows.withColumn("cost", usage.estimate_cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens")))


@query(f"SELECT event_id, round({_COST}, 9) AS cost FROM v_usage")
def U2_estimate_cost(spark, d):
    return _priced(spark, d).select("event_id", F.round("cost", 9).alias("cost"))


@query(f"""SELECT session_id, count(*) FILTER (api_call) AS api_calls, count(*) FILTER (status = 'cache_hit') AS cache_hits, count(*) FILTER (status = 'budget_exceeded') AS refusals,
    CAST(coalesce(sum(input_tokens) FILTER (api_call), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens) FILTER (api_call), 0) AS BIGINT) AS output_tokens,
    CASE WHEN NOT bool_or(api_call AND model = 'unpriced') THEN round(coalesce(sum({_COST}) FILTER (api_call), 0.0), 6) END AS cost FROM v_usage GROUP BY session_id""")
def U3_request_usage(spark, d):
    return usage.request_usage(_priced(spark, d), "session_id")


@query(f"SELECT count(*) AS api_calls, round(coalesce(sum({_COST}), 0.0), 6) AS cost FROM v_usage WHERE api_call AND ts >= date_trunc('day', TIMESTAMP '2024-01-15 12:00:00') AND ts <= TIMESTAMP '2024-01-15 12:00:00'")
def U4_today_totals(spark, d):
    return usage.today_totals(_priced(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query(f"""WITH c AS (SELECT *, {_COST} AS cost FROM v_usage), n AS (SELECT max(ts) AS now FROM v_usage),
    s AS (SELECT unnest([CASE WHEN ts >= date_trunc('day', now) THEN 'today' END, concat('session ', session_id)]) AS scope, c.* FROM c, n),
    m AS (SELECT scope, count(*) FILTER (api_call) AS api_calls, count(*) FILTER (status = 'cache_hit') AS cache_hits, count(*) FILTER (status = 'budget_exceeded') AS refusals,
      CAST(coalesce(sum(input_tokens) FILTER (api_call), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens) FILTER (api_call), 0) AS BIGINT) AS output_tokens,
      coalesce(sum(cost), 0.0) AS cost, count(*) FILTER (api_call AND cost IS NULL) AS unpriced_calls,
      count(*) FILTER (event_id % 3 = 0 AND event_id % 7 <> 0) AS questions, count(*) FILTER (event_id % 3 = 0 AND event_id % 7 <> 0 AND event_id % 4 = 0) AS resolved_without FROM s WHERE scope IS NOT NULL GROUP BY scope)
    SELECT scope, api_calls, cache_hits, refusals, input_tokens, output_tokens, unpriced_calls, questions, resolved_without, CAST(round(CAST(cache_hits / nullif(api_calls + cache_hits, 0) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS hit_rate,
      CAST(round(CAST(cost AS DECIMAL(18, 9)), 4) AS DOUBLE) AS cost, CAST(round(CAST(cost / nullif(questions, 0) AS DECIMAL(18, 9)), 5) AS DOUBLE) AS cost_per_question FROM m""")
def U5_usage_report(spark, d):
    """Every third event is an answer; every seventh of them was made before model calls were recorded."""
    u = view(spark, d, "v_usage")
    now = F.lit(u.agg(F.max("ts")).first()[0])  # one value
    n = F.col("event_id")
    answers = u.filter(n % 3 == 0).select("session_id", "ts", F.when(n % 7 != 0, n % 4).alias("model_calls"))
    return usage.usage_report(_priced(spark, d), answers, now)


@query(f"""WITH p AS (SELECT event_id, api_call, date_trunc('day', ts) AS day, ts,
      coalesce(sum(CAST(api_call AS INT)) OVER w, 0) AS calls, coalesce(sum(n) OVER w, 0) - coalesce(sum(n) OVER o, 0) AS spent FROM (
        SELECT *, CASE WHEN api_call THEN coalesce(CAST(round({_COST} * 1e9) AS BIGINT), 0) ELSE 0 END AS n FROM v_usage) u
      WINDOW w AS (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        o AS (PARTITION BY date_trunc('day', ts), session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT day, min((ts, event_id)) AS stop, arg_min(calls, (ts, event_id)) AS calls, arg_min(spent, (ts, event_id)) AS spent
      FROM p WHERE api_call AND (calls >= 40 OR spent >= 9000000) GROUP BY day)
    SELECT p.event_id, CAST(CASE WHEN (p.ts, p.event_id) >= s.stop THEN s.calls ELSE p.calls END AS BIGINT) AS made,
      round(CASE WHEN (p.ts, p.event_id) >= s.stop THEN s.spent ELSE p.spent END / 1e9, 9) AS spent, p.api_call AND coalesce((p.ts, p.event_id) >= s.stop, false) AS refused
    FROM p LEFT JOIN s ON s.day = p.day""")
def U10_budget_gate(spark, d):
    told = usage.budget_gate(_priced(spark, d), 40, 0.009, pending="session_id")
    return told.withColumn("spent", F.round("spent", 9))


@query("""SELECT event_id, coalesce(epoch(ts) - last < 600, false) AS refused FROM (SELECT event_id, ts, max(CASE WHEN status = 'timeout' THEN epoch(ts) END)
    OVER (PARTITION BY model ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM v_usage) x""")
def U11_cooldown_filter(spark, d):
    return usage.cooldown_filter(view(spark, d, "v_usage"), F.col("status") == "timeout", 600)


@query("SELECT outcome, count(*) AS questions FROM v_answers GROUP BY outcome")
def U12_routing_simulation(spark, d):
    return usage.routing_simulation(view(spark, d, "v_answers"))


@query("""SELECT s.slug, CAST(s.priority AS INT) AS priority, s.status, coalesce(x.documents, 0) AS documents, coalesce(x.disabled, 0) AS disabled, coalesce(u.units, 0) AS units FROM v_sources s
    LEFT JOIN (SELECT source_slug, count(*) AS documents, count(*) FILTER (status = 'disabled') AS disabled FROM v_docs GROUP BY 1) x ON x.source_slug = s.slug
    LEFT JOIN (SELECT source_slug, count(*) AS units FROM v_units GROUP BY 1) u ON u.source_slug = s.slug""")
def D1_sources_with_counts(spark, d):
    return usage.sources_with_counts(view(spark, d, "v_sources"), view(spark, d, "v_docs"), units(spark, d))


@query("SELECT slug, CAST(priority AS INT) AS priority, status FROM v_sources")
def D2_list_sources(spark, d):
    return usage.list_sources(view(spark, d, "v_sources"))


@query("SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_answers), 6) AS share FROM v_answers GROUP BY outcome")
def D12_outcome_share(spark, d):
    return usage.outcome_share(view(spark, d, "v_answers"))


@query(f"""SELECT key, question, reason, n, last FROM (SELECT {NORM.format('q.question')} AS key, min(q.question) AS question, min(a.reason) AS reason, count(*) AS n, max(e.ts) AS last
    FROM v_answers a JOIN v_question_log q ON q.question_id = a.question_id JOIN events e ON e.event_id = a.question_id % 1000
    WHERE a.outcome = 'abstention' AND e.ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1) g ORDER BY n DESC, last DESC, key LIMIT 10""")
def D7_content_gaps(spark, d):
    """Answers take their time from the event that their id points to."""
    e = table(spark, d, "events")
    at = e.select(F.col("event_id").alias("_e"), F.col("ts").alias("at"))
    answers = view(spark, d, "v_answers").join(at, F.col("question_id") % 1000 == F.col("_e")).drop("_e")
    now = F.lit(e.agg(F.max("ts")).first()[0])  # one value
    return usage.content_gaps(view(spark, d, "v_question_log"), answers, text.normalize("question"), now)


@query("SELECT session_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(status, (ts, event_id)) AS last_status FROM v_usage GROUP BY session_id")
def D13_sessionize(spark, d):
    return usage.sessionize(view(spark, d, "v_usage"))


# --- evaluation -------------------------------------------------------------------------------------------------------


def _first_ranks(spark, d):
    v = view(spark, d, "v_vectors")
    truth = v.filter("is_query").select(F.col("vec_id").alias("query_id"), "label").join(v.select("vec_id", "label"), "label").filter("vec_id <> query_id")
    ranks = evaluation.rank_of(_others(spark, d, 10), truth.select("query_id", "vec_id"), "query_id", "vec_id")
    return v.filter("is_query").select(F.col("vec_id").alias("query_id"), "label").join(ranks, "query_id", "left")


_RANKS = f"SELECT q.vec_id AS query_id, q.label AS label, min(t.rank) AS first_rank FROM v_vectors q LEFT JOIN ({_REST}) t ON t.query_id = q.vec_id AND t.rank <= 10 AND t.label = t.query_label WHERE q.is_query GROUP BY 1, 2"


@query(f"SELECT query_id, label, CAST(first_rank AS INT) AS first_rank FROM ({_RANKS}) r")
def E1_rank_of(spark, d):
    return _first_ranks(spark, d)


@query(f"""SELECT coalesce(CAST(label AS VARCHAR), 'all') AS label, count(*) AS n, round(avg(coalesce(CAST(first_rank <= 1 AS INT), 0)), 6) AS top1, round(avg(coalesce(CAST(first_rank <= 3 AS INT), 0)), 6) AS top3,
    round(avg(coalesce(CAST(first_rank <= 5 AS INT), 0)), 6) AS top5 FROM ({_RANKS}) r GROUP BY ROLLUP (label)""")
def E2_topk_rates(spark, d):
    return evaluation.topk_rates(_first_ranks(spark, d), "label")


@query("SELECT event_type, min(value) AS min, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY event_type")
def E4_nearest_rank_percentiles(spark, d):
    return evaluation.nearest_rank_percentiles(table(spark, d, "events"), "event_type", "value")


@query("""SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events) x
          WHERE p = floor(n * 95 / 100)""")
def E5_truncated_p95(spark, d):
    return evaluation.truncated_p95(table(spark, d, "events").select("event_type", "value"), "event_type", "value")


@query("SELECT item_id, CASE WHEN row_number() OVER (ORDER BY item_id) % 2 = 1 THEN 'tuning' ELSE 'validation' END AS half FROM benchmark")
def E10_split_items(spark, d):
    return evaluation.split_items(table(spark, d, "benchmark"), "item_id")


# --- windows over logs ------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def W1_rate_limit_windows(spark, d):
    from veridoc.streaming.logs import rate_limit_windows

    return rate_limit_windows(table(spark, d, "events"), limit=1)


@query("""SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS requests FROM (
    SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events) a) b GROUP BY user_id, s""")
def W3_session_windows(spark, d):
    from veridoc.streaming.logs import session_windows

    return session_windows(table(spark, d, "events"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
