"""Registered queries of sentences to quote, page parsing, attribution, ranking variants and late data."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.functions.shared import shared_dir
from veridoc.operators import attribution as A
from veridoc.operators import ingest, retrieval, verification
from veridoc.operators.index_store import IndexStore
from veridoc.plans.queries import _TOP, NORM, _approved, _nearest, query, table
from veridoc.sources import snapshots
from veridoc.sources.views import view
from veridoc.streaming import logs, stateful


@query(f"SELECT question_id, {NORM.format('question')} AS norm, CAST(length({NORM.format('question')}) AS BIGINT) AS n_origins, true AS ascending FROM v_questions")
def T17_normalize_with_map(spark, d):
    m = view(spark, d, "v_questions").select("question_id", text.normalize_with_map("question").alias("m"))
    ascending = F.array_sort("m.origin") == F.col("m.origin")
    return m.select("question_id", "m.norm", F.size("m.origin").cast("long").alias("n_origins"), ascending.alias("ascending"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(b, '^.{3,}(كم|هم|ها|وا)$') THEN substr(b, 1, length(b) - 2)
      WHEN regexp_matches(b, '^.{3,}(ك|ت|و)$') THEN substr(b, 1, length(b) - 1) ELSE b END AS core
    FROM (SELECT doc_id, CASE WHEN regexp_matches(a, '^[تينا].{3,}$') THEN substr(a, 2) ELSE a END AS b
      FROM (SELECT doc_id, CASE WHEN regexp_matches(s, '^ف[تين].{3,}$') THEN substr(s, 2) ELSE s END AS a FROM (
        SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'فت' WHEN 1 THEN 'ي' ELSE '' END, replace(source_slug, ' ', ''), CASE doc_id % 4 WHEN 0 THEN 'هم' WHEN 1 THEN 'ت' WHEN 2 THEN 'وا' ELSE '' END) AS s
        FROM v_docs) x) y) z""")
def T25_person_core(spark, d):
    lead = F.when(F.col("doc_id") % 3 == 0, "فت").when(F.col("doc_id") % 3 == 1, "ي").otherwise("")
    tail = F.when(F.col("doc_id") % 4 == 0, "هم").when(F.col("doc_id") % 4 == 1, "ت").when(F.col("doc_id") % 4 == 2, "وا").otherwise("")
    stem = F.concat(lead, F.replace("source_slug", F.lit(" "), F.lit("")), tail)
    return view(spark, d, "v_docs").select("doc_id", text.person_core(stem).alias("core"))


@query()
def K4_quotable_sentences(spark, d):
    s = view(spark, d, "v_docs").select("doc_id", F.posexplode(text.quotable_sentences("body")).alias("ordinal", "sentence"))
    return s.select("doc_id", "ordinal", F.length("sentence").alias("chars"), F.sha2("sentence", 256).alias("sentence_hash"))


@query()
def K5_concise(spark, d):
    v = view(spark, d, "v_docs").withColumn("terms", text.content_terms("title"))
    s = v.select("doc_id", "terms", F.posexplode(text.quotable_sentences("body")).alias("ordinal", "sentence"))
    long = s.filter(F.length("sentence") > 260)  # shorter ones stay as they are
    piece = text.concise("sentence", F.col("terms"))
    return long.select("doc_id", "ordinal", F.length(piece).alias("chars"), F.sha2(piece, 256).alias("piece_hash"))


@query()
def S15_extract_pages(spark, d):
    found = snapshots.extract_pages(table(spark, d, "pages"))
    return found.select("page_id", "title", F.size("answer").alias("paragraphs"), F.sha2(F.array_join("answer", "\n\n"), 256).alias("answer_hash"))


@query(r"""SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(body, '\s+', ' ', 'g')), ''), source_slug)) AS record_hash FROM v_docs""")
def S23_compose_record(spark, d):
    return view(spark, d, "v_docs").select("doc_id", F.sha2(ingest.compose_record(F.col("title"), F.col("body"), F.col("source_slug")), 256).alias("record_hash"))


@query(r"""SELECT page_id, slug, page FROM (SELECT page_id, CASE WHEN regexp_matches(url, 'example\.net/en/\d+') THEN 'net-en' WHEN regexp_matches(url, 'example\.(net|org)/[a-z]+/\d+') THEN 'others' END AS slug,
    regexp_extract(url, '/[a-z]+/(\d+)', 1) AS page FROM pages) p WHERE slug IS NOT NULL""")
def S26_route_urls(spark, d):
    rules = [("net-en", 1, r"example\.net/en/(\d+)"), ("others", 2, r"example\.(?:net|org)/[a-z]+/(\d+)")]
    sites = spark.createDataFrame(rules, "slug string, ord int, pattern string")
    urls = table(spark, d, "pages").select("page_id", "url", F.lit(0).alias("place"))
    return ingest.route_urls(urls, sites, "page_id", 5).select("page_id", "slug", "page")


@query(r"""SELECT doc_id, nullif(regexp_replace(body, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g'), '') AS found FROM v_docs""")
def X6_source_quote(spark, d):
    spaced = F.replace(F.regexp_replace("body", r"\.\.\.|…", " "), F.lit(" "), F.lit(" , "))
    return view(spark, d, "v_docs").select("doc_id", verification.source_quote(F.col("body"), spaced).alias("found"))


@query(f"""WITH e AS (SELECT query_id AS message_id, vec_id, label AS doc_id, rank FROM ({_TOP}) t WHERE rank <= 24),
    own AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY rank) AS k FROM e WHERE vec_id % 2 = 1),
    b AS (SELECT message_id, doc_id, 0 AS turn, k AS rank FROM own WHERE k <= 4 UNION ALL SELECT message_id, doc_id, 1, rank FROM e),
    f AS (SELECT message_id, doc_id, min(turn * 1000 + rank) AS spot FROM b GROUP BY 1, 2)
    SELECT message_id, doc_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY spot, doc_id) AS k FROM f) r WHERE k <= 8""")
def A7_candidate_documents(spark, d):
    labels = view(spark, d, "v_vectors").select("vec_id", F.col("label").alias("doc_id"))
    e = _nearest(spark, d, 24).select(F.col("query_id").alias("message_id"), "vec_id", "rank").join(labels, "vec_id")
    own = e.filter("vec_id % 2 = 1").withColumn("rank", F.row_number().over(Window.partitionBy("message_id").orderBy("rank")))
    return A.candidate_documents(e, own)


def _messages(spark, d):
    """Statements that name a source, some of them another than the one that holds their words."""
    n = F.col("question_id") % 20
    said = F.concat(F.lit("src"), n.cast("string"), F.lit(" said in a letter: \""), F.substring("question", 1, 120), F.lit("\""))
    return view(spark, d, "v_questions").select(F.col("question_id").alias("message_id"), F.when(n < 15, said).otherwise(F.substring("question", 1, 120)).alias("message"))


@query()
def A9_attribution_report(spark, d):
    """From messages to verdicts: the named source, the claim, documents of that source and of all, windows, verdict."""
    names = view(spark, d, "v_sources").select(F.col("slug").alias("source_slug"), F.expr("cast(substr(slug, 4) AS int)").alias("ord"), F.col("slug").alias("name"))
    asked = A.attributed_source(_messages(spark, d), names, text="message")
    lead = F.regexp_extract("message", A.INTRODUCTION, 1)
    asked = asked.withColumn("claim", A.split_claim(F.col("message"), F.col("named").isNotNull() & F.contains(lead, F.col("named")))).drop("message")
    units = _approved(spark, d)
    terms = retrieval.query_terms(asked.select(F.col("message_id").alias("question_id"), F.col("claim").alias("question"), "named"))
    hits = retrieval.sparse_hits(terms, retrieval.postings(units, only=terms.select(F.explode("terms").alias("term"))))
    placed = hits.join(units.select("unit_id", "doc_id", "source_slug"), "unit_id").join(terms.select("question_id", "named"), "question_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("hits").desc(), "unit_id"))).filter(F.col("rank") <= 24)
    found = [ranked(df).select(F.col("question_id").alias("message_id"), "doc_id", "rank") for df in (placed, placed.filter("source_slug = named"))]
    docs = A.candidate_documents(*found).join(view(spark, d, "v_docs").select("doc_id", "source_slug", F.col("body").alias("content")), "doc_id")
    pairs = docs.join(asked.select("message_id", "claim"), "message_id")
    matches = A.closest_passages(pairs, ["message_id", "rank"]).select("message_id", "doc_id", "source_slug", "passage", "coverage")
    by_cover = F.row_number().over(Window.partitionBy("message_id").orderBy(F.col("coverage").desc(), "doc_id"))
    out = A.attribution_report(asked, matches.withColumn("rank", by_cover).drop("doc_id"))
    return out.select("message_id", "named", "verdict", F.sha2(F.coalesce("quote", F.lit("")), 256).alias("quote_hash"), "coverage")


_CONFIG_ROWS = ", ".join(f"('{n}', {p}, {str(i).lower()}, {str(c).lower()}, '{by}')" for n, p, i, c, by in retrieval.CONFIGS)


@query(f"""WITH e AS (SELECT query_id AS question_id, vec_id AS unit_id, rank AS dense_rank, round(score, 9) AS dense_score, CASE WHEN vec_id % 3 > 0 THEN 1 + vec_id % 40 END AS sparse_rank,
      CASE WHEN vec_id % 4 > 0 THEN 1 + vec_id % 30 END AS sparse_idf_rank, (vec_id % 5) / 4.0 AS coverage, (vec_id % 9) / 8.0 AS coverage_idf, (vec_id % 2) / 1.0 AS title_coverage FROM ({_TOP}) t WHERE rank <= 64),
    c(config, pool, by_idf, cover_idf, kind) AS (VALUES {_CONFIG_ROWS}),
    x AS (SELECT *, CASE WHEN dense_rank <= pool THEN dense_rank END AS dr, CASE WHEN (CASE WHEN by_idf THEN sparse_idf_rank ELSE sparse_rank END) <= pool THEN CASE WHEN by_idf THEN sparse_idf_rank ELSE sparse_rank END END AS sr FROM e, c),
    y AS (SELECT config, question_id, unit_id, round(CASE kind WHEN 'rrf' THEN coalesce(1.0 / (60 + dr), 0) + coalesce(1.0 / (60 + sr), 0) WHEN 'dense' THEN dense_score
      ELSE dense_score + 0.25 * CASE WHEN cover_idf THEN coverage_idf ELSE coverage END + 0.1 * title_coverage END, 9) AS score FROM x WHERE dr IS NOT NULL OR sr IS NOT NULL)
    SELECT config, question_id, unit_id, score, CAST(row_number() OVER (PARTITION BY config, question_id ORDER BY score DESC, unit_id) AS INT) AS rank FROM y""")
def R23_rank_configs(spark, d):
    i = F.col("vec_id")
    found = _nearest(spark, d, 64).select(
        F.col("query_id").alias("question_id"), i.alias("unit_id"), F.col("rank").alias("dense_rank"), F.round("score", 9).alias("dense_score"),
        F.when(i % 3 > 0, 1 + i % 40).alias("sparse_rank"), F.when(i % 4 > 0, 1 + i % 30).alias("sparse_idf_rank"),
        (i % 5 / 4.0).alias("coverage"), (i % 9 / 8.0).alias("coverage_idf"), (i % 2 / 1.0).alias("title_coverage"),
    )
    return retrieval.rank_configs(found)


@query()
def W6_redact_stream(spark, d):
    told = logs.redact_stream(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return told.select("conv_id", "turn", F.sha2("text", 256).alias("redacted_hash"), F.array_join("pii_types", ",").alias("types"))


@query("""WITH b AS (SELECT *, event_id * 7 % 100 AS batch FROM events), n AS (SELECT batch, max(ts) AS newest FROM b GROUP BY 1),
    m AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 DAYS AS mark FROM n)
    SELECT event_id, coalesce(ts < mark, false) AS late FROM b JOIN m USING (batch)""")
def W8_split_late(spark, d):
    arrived = table(spark, d, "events").withColumn("batch", F.col("event_id") * 7 % 100)
    return stateful.split_late(arrived, "10 DAYS").select("event_id", "late")


@query(r"""SELECT doc_id, count(*) AS units, sha256(string_agg(content, chr(10) ORDER BY pos)) AS told FROM (
    SELECT doc_id, unnest(string_split(body, chr(10))) AS content, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM v_docs_next) l
    WHERE regexp_matches(content, '\S') GROUP BY doc_id""")
def S11_incremental_index(spark, d):
    """The lines of all documents indexed, then those of changed and new documents alone, and what is gone dropped: a rebuild's rows."""
    old, new = view(spark, d, "v_docs").select("doc_id", "body"), view(spark, d, "v_docs_next").select("doc_id", "body")
    lines = lambda docs: docs.select("doc_id", F.posexplode(F.split("body", "\n")).alias("pos", "content")).filter(F.col("content").rlike(r"\S"))
    store = IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    store.apply(lines(old), old.select("doc_id"), 0)
    changed = new.join(old, ["doc_id", "body"], "left_anti")
    store.apply(lines(changed), changed.select("doc_id").unionByName(old.select("doc_id").join(new, "doc_id", "left_anti")), 1)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    return store.read().groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sha2(told, 256).alias("told"))
