"""Views that give the standard tables the shapes the operators work on.

Each view is one SQL text that Spark and the comparing engine both read, except for hashing, whose function name differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_sources": """
        SELECT source AS slug, CASE WHEN n < 10 THEN n + 1 END AS priority,
               CASE WHEN n = 19 THEN 'blocked' WHEN n IN (17, 18) THEN 'pending' ELSE 'approved' END AS status
        FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM documents) s""",
    "v_docs": """
        SELECT doc_id, CAST(doc_id AS STRING) AS external_id, source AS source_slug, lang,
               substr(split_part(coalesce(text, ''), chr(10), 1), 1, 60) AS title, coalesce(text, '') AS body,
               SHA(concat(chr(10), chr(10), coalesce(text, ''))) AS content_sha256,
               CASE WHEN doc_id % 50 = 0 THEN 'disabled' ELSE 'active' END AS status
        FROM documents""",
    "v_docs_next": """
        SELECT doc_id, source AS source_slug, CASE WHEN doc_id % 10 = 1 THEN concat(coalesce(text, ''), ' (rev)') ELSE coalesce(text, '') END AS body
        FROM documents WHERE doc_id % 13 <> 0
        UNION ALL
        SELECT doc_id + 1000000 AS doc_id, source AS source_slug, coalesce(text, '') AS body FROM documents WHERE doc_id % 17 = 0""",
    "v_questions": "SELECT item_id AS question_id, text AS question FROM benchmark",
    "v_question_log": """
        SELECT conv_id * 1000 + turn AS question_id, conv_id AS session_id, turn, text AS question,
               lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id
        FROM conversations WHERE role = 'user'""",
    "v_vectors": "SELECT vec_id, embedding, label, vec_id % 20 = 0 AS is_query FROM embeddings",
    "v_usage": """
        SELECT event_id, ts, user_id AS session_id,
               CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'cache_hit' WHEN 'purchase' THEN 'budget_exceeded' ELSE 'success' END AS status,
               event_type IN ('view', 'click', 'error') AS api_call, k * 10 AS input_tokens, k AS cached_input_tokens,
               CAST(floor(value) AS BIGINT) AS output_tokens, CASE WHEN event_id % 40 = 0 THEN 'unpriced' ELSE 'base' END AS model
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e""",
    "v_answers": """
        SELECT conv_id * 1000 + turn AS question_id, conv_id, turn,
               CASE (conv_id + turn) % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'abstention' WHEN 2 THEN 'clarification' ELSE 'escalation' END AS outcome,
               CASE conv_id % 4 WHEN 0 THEN 'weak_evidence' WHEN 1 THEN 'no_source' WHEN 2 THEN 'verification_failed' ELSE 'unresolved_conflict' END AS reason
        FROM conversations WHERE role = 'user'""",
}


def _tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    names = ("documents", "benchmark", "conversations", "embeddings", "events", "labels", "pages")
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if f" {n}" in sql}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in ``sf_dir``."""
    sql = VIEWS[name].replace("SHA(concat(chr(10), chr(10), coalesce(text, '')))", "sha2(concat(chr(10), chr(10), coalesce(text, '')), 256)")
    tables = _tables(spark, sf_dir, sql)
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **tables)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval units: lines that are not blank, numbered within their document."""
    docs = view(spark, sf_dir, "v_docs")
    lines = docs.select("doc_id", "source_slug", "title", "status", F.posexplode(F.split("body", "\n")).alias("pos", "content"))
    lines = lines.filter(F.col("content").rlike(r"\S"))
    return lines.select((F.col("doc_id") * (1 << 24) + F.col("pos")).alias("unit_id"), "doc_id", "source_slug", "title", "status", "pos", "content")


UNITS_SQL = """
    SELECT doc_id * 16777216 + pos AS unit_id, doc_id, source_slug, title, status, pos, content
    FROM (SELECT doc_id, source_slug, title, status, unnest(string_split(body, chr(10))) AS content,
                 generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM v_docs) l
    WHERE regexp_matches(content, '\\S')"""


def oracle(sql: str) -> str:
    """The comparing engine's form of a query: its views become common table expressions."""
    needed, todo = [], [sql]
    every = {**VIEWS, "v_units": UNITS_SQL}
    while todo:
        text = todo.pop()
        for n in every:
            if n in text and n not in needed:
                needed.append(n)
                todo.append(every[n])
    order = [n for n in (*VIEWS, "v_units") if n in needed]
    ctes = ", ".join(f"{n} AS ({every[n].replace('SHA(', 'sha256(')})" for n in order)
    if not ctes:
        return sql
    return f"WITH {ctes}, {sql.strip()[5:]}" if sql.strip()[:5].upper() == "WITH " else f"WITH {ctes} {sql}"
