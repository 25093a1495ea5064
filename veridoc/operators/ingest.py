"""Sources, change detection, manifests and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import normalize, search_text, stems
from veridoc.functions.vectors import hash_embed
from veridoc.operators.index_store import IndexStore
from veridoc.operators.chunking import chunks


def content_hash(question: Column, answer: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(question, F.lit("")), F.lit("\n\n"), F.coalesce(answer, F.lit(""))), 256)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both by key; where both have a key, ``columns`` come from the updates and the rest from the base."""
    b, u = base.withColumn("_in_b", F.lit(True)).alias("b"), updates.withColumn("_in_u", F.lit(True)).alias("u")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    out = []
    for c in base.columns:
        mine, theirs = F.col(f"b.{c}"), F.col(f"u.{c}") if c in updates.columns else F.lit(None)
        newer = F.col("u._in_u") if c in columns else F.col("b._in_b").isNull()
        out.append(F.when(newer, theirs).otherwise(mine).alias(c) if c not in keys else F.coalesce(mine, theirs).alias(c))
    return b.join(u, on, "full_outer").select(*out)


def classify_changes(existing: DataFrame, snapshots: DataFrame, keys: list[str], hash_col: str = "content_sha256",
                     chunks_col: str = "n_current_chunks") -> DataFrame:
    """Snapshots with ``change``: unchanged (same hash and a chunk of the current model), updated or new."""
    old = existing.select(*keys, F.col(hash_col).alias("_old"), F.col(chunks_col).alias("_chunks"))
    same = (F.col("_old") == F.col(hash_col)) & (F.col("_chunks") > 0)
    change = F.when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("_old").isNotNull(), "updated").otherwise("new")
    return snapshots.join(old, keys, "left").withColumn("change", change).drop("_old", "_chunks")


def seed_report(classified: DataFrame) -> DataFrame:
    return classified.groupBy("change").agg(F.count(F.lit(1)).alias("documents"))


def manifest(docs: DataFrame) -> DataFrame:
    """The text-free listing of a corpus, in source and numeric id order."""
    return docs.select("source_slug", "external_id", "content_sha256").orderBy("source_slug", F.col("external_id").cast("long"))


def manifest_diff(listed: DataFrame, local: DataFrame) -> DataFrame:
    """present, missing or changed, for each listed document."""
    have = local.select("source_slug", "external_id", F.col("content_sha256").alias("_local"))
    state = F.when(F.col("_local").isNull(), "missing").when(F.col("_local") != F.col("content_sha256"), "changed").otherwise("present")
    return listed.join(have, ["source_slug", "external_id"], "left").select("source_slug", "external_id", state.alias("state"))


def extract_links(pages: DataFrame, pattern: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """First occurrence of each link target that matches ``pattern`` (one group), with its place."""
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(1))).alias("place", "target"))
    return found.groupBy(id_col, "target").agg(F.min("place").alias("place"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), r"\s+", " "))


def leaf_nodes(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes that are nobody's parent."""
    return tree.select(node).distinct().join(tree.select(F.col(parent).alias(node)), node, "left_anti")


def merge_categories(listing: DataFrame, item: str, category: str) -> DataFrame:
    """The sorted distinct categories of each item."""
    return listing.groupBy(item).agg(F.array_sort(F.collect_set(category)).alias("categories"))


def round_robin_sample(listing: DataFrame, category: str, item: str, limit: int) -> DataFrame:
    """Item 1 of every category, then item 2, and so on, each item once, up to ``limit``."""
    turn = F.row_number().over(Window.partitionBy(category).orderBy(item))
    first = listing.withColumn("turn", turn).groupBy(item).agg(F.min(F.struct("turn", category)).alias("f"))
    return first.select(F.col("f.turn").alias("turn"), F.col(f"f.{category}").alias(category), item).orderBy("turn", category, item).limit(limit)


def extract_urls(text: Column) -> Column:
    """Distinct URLs in order, without closing punctuation and tracking parameters."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    bare = F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, r"[.,;:)\]}]+$", ""), r"[?&]utm_[^&#]*", ""))
    return F.array_distinct(bare)


def route_sources(registry: DataFrame, adapters: list[str], slug: str = "slug", status: str = "status", ingestion: str = "ingestion") -> DataFrame:
    """What becomes of each source: skipped with a reason, left to live search, or ingested."""
    how = (
        F.when(F.col(status) == "blocked", "skipped (blocked)")
        .when(F.col(ingestion) == "live_search", "live search")
        .when(~F.col(ingestion).isin(adapters), "skipped (no ingestion adapter)")
        .otherwise("ingest")
    )
    return registry.select(slug, how.alias("route"))


def strip_label(paragraphs: Column, label: str) -> Column:
    """Paragraphs without leading ones that are only a label; the label is cut from the first that remains."""
    only = f"^\\s*(?:{label})\\s*[:：]?\\s*$"
    real = F.filter(paragraphs, lambda p: F.trim(p) != "")
    first = F.coalesce(F.array_position(F.transform(real, lambda p: ~p.rlike(only)), True), F.lit(0)).cast("int")
    rest = F.slice(real, F.greatest(first, F.lit(1)), F.size(real) + 1)
    cut = F.transform(rest, lambda p, i: F.when(i == 0, F.regexp_replace(p, f"^\\s*(?:{label})\\s*[:：]\\s*", "")).otherwise(p))
    return F.when(first > 0, cut).otherwise(F.array().cast("array<string>"))


def split_question_answer(paragraphs: Column, question: str, answer: str) -> Column:
    """Struct of the paragraphs from the first question label and from the first answer label behind it, or null."""
    at = lambda label: F.array_position(F.transform(paragraphs, lambda p: p.rlike(f"^\\s*(?:{label})\\s*[:：]")), True).cast("int")
    q, a = at(question), at(answer)
    fine = (q > 0) & (a > q)
    return F.when(fine, F.struct(
        strip_label(F.slice(paragraphs, F.greatest(q, F.lit(1)), F.greatest(a - q, F.lit(0))), question).alias("question"),
        strip_label(F.slice(paragraphs, F.greatest(a, F.lit(1)), F.size(paragraphs) + 1), answer).alias("answer")))


def compose_record(*parts: Column) -> Column:
    """Single-spaced parts joined by blank lines; empty ones are left out."""
    flat = F.transform(F.array(*parts), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(flat, lambda p: p.isNotNull() & (p != "")), "\n\n")


def route_urls(urls: DataFrame, sites: DataFrame, key: str, limit: int) -> DataFrame:
    """First site (by ord) whose pattern matches a URL gives slug and page id; distinct pages, the first ``limit`` per key.

    sites is a small rules table (slug, ord, pattern with one group).
    """
    hits = urls.join(F.broadcast(sites), F.expr("url rlike pattern")).withColumn("page", F.expr("regexp_extract(url, pattern, 1)"))
    first = hits.groupBy(key, "place", "url").agg(F.min(F.struct("ord", "slug", "page")).alias("s"))
    pages = first.groupBy(key, F.col("s.slug").alias("slug"), F.col("s.page").alias("page")).agg(F.min("place").alias("place"))
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("place")
    return pages.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit).drop("_k")


def write_results(tables: dict[str, DataFrame], path: str, batch: str) -> None:
    """One Parquet write per table under a batch folder, so that a rerun of the batch replaces only itself."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def index_documents(docs: DataFrame, indexed: DataFrame | None, dim: int, model: str) -> DataFrame:
    """The index with the documents' units in place of older ones: content, normalised text, search text, vector and model.

    docs: (doc_id, title, body).  A document without units loses its old ones.  ``indexed`` is a frame this function returned.
    """
    cut = chunks(docs).join(docs.select("doc_id", "title"), "doc_id")
    words = F.concat_ws(" ", "title", "content")
    fresh = cut.select(
        "doc_id", "ordinal", "content", normalize("content", compose=True).alias("normalized"), search_text(words, compose=True).alias("search"),
        hash_embed(F.array_distinct(stems(F.concat_ws("\n", "title", "content"), compose=True)), dim).alias("embedding"), F.lit(model).alias("model"),
    )
    if indexed is None:
        return fresh
    return indexed.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def update_index(store: IndexStore, docs: DataFrame, dim: int, model: str, batch: int, gone: DataFrame | None = None) -> None:
    """Index the documents of a batch, and drop those in ``gone`` (doc_id), writing what belongs to them alone."""
    touched = docs.select("doc_id") if gone is None else docs.select("doc_id").unionByName(gone.select("doc_id"))
    store.apply(index_documents(docs, None, dim, model), touched, batch)


def reindex(docs: DataFrame, sources: DataFrame, indexed: DataFrame | None, dim: int, model: str, slug: str | None = None) -> DataFrame:
    """The index after all documents of sources that are not blocked, or of one such source, were indexed anew."""
    open_ = sources.filter("status <> 'blocked'") if slug is None else sources.filter((F.col("slug") == slug) & (F.col("status") != "blocked"))
    return index_documents(docs.join(open_.select(F.col("slug").alias("source_slug")), "source_slug", "left_semi"), indexed, dim, model)


def parse_api_json(rows: DataFrame, schema: str, main: str, column: str = "json") -> DataFrame:
    """Rows with the fields of their JSON text; those without the main field, or with text that is no such record, are left out."""
    parsed = rows.withColumn("_record", F.from_json(column, schema))
    return parsed.filter(F.col(f"_record.{main}").isNotNull()).select(*(c for c in rows.columns if c != column), "_record.*")
