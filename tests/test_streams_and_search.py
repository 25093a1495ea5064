"""Stateful streams and approximate search."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.operators import ann, evaluation, retrieval, sparse
from veridoc.operators.index_store import IndexStore
from veridoc.streaming import stateful


def run(query):
    query.processAllAvailable()
    query.stop()


def stream_of(spark, df, tmp_path, name):
    df.coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def test_daily_budget(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 5} 10:0{i % 5}:00", 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, ts string, cost double").withColumn("ts", F.col("ts").cast("timestamp"))
    out = stateful.daily_budget(stream_of(spark, df, tmp_path, "calls"), 3.0)
    run(out.writeStream.outputMode("append").format("memory").queryName("budget").option("checkpointLocation", str(tmp_path / "cp")).start())
    got = {r["event_id"]: r["refused"] for r in spark.sql("SELECT * FROM budget").collect()}
    assert got == {i: i % 5 >= 3 for i in range(10)}


def test_cache_misses(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:10:00"), ("b", "2024-01-01 10:20:00")], "key string, ts string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    out = stateful.cache_misses(stream_of(spark, df, tmp_path, "asked"))
    run(out.writeStream.outputMode("append").format("memory").queryName("misses").option("checkpointLocation", str(tmp_path / "cp")).start())
    assert sorted(r["key"] for r in spark.sql("SELECT * FROM misses").collect()) == ["a", "b"]


def test_ingest_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "id int, body string, fetched_at int")
    source = stream_of(spark, df, tmp_path, "snaps")
    run(stateful.ingest_stream(source, str(tmp_path / "corpus"), "id", str(tmp_path / "cp")))
    later = spark.createDataFrame([(2, "older", 0), (1, "newest", 3), (3, "y", 1)], "id int, body string, fetched_at int")
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "snaps"))
    run(stateful.ingest_stream(source, str(tmp_path / "corpus"), "id", str(tmp_path / "cp")))
    store = IndexStore(spark, str(tmp_path / "corpus"), "id")
    assert {r["id"]: r["body"] for r in store.read().collect()} == {1: "newest", 2: "x", 3: "y"}


def size_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_index_store_equals_a_rebuild_and_writes_what_changed(spark, tmp_path):
    """Batches of changes, deletions and repeats: the rows are those of a rebuild; a broken-off run is invisible."""
    import random

    rng, now, store = random.Random(2), {}, IndexStore(spark, str(tmp_path / "index"))
    for batch in range(7):
        ids = range(2000) if not batch else rng.sample(range(2100), 20)
        change = {i: [f"{i} {batch} {k} " + "x" * 200 for k in range(rng.randrange(0, 4))] for i in ids}
        before = size_of(tmp_path / "index") if batch else 0
        rows = spark.createDataFrame([(i, k, c) for i, cs in change.items() for k, c in enumerate(cs)], "doc_id int, ordinal int, content string").coalesce(2)
        touched = spark.createDataFrame([(i,) for i in ids], "doc_id int").coalesce(1)
        if batch == 4:  # broken off before the manifest was written
            store._write((0, 4, 4), rows.withColumn("content", F.lit("wrong")), touched)
            assert {(r["doc_id"], r["ordinal"], r["content"]) for r in store.read().collect()} == {(i, k, c) for i, cs in now.items() for k, c in enumerate(cs)}
        now |= change
        store.apply(rows, touched, batch)
        store.apply(rows.withColumn("content", F.lit("again")), touched, batch)
        got = [(r["doc_id"], r["ordinal"], r["content"]) for r in store.read().collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, k, c) for i, cs in now.items() for k, c in enumerate(cs)}
        if batch in (2, 4, 6):  # no merge with the first run
            assert size_of(tmp_path / "index") - before < before / 8
    assert [r[1:] for r in store.runs()] == [(0, 3), (4, 5), (6, 6)]


def test_approximate_search_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rest = v.filter("vec_id % 25 <> 0")
    exact, near = retrieval.knn_exact(q, rest, 5), ann.knn_ann(q, rest, 5)
    assert evaluation.recall(near, exact, "query_id", "vec_id").collect()[0]["recall"] >= 0.9


def test_inverted_file_bounds_are_exact_and_cells_are_few(spark):
    """All cells visited, the result is the exact one, ties and zero vectors included; grouped vectors need few cells."""
    import numpy as np

    rng = np.random.default_rng(1)
    middles = rng.standard_normal((25, 16)) * 4
    rows = [(i, (middles[i % 25] + rng.standard_normal(16)).tolist()) for i in range(2000)] + [(2000, [0.0] * 16), (2001, None)]
    rows += [(3000 + i, rows[i][1]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = v.filter("vec_id % 37 = 0").withColumnRenamed("vec_id", "query_id")
    want = retrieval.knn_exact(q, v.filter("embedding IS NOT NULL"), 7)
    index = ann.build_index(v, 7)
    pairs = ann.candidates(q, index, 7, len(index.centres))
    got = ann.rescore(pairs, q, v, 7)
    key = lambda df: sorted((r["query_id"], r["vec_id"], round(r["score"], 8), r["rank"]) for r in df.collect())
    assert key(got) == key(want) and pairs.count() < 3 * want.count()
    assert index.probes <= len(index.centres) // 3
    near = evaluation.recall(ann.knn_ann(q, v, 7), want, "query_id", "vec_id").first()["recall"]
    assert near >= 0.95
    assert ann.knn_ann(q, v.filter("false"), 7).count() == 0 and ann.knn_ann(q.filter("false"), v, 7).count() == 0


def two_rounds(spark, tmp_path, df, split, stream, name):
    """The rows of a stream over two folders of input, stopped and started again from its checkpoint in between."""
    from veridoc.streaming import processors

    processors.use_rocksdb(spark)
    got = []
    for k, part in enumerate((df.filter(split), df.filter(~split))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
        query = stream(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start(str(tmp_path / f"{name}-out"))
        run(query)
        got.append(spark.read.parquet(str(tmp_path / f"{name}-out")).count())
    assert 0 < got[0] < got[1]
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_budget_stream_restarts_and_equals_the_batch(spark, tmp_path):
    from veridoc.operators import usage
    from veridoc.streaming import processors

    rows = [(i, 1704100000 + i * 3000, i % 5 != 4, 0.25 if i % 3 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, t long, api_call boolean, cost double").withColumn("ts", F.timestamp_seconds("t"))
    got = two_rounds(spark, tmp_path, df, F.col("event_id") < 55, lambda s: processors.budget_stream(s, 12, 2.0, "3 days"), "budget")
    want = {r["event_id"]: tuple(r) for r in usage.budget_gate(df, 12, 2.0).collect()}
    assert {r["event_id"]: tuple(r) for r in got.collect()} == want and any(r[3] for r in want.values())


def test_cache_stream_counts_hits_over_a_restart(spark, tmp_path):
    from veridoc.streaming import processors

    rows = [(i, 1704100000 + i * 500, f"k{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, t long, key string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["event_id"]: r for r in two_rounds(spark, tmp_path, df, F.col("event_id") < 31, lambda s: processors.cache_stream(s, 4000, late="3 days"), "cache").collect()}
    stored, hits, last = {}, {}, {}
    for i, t, k in rows:
        hit = k in stored and t < stored[k] + 4000
        if hit:
            hits[k], last[k] = hits.get(k, 0) + 1, t
        else:
            stored[k] = t
        assert (got[i]["hit"], got[i]["hits"]) == (hit, hits.get(k, 0))
        assert (got[i]["last_hit"] and got[i]["last_hit"].timestamp()) == last.get(k)


def test_searches_by_scan_are_exact(spark, monkeypatch):
    """Both scans against a sort of all pairs: many ties, several blocks of questions and tiles, fewer units than asked for, rows without a value."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "TILE", 60)
    units = [(int(i), [f"t{t}" for t in rng.integers(0, 9, rng.integers(0, 7))], rng.integers(-2, 3, 3).astype(float).tolist()) for i in rng.permutation(300)]
    units += [(300, None, None), (301, [], [0.0, 0.0, 0.0])]
    asked = [(q, [f"t{t}" for t in rng.choice(12, q % 5, replace=False)], rng.integers(-2, 3, 3).astype(float).tolist()) for q in range(11)] + [(11, None, None)]
    u = spark.createDataFrame(units, "unit_id long, stems array<string>, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "question_id long, terms array<string>, embedding array<double>")
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    dense = lambda n, t, e, m, s, v: round(float(unit(e) @ unit(v)), 9) if e is not None and v is not None else None
    hits = lambda n, t, e, m, s, v: sum(x in (t or []) for x in s or []) or None
    for k in (5, 400):
        for found, score in ((retrieval.dense_search(q, u, k), dense), (retrieval.sparse_scan(q, u, k), hits)):
            want = set()
            for a in asked:
                order = sorted((-s + 0.0, b[0]) for b in units if (s := score(*a, *b)) is not None)
                want |= {(a[0], b, i + 1) for i, (_, b) in enumerate(order[:k])}
            assert {(r["question_id"], r["unit_id"], r["rank"]) for r in found.collect()} == want
    index = retrieval.postings(u)
    both = [f.select("question_id", "unit_id", "hits", "rank", "sparse_score") for f in (retrieval.sparse_scan(q, u, 5), retrieval.sparse_search(q, index, 5))]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
    assert retrieval.sparse_scan(q.limit(0), u).isEmpty() and retrieval.dense_search(q.limit(0), u).isEmpty()
    assert retrieval.sparse_scan(q, u.limit(0)).isEmpty() and retrieval.dense_search(q, u.limit(0)).isEmpty()


def test_units_are_not_dealt_by_source(spark):
    """A few sources hold all units: a shuffle by source would leave them to a few tasks."""
    units = spark.range(50).selectExpr("id AS unit_id", "concat('s', id % 2) AS source_slug", "'active' AS status")
    sources = spark.range(2).selectExpr("concat('s', id) AS slug", "id AS priority", "'approved' AS status").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.approved(units, sources)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_index_of_the_terms_asked_for(spark):
    """Only the terms asked for are counted and indexed, with the same counts, and the search finds the same units."""
    rng = np.random.default_rng(5)
    units = spark.createDataFrame([(i, " ".join(f"word{t}x" for t in rng.integers(0, 30, 12))) for i in range(400)], "unit_id long, content string")
    asked = spark.createDataFrame([(q, f"word{t}x") for q in range(6) for t in rng.choice(12, 4, replace=False)], "question_id long, term string")
    terms = {r["term"] for r in asked.collect()}
    stemmed = units.select("unit_id", text.stems("content").alias("stems"))
    whole = {r["term"]: r["df"] for r in retrieval.idf(retrieval.postings(units), 400).collect() if r["term"] in terms}
    assert {r["term"]: r["df"] for r in retrieval.document_frequency(stemmed, asked).collect()} == whole
    index, full = sparse.blocked_index(units, only=asked), sparse.blocked_index(units)
    assert {r["term"] for r in index.select("term").distinct().collect()} == terms
    for present in (False, True):
        weighted = sparse.weighted_terms(asked, sparse.term_counts(index), 400)
        a, b = (sparse.search(weighted, x, 7, present=present).select("question_id", "unit_id", "score", "rank") for x in (index, full))
        hits = asked.join(retrieval.postings(units), "term").join(weighted, ["question_id", "term"])
        score = F.sum((F.lit(1) if present else F.col("hits")) * F.col("weight")).alias("score")
        best = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "unit_id")
        want = hits.groupBy("question_id", "unit_id").agg(score).withColumn("rank", F.row_number().over(best)).filter("rank <= 7")
        rows = [sorted(map(tuple, x.collect())) for x in (a, b, want)]
        assert rows[0] == rows[1] == rows[2]


def test_nearest_in_small_tiles(spark, monkeypatch):
    """Neither search sorts or holds more than a tile of scores; ties go to smaller ids."""
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(-1, 2, 4).astype(float).tolist()) for i in rng.permutation(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for module in (retrieval, ann):
        monkeypatch.setattr(module, "TILE", 50)
    monkeypatch.setattr(ann, "ROUTED", 16)
    x = dict(rows)
    unit = lambda e: np.array(e) / max(np.linalg.norm(e), 1e-300)
    near = lambda a: sorted((-round(float(unit(x[a]) @ unit(e)), 9) + 0.0, i) for i, e in rows)[:9]
    want = {(a, i, k + 1) for a in range(0, 120, 5) for k, (_, i) in enumerate(near(a))}
    for found in (retrieval.knn_exact(q, v, 9), ann.knn_ann(q, v, 9, probes=ann.CELLS)):
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == want
