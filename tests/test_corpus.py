"""Sentences to quote, page parsing, registries, attribution reports and late data against small fixtures and plain Python."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.functions.fixed_values import FOOTNOTE
from veridoc.operators import attribution as A
from veridoc.operators.chunking import split_long
from veridoc.sources import snapshots
from veridoc.streaming import logs, stateful


def test_map_leads_back_to_the_source(spark, sf):
    texts = ["  Él — «وَاحِد» آخَر ٣!", "", None, "a\n\tb", "!!", "قال ﷺ خيرًا", "x" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", "t", text.normalize("t", compose=True).alias("n"), text.normalize_with_map("t").alias("m")).collect()
    for r in rows:
        assert r["m"]["norm"] == r["n"] and len(r["m"]["origin"]) == len(r["n"])
        for c, at in zip(r["n"], r["m"]["origin"], strict=True):
            assert not c.isalnum() or not c.isascii() or r["t"][at].lower() == c or r["t"][at].isdigit()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.filter(text.normalize_with_map("text")["norm"] != text.normalize("text", compose=True)).isEmpty()


def test_quotable_sentences(spark):
    said = "السؤال: ما حكم السفر في شهر رمضان للصائم؟ الجواب: يجوز للمسافر أن يفطر في سفره ثم يقضي. (رواه البخاري ومسلم في الصحيحين). رواه أحمد في المسند وغيره من الأئمة. وهذا قول جمهور أهل العلم قديما وحديثا."
    df = spark.createDataFrame([(1, said), (2, ""), (3, None), (4, "الجواب: قصير جدا لا يكفي.")], "i int, t string")
    got = {r["i"]: r["q"] for r in df.select("i", text.quotable_sentences("t").alias("q")).collect()}
    assert got == {1: ["يجوز للمسافر أن يفطر في سفره ثم يقضي.", "وهذا قول جمهور أهل العلم قديما وحديثا."], 2: [], 3: [], 4: []}


def test_long_sentences_are_cut_as_plain_python_cuts(spark, sf):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["x" * 700, "a " * 400, "one, " * 120, ", " * 300, "", " lead" * 90, "y" * 260, "y" * 261, "w" * 129 + "," + "z" * 400]
    flat = [" ".join(t.split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(flat)), "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", text.cut_long("t").alias("p")).collect()}
    for i, t in enumerate(flat):
        assert got[i] == [p for p in split_long(t, 260) if p], t[:80]


def test_concise_keeps_the_piece_with_most_terms(spark):
    long = "The first part speaks of rain and wind over the hills, " * 5 + "the lantern keeper walked slowly home [3] and the river carried many boats to the harbour, " * 2
    cases = [(1, long, ["lantern", "keeper"]), (2, long, []), (3, "short one stays as it is here", ["x"]), (4, "a [1] b [2] c", ["x"]), (5, None, ["x"])]
    df = spark.createDataFrame(cases, "i int, t string, terms array<string>")
    got = {r["i"]: r["p"] for r in df.select("i", text.concise("t", F.col("terms")).alias("p")).collect()}
    for i, t, terms in cases[:2]:
        pieces = [p.rstrip(" ،,؛;") for part in re.split(FOOTNOTE, t) for p in split_long(part.strip(), 260)]
        pieces = [p for p in pieces if len(p) >= 25]
        assert got[i] == max(pieces, key=lambda p: sum(x in p for x in terms))
    assert got[3] == cases[2][1] and got[4] == cases[3][1] and got[5] is None


PAGE = """<html><ul><li itemprop="crumb">Home</li><li itemprop="crumb">Books &amp; more</li><li itemprop="crumb">One</li></ul><p>menu
<article class="x"><h1>A  <b>title</b></h1><h2 class="big question">Why<br>so?</h2><audio src="a.mp3"></audio><div>First&nbsp;&nbsp;part<br/>second <i>part</i>
<p>third<script>no()</script></p>tail</div></article><p>footer</p>"""


def test_pages(spark):
    pages = [(1, PAGE), (2, "<p>no article</p>"), (3, "<article><h1>t</h1></article>"), (4, None), (5, "<article><p>no title</p></article>"), (6, "<article><h1>t</h1>bare &lt;text")]
    got = {r["page_id"]: r.asDict() for r in snapshots.extract_pages(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert sorted(got) == [1, 6] and got[6]["answer"] == ["bare <text"]
    one = got[1]
    assert (one["title"], one["question"], one["collection"], one["audio_url"]) == ("A title", "Why\n\nso?", "Books & more", "a.mp3")
    assert one["answer"] == ["First part", "second part", "third", "tail"]
    assert snapshots.extract_pages(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_snapshots_and_registries(spark, tmp_path):
    for name, key in (("b", "2"), ("a", "1")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"source_slug": "s", "external_id": key, "answer": "x\ny"}, indent=1))
    (tmp_path / "notes.txt").write_text("no snapshot")
    got = snapshots.scan_snapshots(spark, str(tmp_path)).select("file", "external_id", "answer", "title").collect()
    assert [tuple(r) for r in got] == [("a.json", "1", "x\ny", None), ("b.json", "2", "x\ny", None)]
    (tmp_path / "r.yaml").write_text("sources:\n  - {slug: s1, domains: [a.org], status: approved, priority: 1, extra: 5}\n  - {slug: s2, status: blocked}\n")
    rows = snapshots.load_registry(spark, str(tmp_path / "r.yaml")).select("slug", "domains", "status", "priority").collect()
    assert [tuple(r) for r in rows] == [("s1", ["a.org"], "approved", 1), ("s2", [], "blocked", None)]
    (tmp_path / "b.yaml").write_text("bodies:\n  - {id: b1, topics: [x, y], verified_at: 2026-10-03, active: false}\n")
    [body] = snapshots.load_bodies(spark, str(tmp_path / "b.yaml")).collect()
    assert (body["id"], body["topics"], body["verified_at"], body["active"]) == ("b1", ["x", "y"], "2026-10-03", False)


def test_attribution_report(spark):
    asked = [(1, "lamps stay lit until the morning bell", "s1"), (2, "too short", None), (3, "nothing like this anywhere at all", None)]
    messages = spark.createDataFrame(asked, "message_id int, claim string, named string")
    found = [(1, "s1", "Lamps, stay lit until the Morning bell rings twice.", 1.0, 1), (2, "s1", "too short", 1.0, 1), (3, "s1", "Other words.", 0.1, 1)]
    matches = spark.createDataFrame(found, "message_id int, source_slug string, passage string, coverage double, rank int")
    got = {r["message_id"]: (r["verdict"], r["quote"]) for r in A.attribution_report(messages, matches).collect()}
    assert got == {1: ("verbatim", "Lamps, stay lit until the Morning bell"), 2: ("too_short", None), 3: ("not_found", None)}


def test_candidate_documents(spark):
    ranked = [(1, d, r) for r, d in enumerate([5, 5, 6, 7, 8, 9, 10, 11, 12, 13], 1)]
    own = [(1, d, r) for r, d in enumerate([20, 7, 7, 21, 22], 1)]
    kind = "message_id int, doc_id int, rank int"
    got = A.candidate_documents(spark.createDataFrame(ranked, kind), spark.createDataFrame(own, kind)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [20, 7, 21, 5, 6, 8, 9, 10]


def test_late_rows_of_a_stream_as_in_a_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=(i * 37) % 50)) for i in range(60)]
    kind = "event_id int, ts timestamp"
    for b in range(6):
        spark.createDataFrame(rows[b * 10 : b * 10 + 10], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.late_rows_aside(stream, str(tmp_path / "out"), "5 hours", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.option("basePath", str(tmp_path / "out/rows")).parquet(str(tmp_path / "out/rows"))
    want = stateful.split_late(got.select("event_id", "ts", F.col("b").alias("batch")), "5 hours")
    got, flags = got.withColumn("late", F.col("late").cast("boolean")), {r["event_id"]: r["late"] for r in want.collect()}
    assert {r["event_id"]: r["late"] for r in got.collect()} == flags and len(flags) == 60 and 0 < sum(flags.values()) < 60


def test_redacting_a_stream_as_a_batch(spark, sf, tmp_path):
    told = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    told.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(told.schema).parquet(str(tmp_path / "in"))
    q = logs.redact_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    batch = logs.redact_stream(told)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.count() and got.exceptAll(batch).isEmpty()


def test_quotes_are_found_at_any_length(spark):
    words = " ".join(f"Word{i}, (said) نعَم" for i in range(400))
    needles = ["word3 said نعم", " ".join(f"word{i} said نعم" for i in range(7, 300)), "word3 unsaid", words, "", None]
    df = spark.createDataFrame([(i, words, n) for i, n in enumerate(needles)], "i int, h string, n string")
    got = {r["i"]: r["f"] for r in df.select("i", text.locate_verbatim("h", F.col("n")).alias("f")).collect()}
    long = " ".join(f"Word{i}, (said) نعَم" for i in range(7, 300))
    assert got == {0: "Word3, (said) نعَم", 1: long, 2: None, 3: words, 4: None, 5: None}


def test_quotes_see_through_ligatures_and_composition_at_any_length(spark):
    """A needle of 10, 500 or 5,000 characters is found through spelled-out ligatures, presentation forms and loose marks alike."""
    said = "قال النبي ﷺ إنما الأعمال بالنيات ﻻ غير e\u0301te\u0301 "
    hay = said * 120
    spelled = "قال النبي صلى الله عليه وسلم انما الاعمال بالنيات لا غير été "
    needles = [spelled[:10], (spelled * 12)[:500].strip(), (spelled * 100)[:5000].strip(), spelled.replace("غير", "خير")]
    df = spark.createDataFrame([(i, hay, n) for i, n in enumerate(needles)], "i int, h string, n string")
    got = {r["i"]: r["f"] for r in df.select("i", text.locate_verbatim("h", "n").alias("f")).collect()}
    assert got[3] is None and all(got[i] and hay.startswith(got[i]) for i in range(3))
    assert [len(needles[i]) >= n for i, n in enumerate((10, 495, 4990))] == [True] * 3 and "ﷺ" in got[1] and "ﻻ" in got[2]


@pytest.mark.parametrize("pool", [(0x600, 0x700), (0xFB50, 0xFC50), (0x1100, 0x1200), (0xFF00, 0xFFEF), (32, 0x370), (0x900, 0xD80)])
def test_origins_compose_as_whole_texts(pool):
    import random
    import unicodedata

    from veridoc.functions import fixed_values, origins

    rng = random.Random(pool[0])
    for _ in range(900):
        t = "".join(chr(rng.randrange(*pool)) if rng.random() < 0.8 else rng.choice(" ﷺ\u0301Σa") for _ in range(rng.randrange(30)))
        whole = t
        for a, b in fixed_values.LIGATURES.items():
            whole = whole.replace(a, b)
        whole = origins.MARKS.sub("", unicodedata.normalize("NFKC", whole)).translate(origins.FOLD).lower()
        want = " ".join("".join(c if c == "_" or c.isalnum() else " " for c in whole).split())
        norm, start, stop = origins.with_origins(t)
        assert norm == want and list(start) == sorted(start) and len(norm) == len(start) == len(stop) and all(a < b for a, b in zip(start, stop, strict=True))


def test_a_text_is_normalised_once_for_all_its_quotes(monkeypatch):
    """A plain text, accents too, is read without a step for each character; a text with longer runs still finds its wording."""
    from veridoc.functions import origins

    read, whole = [], origins.Normal
    monkeypatch.setattr(origins, "Normal", lambda t: (read.append(t), whole(t))[1])
    hay = "Le café, «déjà vu», fermé. " * 50
    needles = ["cafe", "café déjà", "vu fermé le", "", None]
    assert origins.cut_each(hay, needles) == ["café, «déjà", "vu», fermé. Le"] and read.count(hay) == 1
    assert origins.letters_of(hay) == hay.lower() and origins.letters_of("café") is None
    assert origins.cut_each("un café ½ noir", ["café 1"]) == ["café ½"]
    assert origins.cut_each(None, ["a"]) == [] and origins.cut_each("a", None) == []


def test_quotes_are_normalised_as_their_source_is(spark):
    """Loose marks and signs that compose to letters do not break a quotation."""
    from veridoc.operators import verification

    df = spark.createDataFrame([("Il a été™ là, hier … enfin.", "Il a été™ là … enfin"), ("a", None)], "answer string, quote string")
    assert [r[0] for r in df.select(verification.source_quote(F.col("answer"), F.col("quote"))).collect()] == ["Il a été™ là … enfin", None]


def test_chunks_leave_a_task_a_few_documents_at_a_time(spark, monkeypatch):
    """Chunks are made of SLICE documents at a time, and all come out."""
    from veridoc.operators import chunking

    monkeypatch.setattr(chunking, "SLICE", 3)
    texts = [None, "", "kurz"] + [f"Satz {i}, noch einer. " * 150 for i in range(8)]
    docs = spark.createDataFrame([(i, t, "Frage?" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, body string, q string").coalesce(1)
    want = {(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(chunking.chunk_text(t, "Frage?" if i % 2 else None))}
    assert {tuple(r) for r in chunking.chunks(docs, question_col="q").collect()} == want
    assert chunking.chunks(docs.limit(0)).isEmpty() and "MapInArrow" in chunking.chunks(docs)._jdf.queryExecution().executedPlan().toString()
