"""Answer assembly and record shaping."""

from pyspark.sql import functions as F

from veridoc.operators import answering as A
from veridoc.operators import ingest


def test_summary_and_details(spark):
    text = "Prices rose in the spring season again. Nothing else happened that week at all. Spring prices fell in many towns later."
    ev = spark.createDataFrame([("q", 1, 7, text, ["pric", "spr"])], "question_id string, rank int, doc_id int, content string, terms array<string>")
    s = A.score_sentences(ev, similarity=F.lit(0.5))
    top = A.pick_summary(s)
    assert top.collect()[0]["idx"] == 0
    assert [r["idx"] for r in A.pick_details(s, top).collect()] == [2]


def test_priority_and_also_answered(spark):
    rows = [("q", i, p, u) for i, p, u in ((1, 2, "a"), (2, 1, "b"), (3, None, "c"), (4, 1, "b"))]
    ev = spark.createDataFrame(rows, "question_id string, rank int, priority int, url string")
    assert sorted(r["rank"] for r in A.priority_window(ev).collect()) == [2, 4] == sorted(r["rank"] for r in A.top_priority(ev).collect())
    cited = ev.filter("rank = 1")
    assert sorted(r["rank"] for r in A.also_answered(ev, cited).collect()) == [2, 3]


def test_claims_prompts_and_questions(spark):
    rows = [("q", 0, "summary", "a"), ("q", 1, "summary", "b"), ("q", 2, "detail", " "), ("q", 3, "detail", "c")]
    got = A.shape_claims(spark.createDataFrame(rows, "question_id string, ordinal int, role string, text string"), 1).collect()
    assert {(r["ordinal"], r["role"]) for r in got} == {(0, "summary"), (1, "detail")}
    q = spark.createDataFrame([("q", "why <b>?"), ("r", "x")], "question_id string, question string")
    ev = spark.createDataFrame([("q", 2, "E2", "t2", "c2"), ("q", 1, "E1", "t", "c<")], "question_id string, rank int, ref string, title string, content string")
    prompts = {r["question_id"]: r["prompt"] for r in A.build_prompts(q, ev).collect()}
    assert prompts["q"].startswith("Question: why ‹b›?\n<evidence ref=E1>\nt\nc‹\n</evidence>\n<evidence ref=E2>") and prompts["r"] == "Question: x\n"
    assert [r["problem"] for r in A.validate_questions(q).orderBy("question_id").collect()] == [None, "too short"]
    t = spark.createDataFrame([(1, "safety_gate", "ok"), (1, "verification", "failed"), (1, "intent", "ok"), (1, "other", "failed")], "question_id int, stage string, status string")
    assert [r["status"] for r in A.group_stages(t).orderBy("place").collect()] == ["empty", "done", "empty", "empty", "empty", "blocked", "done"]
    r = spark.createDataFrame([("a", None), (None, " "), (None, "x" * 301), ("o" * 65, "x")], "option_id string, text string")
    assert [x["problem"] for x in A.validate_replies(r).collect()] == [None, "nothing said", "text too long", "option too long"]
    where = spark.createDataFrame([("why", "ar", None), ("why", "xx", "text"), ("why", None, "fax")], "question string, locale string, channel string")
    assert [x["problem"] for x in A.validate_questions(where).collect()] == [None, "unknown locale", "unknown channel"]
    support = A.lexical_support(F.lit("Yes, apples and bridges quickly"), F.lit("Apples here"), F.lit("quickly?"))
    assert spark.range(1).select(support.alias("s")).collect()[0]["s"] == 0.5


def test_records(spark, tmp_path):
    one = lambda c: spark.range(1).select(c.alias("c")).collect()[0]["c"]
    arr = lambda *v: F.array(*(F.lit(x) for x in v))
    assert one(ingest.strip_label(arr("Q:", " ", "Q: why", "more"), "Q")) == ["why", "more"]
    assert one(ingest.strip_label(arr("Q:"), "Q")) == []
    got = one(ingest.split_question_answer(arr("intro", "Q: why", "so", "A: because"), "Q", "A"))
    assert (got["question"], got["answer"]) == (["why", "so"], ["because"])
    assert one(ingest.split_question_answer(arr("A: x", "Q: y"), "Q", "A")) is None
    assert one(ingest.compose_record(F.lit(" a  b "), F.lit(""), F.lit("c"))) == "a b\n\nc"
    sites = spark.createDataFrame([("s", 1, r"s\.org/(\d+)"), ("t", 2, r"org/(\d+)")], "slug string, ord int, pattern string")
    urls = spark.createDataFrame([(1, 0, "http://s.org/5"), (1, 1, "http://t.org/6"), (1, 2, "http://s.org/5?x"), (1, 3, "http://z.com")], "q int, place int, url string")
    assert {(r["slug"], r["page"]) for r in ingest.route_urls(urls, sites, "q", 2).collect()} == {("s", "5"), ("t", "6")}
    ingest.write_results({"q": urls}, str(tmp_path / "out"), "b1")
    assert spark.read.parquet(str(tmp_path / "out/q")).count() == 4


def test_lexical_support(spark):
    """Affixes of person, noise, yes and no, the question's own words, other languages and missing evidence."""
    rows = [
        ("yes, travelling shortens prayers", "Prayers are shortened by those who travel.", "what about travel?", 0.667),
        ("ships sail slowly", "The ship sails.", "", 0.667), ("تقصر الصلاة في بلدك", "المسافرون يقصروا الصلاة في بلده", "", 1.0),
        ("the ruling is permissible", "nothing here", "", 1.0), ("ships sail", "السفن تبحر في البحر", "", 1.0), ("ships sail", "", "", 1.0), ("ships sail", None, None, 1.0),
        ("dogs bark", "cats sleep", None, 0.0), (None, "cats", "x", 1.0),
    ]
    df = spark.createDataFrame(rows, "claim string, evidence string, question string, want double")
    got = df.select("claim", "want", A.lexical_support(F.col("claim"), F.col("evidence"), F.col("question")).alias("got")).collect()
    assert [(r["claim"], r["got"]) for r in got] == [(r["claim"], r["want"]) for r in got]
