"""Registered queries of dialogue, answer assembly and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.operators import assembly as a
from veridoc.operators import calibration as c
from veridoc.operators import dialogue as dlg
from veridoc.operators import governance as g
from veridoc.operators import ingest, retrieval
from veridoc.plans.queries import _COST, _RANKS, _TERMS, _TOP, DISTINCT, STEMS, _first_ranks, _nearest, _priced, _questions, _ranked, query, table
from veridoc.sources.views import view

# --- evidence of the vector queries -------------------------------------------------------------------------------------

_EV = f"""SELECT query_id AS question_id, vec_id AS unit_id, label AS doc_id, query_label, rank, concat('E', rank) AS ref, round(score, 6) AS dense,
    nullif(label % 4, 0) AS priority, (vec_id % 5) / 4.0 AS coverage, 1 + vec_id % 3 AS n_terms FROM ({_TOP}) t WHERE rank <= 8"""


def _evidence(spark, d):
    v = view(spark, d, "v_vectors").select("vec_id", "label")
    found = _nearest(spark, d, 8).select("query_id", "vec_id", "rank", "score").join(v, "vec_id")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(asked, "query_id").select(
        F.col("query_id").alias("question_id"), F.col("vec_id").alias("unit_id"), F.col("label").alias("doc_id"), "query_label", "rank",
        F.concat(F.lit("E"), "rank").alias("ref"), F.round("score", 6).alias("dense"), F.nullif(F.col("label") % 4, F.lit(0)).alias("priority"),
        (F.col("vec_id") % 5 / 4.0).alias("coverage"), (1 + F.col("vec_id") % 3).alias("n_terms"),
    )


@query(f"SELECT question_id, unit_id, dense >= 0.83 AND (n_terms < 2 OR coverage >= 1) AS eligible FROM ({_EV}) e")
def G2_eligible(spark, d):
    return _evidence(spark, d).select("question_id", "unit_id", a.eligible(F.col("dense"), F.col("coverage"), F.col("n_terms")).alias("eligible"))


@query(f"SELECT question_id, string_agg(ref, ',' ORDER BY rank) AS refs FROM ({_EV}) e WHERE dense >= 0.2 AND (n_terms < 2 OR coverage >= 0.75) GROUP BY 1")
def G7_answering_refs(spark, d):
    return a.answering_refs(_evidence(spark, d), least=0.2).select("question_id", F.array_join("refs", ",").alias("refs"))


@query()
def G8_generate_extractive(spark, d):
    evidence = retrieval.relevant_evidence(_ranked(spark, d)).withColumn("dense", F.col("dense_score"))
    sources = view(spark, d, "v_sources").select(F.col("slug").alias("source_slug"), "priority")
    asked = view(spark, d, "v_questions").select("question_id", F.lit("ar").alias("language"))
    out = a.generate_extractive(asked, evidence.join(sources, "source_slug", "left"), least=0.3)
    return out.select("question_id", "insufficient", "note", F.to_json("claims").alias("claims"), F.array_join("refs", ",").alias("refs"))


@query(f"""WITH e AS ({_EV}), m AS (SELECT *, coalesce(priority, 99) = min(coalesce(priority, 99)) OVER (PARTITION BY question_id) AS top FROM e)
    SELECT question_id, NOT bool_and(top) AND (question_id % 10 = 0 OR (coalesce(bool_or(top) FILTER (doc_id % 2 = 0), false) AND coalesce(bool_or(NOT top) FILTER (rank BETWEEN 2 AND 4), false))) AS rerun
    FROM m GROUP BY 1""")
def G12_needs_priority_rerun(spark, d):
    e = _evidence(spark, d)
    claims = e.filter("rank BETWEEN 2 AND 4").select("question_id", F.col("rank").alias("ordinal"), "ref")
    conflicts = e.select("question_id", (F.col("question_id") % 10 == 0).alias("conflict")).distinct()
    return a.needs_priority_rerun(e, e.filter("doc_id % 2 = 0").select("question_id", "ref"), claims, conflicts)


@query(f"SELECT question_id, string_agg(ref, ',' ORDER BY rank <> 4, rank) AS refs FROM ({_EV}) e WHERE unit_id % 2 = 0 GROUP BY 1")
def G14_order_cited(spark, d):
    e = _evidence(spark, d)
    out = a.order_cited(e, e.filter("unit_id % 2 = 0"), e.filter("rank = 4"))
    return out.select("question_id", F.array_join("refs", ",").alias("refs"))


@query(f"SELECT question_id, coalesce(string_agg(ref, ' ' ORDER BY rank) FILTER (unit_id % 9 = 0), string_agg(ref, ' ' ORDER BY rank)) AS evidence_text FROM ({_EV}) e GROUP BY 1")
def X4_evidence_text(spark, d):
    e = _evidence(spark, d).withColumn("grounded", F.col("unit_id") % 9 == 0)
    return a.evidence_text(e, ["question_id"], "ref")


@query("""SELECT question_id, nullif(concat_ws('; ', CASE WHEN question_id % 2 = 1 THEN 'cites evidence that was not provided' END, CASE WHEN turn % 4 = 0 THEN 'quote not found in the cited evidence' END,
    CASE WHEN length(question) % 100 < 55 THEN concat('claim terms not supported by evidence (lexical ', printf('%.2f', (length(question) % 100) / 100.0), ')') END, CASE WHEN turn % 3 = 2 THEN 'entailment=contradicted' END), '') AS note
    FROM v_question_log""")
def X7_verification_notes(spark, d):
    q = view(spark, d, "v_question_log").withColumn("lexical", F.length("question") % 100 / 100.0)
    label = F.when(F.col("turn") % 3 == 2, "contradicted").otherwise("entailed")
    note = a.verification_notes(F.col("question_id") % 2 == 0, F.col("turn") % 4 != 0, F.lit(True), F.col("lexical"), 0.55, label)
    return q.select("question_id", note.alias("note"))


@query("""SELECT u.conv_id AS question_id, CAST(u.turn AS BIGINT) AS ordinal, replace(replace(n.text, '<', '‹'), '>', '›') AS premise, replace(replace(u.text, '<', '‹'), '>', '›') AS hypothesis
    FROM conversations u JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1 WHERE u.role = 'user' AND n.role = 'assistant' AND u.turn % 4 = 0""")
def X12_judge_pairs(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").cast("long").alias("ordinal"), "role", "text")
    claims = t.filter("role = 'user'").select("question_id", "ordinal", "text", F.lit("not_checked").alias("entailment"), (F.col("ordinal") % 4 == 0).alias("valid"), F.lit(True).alias("grounded"))
    cited = t.filter("role = 'assistant'").select("question_id", (F.col("ordinal") - 1).alias("ordinal"), F.lit(1).alias("rank"), F.col("text").alias("content"))
    return a.judge_pairs(claims, cited)


@query("""SELECT question_id, CASE WHEN outcome = 'answer' OR conv_id % 2 = 1 THEN 'extractive' ELSE 'external' END AS mode, CASE WHEN outcome = 'answer' OR conv_id % 2 = 1 THEN outcome ELSE reason END AS decision FROM v_answers""")
def O3_extractive_first(spark, d):
    v = view(spark, d, "v_answers")
    mine = v.select("question_id", F.col("outcome").alias("decision"), F.lit("x").alias("text"))
    other = v.filter("conv_id % 2 = 0").select("question_id", F.col("reason").alias("decision"), F.lit("y").alias("text"))
    return a.extractive_first(mine, other).select("question_id", "mode", "decision")


@query(f"""WITH e AS ({_EV}), k AS (SELECT *, question_id % 20 = 0 AND unit_id % 3 <> 0 AND rank <= 4 AS kept FROM e), a AS (SELECT * FROM k WHERE unit_id % 2 = 0
      AND NOT EXISTS (SELECT 1 FROM k x WHERE x.question_id = k.question_id AND x.doc_id = k.doc_id AND x.kept)
    QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank) = 1)
    SELECT question_id, CASE WHEN o = 'answer' THEN any_value(ref) FILTER (kept AND rank = 1) END AS summary, CASE WHEN o = 'answer' THEN coalesce(string_agg(ref, ',' ORDER BY rank) FILTER (kept AND rank > 1), '') ELSE '' END AS details,
      CASE WHEN o <> 'clarification' THEN string_agg(concat(ref, ':', unit_id), ',' ORDER BY rank) END AS evidence,
      CASE WHEN o = 'answer' THEN coalesce((SELECT string_agg(a.ref, ',' ORDER BY a.rank) FROM a WHERE a.question_id = k.question_id), '') ELSE '' END AS also_answered
    FROM (SELECT *, CASE question_id // 20 % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'abstention' ELSE 'clarification' END AS o FROM k) k GROUP BY question_id, o""")
def O4_assemble_answer(spark, d):
    e = _evidence(spark, d)
    n = F.col("question_id").cast("long")
    outcome = F.when(F.floor(n / 20) % 3 == 0, "answer").when(F.floor(n / 20) % 3 == 1, "abstention").otherwise("clarification")
    asked = e.select("question_id").distinct().select("question_id", outcome.alias("outcome"), F.lit(None).cast("string").alias("reason"), F.lit("extractive").alias("mode"))
    kept = (F.col("unit_id") % 3 != 0) & (F.col("rank") <= 4)
    claims = e.filter("rank <= 4").select("question_id", F.col("rank").alias("ordinal"), F.when(F.col("rank") == 1, "summary").otherwise("detail").alias("role"), F.col("ref").alias("text"), "ref", kept.alias("kept"))
    held = e.withColumn("url", F.col("doc_id").cast("string"))
    out = a.assemble_answer(asked, claims, held, e.filter("unit_id % 2 = 0").select("question_id", "ref"))
    shown = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["ref"], x["unit_id"].cast("string"))), ",")
    return out.select("question_id", "summary", F.array_join("details", ",").alias("details"), shown.alias("evidence"), F.array_join("also_answered", ",").alias("also_answered"))


@query(f"SELECT question_id, unit_id, CASE WHEN rank = 1 THEN ref END AS question, round(dense, 4) AS dense, round(coverage, 3) AS coverage FROM ({_EV}) e")
def O5_evidence_payload(spark, d):
    e = _evidence(spark, d).withColumn("ordinal", F.col("rank") - 1).withColumn("question", F.col("ref"))
    p = e.select("question_id", a.evidence_payload(e).alias("p"))
    return p.select("question_id", "p.unit_id", "p.question", "p.scores.dense", "p.scores.coverage")


_FRESH = "SELECT conv_id * 1000 + turn - 1 AS question_id, length(text) AS doc_id FROM conversations WHERE role = 'assistant' AND turn % 4 = 1"


@query(f"SELECT v.question_id, CAST(count(DISTINCT f.doc_id) AS BIGINT) AS new_documents FROM v_answers v JOIN ({_FRESH}) f ON f.question_id = v.question_id WHERE v.outcome = 'abstention' AND v.reason <> 'unresolved_conflict' GROUP BY 1")
def O6_retry_candidates(spark, d):
    fresh = table(spark, d, "conversations").filter("role = 'assistant' AND turn % 4 = 1").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("question_id"), F.length("text").alias("doc_id"))
    return a.retry_candidates(view(spark, d, "v_answers"), fresh).select("question_id", "new_documents")


@query("SELECT question_id, CASE WHEN outcome = 'abstention' THEN 'answer' ELSE outcome END AS outcome, CAST(CASE WHEN outcome = 'abstention' THEN 2 * turn + 5 ELSE turn END AS BIGINT) AS input_tokens FROM v_answers")
def O6_merge_retried(spark, d):
    v = view(spark, d, "v_answers").select("question_id", "outcome", F.col("turn").cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    again = v.filter("outcome = 'abstention'").withColumn("outcome", F.lit("answer")).withColumn("input_tokens", F.col("input_tokens") + 5)
    return a.merge_retried(v, again).select("question_id", "outcome", "input_tokens")


@query(f"""WITH e AS (SELECT question_id, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY rank) AS best FROM ({_EV}) e GROUP BY 1)
    SELECT question_id, 'input' AS stage, 'ok' AS output FROM e UNION ALL SELECT question_id, 'retrieval', best FROM e UNION ALL SELECT question_id, 'gate', 'ok' FROM e""")
def O7_trace_rows(spark, d):
    e = _evidence(spark, d)
    stages = e.select("question_id").distinct().select("question_id", F.posexplode(F.array(*map(F.lit, ("input", "retrieval", "gate")))).alias("ord", "stage"), F.lit("done").alias("status"), F.lit("ok").alias("output"))
    return a.trace_rows(stages, e).select("question_id", "stage", "output")


@query("SELECT question_id, outcome FROM v_answers WHERE question_id = 0")
def O8_lookup_answer(spark, d):
    return a.lookup_answer(view(spark, d, "v_answers"), 0).select("question_id", "outcome")


@query("""SELECT question_id, CASE outcome WHEN 'answer' THEN concat('S', turn, ' a b') WHEN 'clarification' THEN CASE WHEN turn % 4 = 0 THEN concat('Q', turn) ELSE concat('Q', turn, ' one or two?') END ELSE reason END AS spoken FROM v_answers""")
def O9_spoken_text(spark, d):
    options = F.when(F.col("turn") % 4 != 0, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))
    turn = F.col("turn").cast("string")
    spoken = a.spoken_text(F.col("outcome"), F.lit("en"), F.concat(F.lit("S"), turn), F.array(F.lit("a"), F.lit("b")), F.concat(F.lit("Q"), turn), options, F.col("reason"))
    return view(spark, d, "v_answers").select("question_id", spoken.alias("spoken"))


# --- dialogue -----------------------------------------------------------------------------------------------------------

_PHRASES = {"view": "look", "view click": "open", "click": "press", "signup": "bye"}
_MESSAGES = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(event_type, ' ' ORDER BY ts, event_id) AS message FROM events GROUP BY 1, 2"
_KINDS = f"""SELECT user_id, day, message, CASE WHEN NOT list_contains(p, 'purchase') AND len(k) > 0 THEN {DISTINCT.format("k")} END AS kinds FROM (
    SELECT *, list_filter(list_transform(p, lambda x: CASE x WHEN 'view' THEN 'look' WHEN 'view click' THEN 'open' WHEN 'click' THEN 'press' WHEN 'signup' THEN 'bye' END), lambda x: x IS NOT NULL) AS k FROM (
      SELECT *, regexp_extract_all(message, '(view click|signup|click|view|[^ ]+)(?: |$)', 1) AS p FROM ({_MESSAGES}) m) a) b"""


def _messages(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    m = e.select("user_id", "day", F.array_join(F.transform("e", lambda x: x["event_type"]), " ").alias("message"))
    return m.withColumn("kinds", dlg.small_talk("message", _PHRASES, ["error"]))


@query(f"SELECT user_id, day, array_to_string(kinds, ',') AS kinds FROM ({_KINDS}) k")
def C8_small_talk(spark, d):
    return _messages(spark, d).select("user_id", "day", F.array_join("kinds", ",").alias("kinds"))


@query(f"""SELECT user_id, day, concat(array_to_string(list_transform(kinds, lambda k: upper(k)), '. '), CASE kinds[-1] WHEN 'bye' THEN '' WHEN 'press' THEN '. Again?' ELSE '. What?' END) AS reply
    FROM ({_KINDS}) k WHERE kinds IS NOT NULL""")
def C9_courtesy_reply(spark, d):
    reply = dlg.courtesy_reply(F.col("kinds"), {k: k.upper() for k in _PHRASES.values()}, "What?", "Again?", ["press"])
    return _messages(spark, d).filter("kinds IS NOT NULL").select("user_id", "day", reply.alias("reply"))


@query(f"SELECT user_id, day, CASE WHEN kinds IS NOT NULL THEN 'greeting' WHEN contains(message, 'error') THEN 'fiqh_question' ELSE 'unknown' END AS intent FROM ({_KINDS}) k")
def C10_classify_intent(spark, d):
    return _messages(spark, d).select("user_id", "day", dlg.classify_intent(F.col("kinds"), F.contains(F.col("message"), F.lit("error"))).alias("intent"))


_FOUND = "SELECT user_id AS question_id, event_type AS topic, min(event_id) AS ord, CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'ur' END AS language FROM events GROUP BY 1, 2, 4"
_LABELS = f"""SELECT question_id, any_value(language) AS language, list(CASE WHEN language = 'fr' AND topic <> 'click' THEN concat('le ', topic) ELSE concat('the ', topic) END ORDER BY ord) AS labels
    FROM ({_FOUND}) f WHERE topic <> 'signup' GROUP BY 1"""


def _labelled(spark, d):
    e = table(spark, d, "events")
    language = F.when(F.col("user_id") % 3 == 0, "en").when(F.col("user_id") % 3 == 1, "fr").otherwise("ur")
    found = e.groupBy(F.col("user_id").alias("question_id"), F.col("event_type").alias("topic"), language.alias("language")).agg(F.min("event_id").alias("ord"))
    known = e.select(F.col("event_type").alias("topic")).distinct().filter("topic <> 'signup'")
    english = known.select("topic", F.lit("en").alias("language"), F.concat(F.lit("the "), "topic").alias("label"))
    french = known.filter("topic <> 'click'").select("topic", F.lit("fr").alias("language"), F.concat(F.lit("le "), "topic").alias("label"))
    return dlg.topic_labels(found, english.unionByName(french)).join(found.select("question_id", "language").distinct(), "question_id")


@query(f"SELECT question_id, array_to_string(labels, ',') AS labels FROM ({_LABELS}) l")
def C7_topic_labels(spark, d):
    return _labelled(spark, d).select("question_id", F.array_join("labels", ",").alias("labels"))


@query(f"SELECT question_id, concat('About ', CASE WHEN language = 'ur' THEN array_to_string(labels, '، ') ELSE array_to_string(labels, ', ') END, '.') AS notice FROM ({_LABELS}) l")
def C17_sensitive_notice(spark, d):
    notice = dlg.sensitive_notice(F.col("labels"), F.lit("About {topics}."), F.col("language"))
    return _labelled(spark, d).select("question_id", notice.alias("notice"))


@query("SELECT conv_id, turn, coalesce(CASE WHEN conv_id % 2 = 0 THEN nullif(trim(text), '') END, CASE WHEN turn % 3 < 2 THEN concat(CASE WHEN conv_id % 4 = 1 THEN 'en' ELSE 'ar' END, turn % 3) END) AS completion FROM conversations")
def C13_completion_text(spark, d):
    t = table(spark, d, "conversations")
    replies = t.select("conv_id", "turn", F.lit("r").alias("rule_id"), (F.col("turn") % 3).cast("int").alias("option_id"), F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(" ").alias("free_text"),
                       F.when(F.col("conv_id") % 4 == 1, "en").otherwise("ar").alias("language"))
    options = spark.sql("SELECT 'r' AS rule_id, id AS option_id, concat('ar', id) AS append_ar, concat('en', id) AS append_en FROM VALUES (0), (1) t(id)")
    return dlg.completion_text(replies, options).select("conv_id", "turn", "completion")


_CASES = "SELECT vec_id AS question_id, concat('t', label % 7) AS topic FROM v_vectors WHERE is_query"
_BODIES = "SELECT slug AS body_id, concat('t', coalesce(priority, 11) % 5) AS topic FROM v_sources WHERE status = 'approved'"


def _bodies(spark, d):
    v = view(spark, d, "v_vectors").filter("is_query")
    cases = v.select(F.col("vec_id").alias("question_id"), F.array(F.concat(F.lit("t"), (F.col("label") % 7).cast("string"))).alias("topics"))
    topic = F.concat(F.lit("t"), (F.coalesce("priority", F.lit(11)) % 5).cast("string"))
    return cases, view(spark, d, "v_sources").select(F.col("slug").alias("body_id"), (F.col("status") == "approved").alias("active"), F.array(topic).alias("topics"))


@query(f"SELECT question_id, body_id, row_number() OVER (PARTITION BY question_id ORDER BY body_id) AS place FROM ({_CASES}) c JOIN ({_BODIES}) b ON b.topic = c.topic")
def C15_verified_bodies(spark, d):
    return dlg.verified_bodies(*_bodies(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH r AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY min(rank)) AS n FROM ({_EV}) e GROUP BY 1, 2)
    SELECT question_id, coalesce((SELECT string_agg(body_id, ',' ORDER BY body_id) FROM ({_BODIES}) b WHERE b.topic = c.topic), '') AS bodies,
      coalesce((SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n) FROM r WHERE r.question_id = c.question_id AND n <= 3), '') AS readings FROM ({_CASES}) c""")
def C16_build_escalation(spark, d):
    out = dlg.build_escalation(*_bodies(spark, d), _evidence(spark, d).select("question_id", "doc_id", "rank"))
    return out.select("question_id", F.array_join("bodies", ",").alias("bodies"), F.array_join(F.col("readings").cast("array<string>"), ",").alias("readings"))


@query("SELECT question_id, CASE WHEN reason = 'no_source' THEN NULL WHEN turn % 4 = 0 AND reason = 'weak_evidence' THEN 'fr weak_evidence' ELSE concat('en ', reason) END AS message FROM v_answers")
def C18_localized_reason(spark, d):
    rows = view(spark, d, "v_answers").withColumn("language", F.when(F.col("turn") % 4 == 0, "fr").otherwise("en"))
    codes = rows.select(F.col("reason").alias("code")).distinct().filter("code <> 'no_source'")
    english = codes.select("code", F.lit("en").alias("language"), F.concat(F.lit("en "), "code").alias("message"))
    french = codes.filter("code = 'weak_evidence'").select("code", F.lit("fr").alias("language"), F.concat(F.lit("fr "), "code").alias("message"))
    return dlg.localized_reason(rows, english.unionByName(french), "reason").select("question_id", "message")


@query(r"""SELECT conv_id, turn, CASE WHEN length(k) BETWEEN 1 AND 400 THEN concat(k, ' Ask?') ELSE 'Out of scope' END AS reply FROM (
    SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text, '. ', '? '), '[^.!?؟।۔]*[?؟]\s*', '', 'g'), '^\s+|\s+$', '', 'g') AS k FROM conversations WHERE text IS NOT NULL) t""")
def C19_general_reply(spark, d):
    t = table(spark, d, "conversations").filter("text IS NOT NULL")
    return t.select("conv_id", "turn", dlg.general_reply(F.replace("text", F.lit(". "), F.lit("? ")), F.lit("Ask?"), F.lit("Out of scope")).alias("reply"))


# --- calibration --------------------------------------------------------------------------------------------------------

_RUNS = """SELECT user_id AS item, CASE event_type WHEN 'view' THEN 'original' WHEN 'click' THEN 'short' WHEN 'error' THEN 'indirect' WHEN 'purchase' THEN 'english' ELSE 'synonym' END AS variant,
    nullif(count(*) % 4, 0) AS first_rank, count(*) % 2 = 0 AS sufficient, count(*) % 3 = 0 AS in_evidence, (count(*) % 5) / 4.0 AS term_coverage, nullif(count(*) % 5, 4) AS top FROM events GROUP BY 1, 2"""


def _runs(spark, d):
    e = table(spark, d, "events")
    names = {"view": "original", "click": "short", "error": "indirect", "purchase": "english", "signup": "synonym"}
    variant = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")]
    n = F.count(F.lit(1))
    return e.groupBy(F.col("user_id").alias("item"), variant.alias("variant")).agg(
        F.nullif(n % 4, F.lit(0)).alias("first_rank"), (n % 2 == 0).alias("sufficient"), (n % 3 == 0).alias("in_evidence"), (n % 5 / 4.0).alias("term_coverage"), F.nullif(n % 5, F.lit(4)).alias("top")
    )


@query(f"""SELECT item, variant, CASE WHEN first_rank = 1 AND sufficient THEN NULL WHEN first_rank = 1 THEN 'gate' WHEN in_evidence THEN 'ranking' WHEN variant IN ('english', 'short') THEN variant
    WHEN term_coverage < 0.5 THEN 'vocabulary' WHEN variant = 'original' OR item IN (SELECT item FROM ({_RUNS}) o WHERE variant = 'original' AND first_rank = 1) THEN 'exact_wording' ELSE 'vocabulary' END AS failure FROM ({_RUNS}) r""")
def E7_failure_class(spark, d):
    return c.failure_class(_runs(spark, d)).select("item", "variant", "failure")


@query(f"""SELECT round(100 * avg(CAST(coalesce(first_rank = 1, false) AS INT)), 6) AS top1, round(100 * avg(CAST(coalesce(first_rank <= 3, false) AS INT)), 6) AS top3,
      round(100 * avg(CAST(r.top IS NOT DISTINCT FROM o.top AS INT)), 6) AS agreement,
      (SELECT round(100 * avg(CAST(ok AS INT)), 6) FROM (SELECT item, bool_and(coalesce(first_rank <= 3, false)) AS ok FROM ({_RUNS}) a GROUP BY 1) b) AS robust
    FROM ({_RUNS}) r JOIN (SELECT item, top FROM ({_RUNS}) x WHERE variant = 'original') o ON o.item = r.item WHERE variant <> 'original'""")
def E8_consistency(spark, d):
    return c.consistency(_runs(spark, d))


_GRID = f"""SELECT weight, count(*) AS n, count(*) FILTER (f <= 1) AS top1, count(*) FILTER (f <= 3) AS top3, count(*) FILTER (f <= 5) AS top5, count(*) FILTER (f IS NULL OR f > 6) AS "A", count(*) FILTER (f BETWEEN 2 AND 6) AS "B",
      count(*) FILTER (f = 1) AS "C", count(*) FILTER (f IS NULL OR f > 1) AS "D", count(*) FILTER (variant = 'short' AND f <= 3) AS short_top3, count(*) FILTER (variant = 'indirect' AND f <= 3) AS indirect_top3 FROM (
    SELECT weight, question_id, variant, min(r) FILTER (accepted) AS f FROM (SELECT *, row_number() OVER (PARTITION BY weight, question_id ORDER BY round(dense + weight * coverage, 9) DESC, unit_id) AS r FROM (
      SELECT *, CASE question_id // 20 % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'indirect' ELSE 'formal' END AS variant, doc_id = query_label AS accepted, CAST(unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.25]) AS DOUBLE) AS weight
      FROM ({_EV}) e WHERE unit_id <> question_id) w) x GROUP BY 1, 2, 3) y GROUP BY 1"""


def _grid(spark, d):
    n = F.floor(F.col("question_id") / 20) % 3
    e = _evidence(spark, d).filter("unit_id <> question_id")
    return c.weight_grid(e.select("question_id", F.when(n == 0, "short").when(n == 1, "indirect").otherwise("formal").alias("variant"), F.col("unit_id").alias("item"), "dense", "coverage", (F.col("doc_id") == F.col("query_label")).alias("accepted")))


@query(_GRID)
def E11_weight_grid(spark, d):
    return _grid(spark, d)


_CHOSEN = f"""WITH g AS ({_GRID}), b AS (SELECT * FROM g WHERE weight = 0.25) SELECT g.weight, g."C" > b."C" AND g."D" <= b."D" AND g."B" <= b."B" AND g."A" <= b."A" AS adopted FROM g, b
    WHERE g."A" <= b."A" AND b.short_top3 - g.short_top3 <= 1 AND b.indirect_top3 - g.indirect_top3 <= 1 ORDER BY g."D", g."B", g."C" DESC, g.weight LIMIT 1"""


@query(_CHOSEN)
def E12_choose_weight(spark, d):
    grid = _grid(spark, d)
    return c.adopt_weight(grid, c.choose_weight(grid))


@query("""SELECT question_id, CASE turn % 8 WHEN 0 THEN outcome = 'answer' AND conv_id % 3 = 0 AND conv_id % 5 <> 0 WHEN 2 THEN outcome IN ('abstention', 'clarification') WHEN 4 THEN outcome IN ('abstention', 'clarification') AND conv_id % 2 = 0
    ELSE conv_id % 7 < 4 AND conv_id % 3 = 0 END AS passed FROM v_answers""")
def E13_hard_case_pass(spark, d):
    v, n = view(spark, d, "v_answers"), F.col("conv_id")
    category = F.when(F.col("turn") % 8 == 0, "discrimination").when(F.col("turn") % 8 == 2, "false_positive").when(F.col("turn") % 8 == 4, "no_evidence").otherwise("multi_turn")
    cited = F.array(F.when(n % 3 == 0, "right").otherwise("other"), F.when(n % 5 == 0, "wrong").otherwise("other"))
    cases = v.select("question_id", "outcome", category.alias("category"), F.when(n % 2 == 1, "text").alias("summary"), cited.alias("cited"), F.lit("right").alias("expect"), F.lit("wrong").alias("avoid"),
                     (n % 7 < 4).alias("verified"), F.lit(True).alias("parent_ok"), cited.alias("cited_categories"), F.array(F.lit("right")).alias("expect_categories"))
    return c.hard_case_pass(cases).select("question_id", "passed")


@query("""SELECT question_id, outcome = 'answer' AND (conv_id % 2 = 0 OR coalesce(r.kept AND contains(r.text, 'a'), false)) AS ok, CAST(coalesce(r.kept, false) AS BIGINT) AS kept, CAST(coalesce(NOT r.kept, false) AS BIGINT) AS rejected,
    CAST(coalesce(r.kept AND length(r.text) % 2 = 1, false) AS BIGINT) AS unsupported_shown FROM v_answers v
    LEFT JOIN (SELECT conv_id * 1000 + turn - 1 AS id, text, length(text) % 5 <> 0 AS kept FROM conversations WHERE role = 'assistant') r ON r.id = v.question_id""")
def E14_outcome_regression(spark, d):
    results = view(spark, d, "v_answers").select("question_id", "outcome", F.lit("answer").alias("expected"), F.when(F.col("conv_id") % 2 == 1, "a").alias("title_contains"))
    n = F.length("text")
    said = table(spark, d, "conversations").filter("role = 'assistant'")
    cited = said.select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("question_id"), (n % 5 != 0).alias("kept"), (n % 2 == 0).alias("supported"), F.col("text").alias("title"))
    return c.outcome_regression(results, cited)


@query("SELECT page_id AS question_id, regexp_extract(url, '([0-9]+)', 1) AS documents FROM pages WHERE page_id % 3 <> 0 AND regexp_extract(url, '([0-9]+)', 1) <> ''")
def E15_cited_documents(spark, d):
    claims = table(spark, d, "pages").select(F.col("page_id").alias("question_id"), (F.col("page_id") % 3 != 0).alias("kept"), F.array("url", "url").alias("urls"))
    return c.cited_documents(claims, "([0-9]+)").select("question_id", F.array_join("documents", ",").alias("documents"))


@query(f"""SELECT lc AS least_coverage, ld AS least_dense, count(*) FILTER (ok AND question_id % 3 <> 0 AND doc_id = query_label) AS correct, count(*) FILTER (ok AND question_id % 3 <> 0 AND doc_id <> query_label) AS wrong,
    count(*) FILTER (ok AND question_id % 3 = 0) AS outside_answered FROM (SELECT *, coverage >= lc AND dense >= ld AS ok FROM (SELECT *, unnest([0.0, 0.83, 0.87]) AS ld FROM (SELECT *, unnest([0.0, 0.66, 1.0]) AS lc FROM ({_EV}) e WHERE rank = 2) a) b) c GROUP BY 1, 2""")
def E17_extractive_rule_replay(spark, d):
    e = _evidence(spark, d).filter("rank = 2")
    return c.extractive_rule_replay(e.select("coverage", "dense", (F.col("doc_id") == F.col("query_label")).alias("correct"), (F.col("question_id") % 3 != 0).alias("in_corpus")))


@query("""SELECT turn AS variant, count(*) FILTER (conv_id % 5 <> 0 AND outcome = 'answer' AND conv_id % 3 <> 0 AND conv_id % 7 < 5) AS verified_correct, count(*) FILTER (conv_id % 5 <> 0 AND outcome = 'answer' AND conv_id % 7 >= 5) AS wrong_source,
    count(*) FILTER (conv_id % 5 <> 0 AND outcome = 'abstention') AS abstained, count(*) FILTER (conv_id % 5 = 0 AND outcome = 'answer') AS negatives_answered, CAST(sum(conv_id % 2) AS BIGINT) AS unsupported_shown FROM v_answers GROUP BY 1""")
def E18_variant_summary(spark, d):
    n = F.col("conv_id")
    rows = view(spark, d, "v_answers").select(F.col("turn").alias("variant"), "outcome", (n % 3 != 0).alias("verified"), (n % 7 < 5).alias("correct"), (n % 5 == 0).alias("negative"), (n % 2).alias("unsupported"))
    return c.variant_summary(rows)


@query(f"""SELECT model, coalesce(CAST(variant AS VARCHAR), 'ALL') AS variant, count(*) AS n, round(100 * avg(CAST(coalesce(first_rank <= 1, false) AS INT)), 6) AS top1, round(100 * avg(CAST(coalesce(first_rank <= 3, false) AS INT)), 6) AS top3,
    round(100 * avg(CAST(coalesce(first_rank <= 5, false) AS INT)), 6) AS top5 FROM (SELECT query_id // 20 % 2 AS model, label AS variant, first_rank FROM ({_RANKS}) r) x GROUP BY GROUPING SETS ((model, variant), (model))""")
def E19_compare_embedders(spark, d):
    ranks = _first_ranks(spark, d)
    return c.compare_embedders(ranks.select(F.floor(F.col("query_id") / 20 % 2).alias("model"), F.col("label").alias("variant"), "first_rank"))


@query("""SELECT phase, min(ms) AS min, percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS median, percentile_disc(0.95) WITHIN GROUP (ORDER BY ms) AS p95, max(ms) AS max FROM (
    SELECT 'input_tokens' AS phase, input_tokens AS ms FROM v_usage WHERE status = 'success' UNION ALL SELECT 'output_tokens', output_tokens FROM v_usage WHERE status = 'success') p GROUP BY 1""")
def E20_phase_latency(spark, d):
    u = view(spark, d, "v_usage").withColumn("mode", F.when(F.col("status") == "success", "llm").otherwise("none"))
    return c.phase_latency(u, ["input_tokens", "output_tokens"])


@query(f"""SELECT question_id, round(coalesce(max(n) / any_value(len(terms)), 0.0), 6) AS term_coverage FROM (SELECT q.question_id, q.terms, x.doc_id, count(*) FILTER (list_contains(x.terms, q.term)) AS n
      FROM (SELECT question_id, terms, unnest(terms) AS term FROM ({_TERMS}) t) q JOIN (SELECT doc_id, {STEMS.format("body")} AS terms FROM v_docs) x ON x.doc_id % 40 = q.question_id % 40 GROUP BY 1, 2, 3) a GROUP BY 1""")
def E6_term_coverage_best(spark, d):
    q = _questions(spark, d).select("question_id", "terms")
    docs = view(spark, d, "v_docs")
    accepted = q.select("question_id", (F.col("question_id") % 40).alias("m")).join(docs.select("doc_id", (F.col("doc_id") % 40).alias("m")), "m")
    held = docs.select("doc_id", F.explode(F.array_distinct(text.stems("body"))).alias("term"))
    out = c.term_coverage_best(q.filter(F.size("terms") > 0), accepted, held)
    return out.withColumn("term_coverage", F.round("term_coverage", 6))


@query(f"SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT question_id, doc_id, max(dense) AS score FROM ({_EV}) e GROUP BY 1, 2) m")
def V8_rank_documents(spark, d):
    e = _evidence(spark, d).withColumnRenamed("dense", "score")
    return c.rank_documents(e, "question_id").withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT coalesce(model, 'all') AS model, round(avg(input_tokens), 6) AS mean_in, round(avg(output_tokens), 6) AS mean_out, round(count(*) / 1000.0, 6) AS calls_per_question, round(sum(input_tokens + output_tokens) / 1000.0, 6) AS tokens_per_question,
    round(sum({_COST}) / 1000.0, 9) AS cost_per_question, round(sum({_COST}) / 1000.0 * 0.6, 9) AS cost_with_cache FROM v_usage WHERE api_call GROUP BY ROLLUP (model)""")
def U13_cost_projection(spark, d):
    return c.cost_projection(_priced(spark, d).filter("api_call"), 1000, 0.4, "model")


@query("SELECT user_id AS key, max(ts) AS created_at FROM events GROUP BY 1")
def U8_cache_store(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("created_at"))
    old = e.groupBy("key").agg(F.min("created_at").alias("created_at"))
    return g.cache_store(old, e)


@query("""SELECT s.slug, x.doc_id, x.title FROM v_sources s LEFT JOIN (SELECT source_slug, doc_id, title FROM v_docs WHERE source_slug = (SELECT min(slug) FROM v_sources) ORDER BY title COLLATE C, doc_id LIMIT 500) x
    ON x.source_slug = s.slug WHERE s.slug = (SELECT min(slug) FROM v_sources)""")
def D3_source_detail(spark, d):
    sources = view(spark, d, "v_sources")
    slug = sources.agg(F.min("slug")).first()[0]  # one value
    return g.source_detail(sources, view(spark, d, "v_docs").select("source_slug", "doc_id", "title"), slug).select("slug", "doc_id", "title")


@query(r"SELECT conv_id, turn, nullif(regexp_replace(coalesce(text, ''), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g'), '') AS found FROM conversations")
def T18_locate_verbatim(spark, d):
    spaced = F.replace("text", F.lit(" "), F.lit(" , "))
    return table(spark, d, "conversations").select("conv_id", "turn", text.locate_verbatim("text", spaced).alias("found"))


@query()
def S12_reindex(spark, d):
    units = ingest.reindex(view(spark, d, "v_docs"), view(spark, d, "v_sources"), None, 64, "hash")
    return units.select("doc_id", "ordinal", F.length("content").alias("n_chars"), "model")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def S24_parse_api_json(spark, d):
    return ingest.parse_api_json(table(spark, d, "events").select("event_id", "props"), "k long", "k", "props")
