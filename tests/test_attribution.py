"""Quotation checks: prefix, negation, verbatim, similar, misattributed and unknown quotations."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veridoc.operators import attribution as A
from veridoc.operators import chunking

SAID = "One must not run in the hall at night. Lamps stay lit until the morning bell rings twice."


def verdicts(spark, rows):
    pairs = spark.createDataFrame(rows, "message_id int, claim string, named string, source_slug string, content string, rank int")
    best = A.closest_passages(pairs, ["message_id", "rank"])
    return {r["message_id"]: r["verdict"] for r in A.decide(best).collect()}


def test_verdicts(spark):
    got = verdicts(spark, [
        (1, "lamps stay lit until the morning bell", "s1", "s1", SAID, 1),
        (2, "lamps stay lit until the morning bell", "s2", "s1", SAID, 1),
        (3, "entirely different words about ships at sea", "s1", "s1", SAID, 1),
        (4, "lamps stay lit until the evening bell rings", None, "s1", SAID, 1),
        (5, "lamps stay dark until the morning bell", "s2", "s2", "Lamps stay dim until some morning bell.", 1),
        (5, "lamps stay dark until the morning bell", "s2", "s1", "Lamps stay dark until the morning bell.", 2),
    ])
    assert got == {1: "verbatim", 2: "misattributed", 3: "not_found", 4: "similar", 5: "misattributed"}


def test_split_claim_and_source(spark):
    df = spark.createDataFrame([(1, "قال الشيخ: «يجوز ذلك» اهـ."), (2, "no lead here")], "message_id int, message string")
    got = {r["message_id"]: r["c"] for r in df.select("message_id", A.split_claim(F.col("message"), F.lit(False)).alias("c")).collect()}
    assert got == {1: "يجوز ذلك", 2: "no lead here"}
    names = spark.createDataFrame([("s1", 1, "ابن باز"), ("s2", 2, "بن باز")], "source_slug string, ord int, name string")
    asked = spark.createDataFrame([(1, "قال ابن باز رحمه الله"), (2, "x"), (3, None)], "message_id int, message string")
    assert {r["message_id"]: r["named"] for r in A.attributed_source(asked, names).collect()} == {1: "s1", 2: None, 3: None}


def plain_coverage(claim, passage):
    """The library's matching blocks, without its rule on popular words."""
    return sum(b.size for b in SequenceMatcher(None, claim, passage, autojunk=False).get_matching_blocks()) / len(claim) if claim else 0.0


def test_ordered_coverage_equals_matching_blocks():
    rng = random.Random(8)
    for _ in range(1500):
        words = "abcdefgh"[: rng.randrange(1, 9)]
        claim, passage = ([rng.choice(words) for _ in range(rng.randrange(n))] for n in (14, 40))
        assert A.ordered_coverage(claim, passage) == plain_coverage(claim, passage)


def test_best_window_equals_trying_all():
    rng = random.Random(9)
    for _ in range(300):
        words = "abcdefghijkl"[: rng.randrange(2, 13)]
        claim = [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        sentences = [[rng.choice(words) for _ in range(rng.randrange(0, 9))] for _ in range(rng.randrange(1, 9))]
        most = rng.randrange(1, 7)
        tried = [
            (-plain_coverage(claim, [w for s in sentences[at : at + size] for w in s]), size, at)
            for size in range(1, min(most, len(sentences)) + 1) for at in range(len(sentences) - size + 1)
        ]
        cover, size, at = min(tried)
        assert A.best_window(claim, sentences, most) == (at, size, -cover)
    assert A.best_window([], [["a"]], 2) == (0, 1, 0.0) and A.best_window(["a"], [[]], 2) == (0, 1, 0.0)


def plain_split(text, most):
    """The rule in words: while longer than the limit, cut behind the last mark if it stands at the half or later, else
    behind the last space, else at the limit."""
    out = []
    while len(text) > most:
        at = max(i if c in "؛،;," else -1 for i, c in enumerate(text[:most]))
        if at < most // 2:
            at = text[:most].rfind(" ")
        at = at if at > 0 else most - 1
        out.append(text[: at + 1].strip())
        text = text[at + 1 :].strip()
    return [*out, text] if text else out


@pytest.mark.parametrize("place", [448, 449, 450, 451])
def test_cut_at_the_half(spark, place):
    told = "x" * 300 + " " + "y" * (place - 301) + "," + "z" * 700
    assert chunking.split_long(told) == plain_split(told, 900)
    df = spark.createDataFrame([(told,)], "t string")
    from veridoc.functions import text

    assert df.select(text.cut_long("t", 900).alias("p")).first()["p"] == plain_split(told, 900)
    assert (len(chunking.split_long(told)[0]) == place + 1) == (place >= 450)


def test_cuts_as_the_rule_says(spark):
    rng = random.Random(3)
    told = ["".join(rng.choice("ab ,؛x") for _ in range(rng.randrange(1, 160))).strip() for _ in range(300)]
    assert [chunking.split_long(t, 21) for t in told] == [plain_split(t, 21) for t in told]
    from veridoc.functions import text

    rows = spark.createDataFrame(list(enumerate(told)), "i int, t string").select("i", text.cut_long("t", 21).alias("p")).collect()
    assert {r["i"]: [p for p in r["p"]] for r in rows} == {i: [p for p in plain_split(t, 21) if p] for i, t in enumerate(told)}


def test_chunks_of_question_and_answer():
    q, a = "What is the rule of this and that?", "Short answer."
    assert chunking.chunk_text(a, q) == [f"{q}\n\n{a}"] and chunking.chunk_text("", q) == [q] and chunking.chunk_text(" ", None) == []
    long = "\n\n".join(f"Paragraph {i} begins here and says something. " + f"Its end number {i} is a sentence. " * 9 for i in range(9))
    parts = chunking.chunk_text(long, q)
    assert parts[0].startswith(q + "\n\nParagraph 0") and all(len(p) <= chunking.PACK + chunking.OVERLAP + 2 for p in parts)
    for one, two in zip(parts, parts[1:]):
        tail = two.split("\n\n")[0]
        assert one.endswith(tail) and len(tail) <= chunking.OVERLAP
    # No overlap after a question that fills its chunk, nor with a last sentence that is too long.
    wide = "w" * 880 + "?"
    assert chunking.chunk_text("y" * 600, wide)[1] == "y" * 600
    assert chunking.chunk_text("\n\n".join(["a" * 400 + "."] * 4))[1].count("a" * 400) == 2
    assert chunking.sentences("One. Two is a sentence that is long enough. End.") == ["One. Two is a sentence that is long enough. End."]


def test_chunks():
    assert chunking.chunk_text(None) == [] and chunking.chunk_text("q\n\na") == ["q\n\na"]
    text = "\n\n".join(" ".join(f"w{i}x{k}" for k in range(30)) for i in range(20))
    parts = chunking.chunk_text(text)
    assert len(parts) > 1 and all(len(p) <= chunking.PACK + chunking.OVERLAP + 2 for p in parts)
    run = ", ".join(f"word{i}" for i in range(400))
    assert all(len(p) <= chunking.PACK for p in chunking.split_long(run)) and "".join(chunking.split_long(run)).replace(" ", "") == run.replace(" ", "")
