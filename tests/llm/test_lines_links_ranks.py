"""Line dedup, cross-tokenizer alignment and ranked lexical search against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridoc.llm import alignment, lexical_search, line_dedup

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "\n".join(f"line {i % 700} of many Words" for i in range(4000))
TEXTS = [
    "The menu\nfirst words here\n the MENU \t\n", None, "", "the menu", "\n\n", "words  apart\n the menu \nTHE MENU\r\nmore", "first words here\nthe menu",
    LONG, LONG, "a▁b c", "tab\there 　 wide  space  <|endoftext|> <s> <0x41> </s>", "  leading and trailing  ", "漢字かな \U0001f600 \U0001f600\U0001f600 naïve ﬁ Å é",
    "x" * 3000, "don't can't I'll 12345 3.14", " ", "nul\x00 and \x1c odd\x85 breaks  x", "ÄÄ STRASSE Straße straße",
]
ROWS = [(i if i != 4 else None, t, "q") for i, t in enumerate(TEXTS)] + [(3, "the menu", "q")]
SCHEMA = "doc_id long, text string, n string"  # n clashes with internal names


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- lines ------------------------------------------------------------------------------------------------------------


def key(line):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return lowered.strip(" \t\n\x0b\x0c\r")


def plain_lines(rows, least):
    held = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_frequent_lines(docs, least):
    got = line_dedup.drop_frequent_lines(docs, least)
    assert got.columns == ["doc_id", "text", "n", "lines"]
    assert Counter((r["doc_id"], *r["lines"]) for r in got.collect()) == plain_lines(ROWS, least)


def test_no_lines(empty):
    assert line_dedup.drop_frequent_lines(empty).count() == 0


def test_runs_settle_and_merge(spark):
    """Whatever the order and number of batches, the runs settle the lines that enough documents hold."""
    rng = np.random.default_rng(5)
    held = [(int(x).to_bytes(16, "big"), int(b)) for x, b in zip(rng.zipf(1.3, 900) % 200, rng.integers(0, 5, 900), strict=True)]
    rows = spark.createDataFrame(held, "h binary, batch int")
    runs = line_dedup.LineRuns(spark, 6)
    for b in range(5):
        runs.add(rows.filter(F.col("batch") == b).select("h"), b)
        runs.add(rows.filter(F.col("batch") == b).select("h"), b)  # once more: nothing changes
        counts = Counter(h for h, own in held if own <= b)
        assert {bytes(r["h"]) for r in runs.settled().collect()} == {h for h, n in counts.items() if n >= 6}
        assert len(runs.runs()) == bin(b + 1).count("1")
    # A merge that was broken off before its inputs were dropped counts nothing twice.
    (_, first, last), *_ = runs.runs()[-1:]
    spark.table(runs._table(runs.runs()[-1])).write.bucketBy(runs.buckets, "h").sortBy("h").saveAsTable(f"{runs.name}.run_0_{first}_{first}", format="parquet")
    assert {bytes(r["h"]) for r in runs.settled().collect()} == {h for h, n in counts.items() if n >= 6} and last > first
    plan = runs.settled()._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
    runs.drop()


def test_merges_shuffle_nothing(spark):
    runs = line_dedup.LineRuns(spark, 2)
    rows = spark.range(64).select(F.col("id").cast("string").cast("binary").alias("h"))
    for name in ("run_0_0_0", "run_0_1_1"):
        rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).write.bucketBy(runs.buckets, "h").sortBy("h").saveAsTable(f"{runs.name}.{name}", format="parquet")
    merged = runs._merged(*map(runs._rows, runs.runs()))
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString() and merged.filter("n = 2").count() == 64
    runs.drop()


def test_seen_lines(spark):
    """Batch by batch, lines that an earlier batch held go."""
    batches = [[(1, "a\nb\na")], [(2, "B \nc"), (3, "c\nd")], [(4, "d\ne\n\nA")]]
    runs, got = line_dedup.LineRuns(spark, 1), []
    for k, rows in enumerate(batches):
        out = line_dedup.drop_seen_lines(spark.createDataFrame(rows, "doc_id long, text string"), runs, k)
        got += [(r["doc_id"], r["lines"]["text"]) for r in out.collect()]
    assert sorted(got) == [(1, "a\nb\na"), (2, "c"), (3, "c\nd"), (4, "e\n")]
    runs.drop()


# --- links ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE_LEVEL), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    return a, b


def plain_links(libraries, texts):
    """Per text (sizes, groups, links by pair) from whole texts, and document counts of the pairs."""
    a, b = libraries
    to_byte, out = alignment.byte_alphabet(), []
    for t in texts:
        raw = (" " + (t or "")).encode()
        ids_a, ids_b = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        spelled_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
        spelled_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            out.append(((0, 0, 0, 0), "", Counter()))
            continue
        ends_a, ends_b = (np.cumsum([len(s) for s in x]).tolist() for x in (spelled_a, spelled_b))
        both = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for e in both:
            groups.append(([i for i, x in zip(ids_a, ends_a, strict=True) if low < x <= e], [i for i, x in zip(ids_b, ends_b, strict=True) if low < x <= e]))
            low = e
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append(((len(ids_a), len(ids_b), len(groups), sum(links.values())), shown, links))
    return out, Counter(p for *_, links in out for p in links)


@pytest.mark.parametrize("round_pairs", [50, alignment.ROUND_PAIRS])
def test_links(docs, libraries, round_pairs):
    short = docs.filter(F.length("text").isNull() | (F.length("text") < 5000))
    rows = [r for r in ROWS if len(r[1] or "") < 5000]
    found, counts = plain_links(libraries, [t for _, t, _ in rows])
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    want = Counter(
        (i, *sizes, sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else "")
        for (i, *_), (sizes, shown, links) in zip(rows, found, strict=True)
    )
    got = alignment.align_and_score(short, BYTE_LEVEL, PIECES, round_pairs=round_pairs)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.select(names).collect()) == want
    assert sum(s[0] > 0 for s, *_ in found) > 8 and sum(s[0] == 0 and bool(t) for (s, *_), (_, t, _) in zip(found, rows, strict=True)) > 0


def test_printed_groups(docs, libraries):
    got = {r["doc_id"]: r["groups"] for r in alignment.align_documents(docs, BYTE_LEVEL, PIECES, groups=True).collect()}
    found, _ = plain_links(libraries, ["don't can't I'll 12345 3.14", LONG[:3000]])
    assert got[14] == found[0][1] and got[7].startswith(found[1][1][:2000])


def test_no_links(empty):
    assert alignment.align_and_score(empty, BYTE_LEVEL, PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t..,,!?;:'aabcXYZé×019 　 ▁é\x85\x1c漢”"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_chunks_change_no_token(texts):
    """Cutting a text into chunks gives the same sizes and groups as whole texts."""
    own = alignment.aligner(BYTE_LEVEL, PIECES)
    own.limit = 50
    import pyarrow as pa

    found, _ = plain_links((own.a, own.b), texts)
    sizes, shown, per, pairs, links = own.align(pa.array(texts, pa.string()))
    assert [tuple(s) for s in sizes.tolist()] == [f[0] for f in found] and shown == [f[1] for f in found]
    ends = np.cumsum(per)
    for (*_, want), e, n in zip(found, ends.tolist(), per.tolist(), strict=True):
        assert dict(zip(pairs[e - n : e].tolist(), links[e - n : e].tolist(), strict=True)) == {x * own.n_b + y: n for (x, y), n in want.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 400))), max_size=5))
def test_gallop(texts):
    a, b = ([sorted(t[k]) for t in texts] for k in (0, 1))
    flat = lambda x: np.array([v for s in x for v in s], np.int64)
    sizes = [np.array(list(map(len, x)), np.int64) for x in (a, b)]
    want, at_a, at_b = [], 0, 0
    for x, y in zip(a, b, strict=True):
        want += [(at_a + x.index(v), at_b + y.index(v)) for v in x if v in y]
        at_a, at_b = at_a + len(x), at_b + len(y)
    got = alignment.common_ends(flat(a), sizes[0], flat(b), sizes[1])
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want


# --- ranks ------------------------------------------------------------------------------------------------------------


def plain_search(rows, items, top):
    def terms(t):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    docs = [(i, Counter(terms(t))) for i, t, *_ in rows]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 25 + (75 * c.total() * n_docs) // max(n_terms, 1)
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


ITEMS = [(0, "the menu first words"), (1, "words first THE menu menu"), (2, None), (3, "nowhere-to-be.found"), (4, "many words 12345"), (4, "the menu first words"), (None, "line 5 of"), (5, "ÄÄ straße x")]


@pytest.mark.parametrize(("top", "block"), [(10, 200_000), (2, 3)])
def test_search(spark, docs, top, block):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = lexical_search.search(docs, items, top, block_terms=block).collect()
    assert Counter(tuple(r) for r in got) == plain_search(ROWS, ITEMS, top)


def test_search_of_many(spark):
    """Items that share terms, and documents with equal scores."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(words[k] for k in (rng.zipf(1.4, n) % 60))
    rows = [(i, text(int(rng.integers(0, 12)))) for i in range(1500)]
    rows += [(1500 + i, t) for i, (_, t) in enumerate(rows[:300])]
    items = [(k, text(int(rng.integers(1, 9)))) for k in range(60)]
    got = lexical_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == plain_search(rows, items, 10)


def test_plan_shares_steps():
    """Items that begin with the same sets share steps, and every item is the sum of its terms."""
    sets = [([0, 3], [0, 1, 2], [1, 1, 1]), ([1], [0, 1], [2, 2]), ([2], [2], [1]), ([4], [1], [3])]
    p = lexical_search.plan(sets, 5)
    assert p.n_sets == 4 and p.n_steps == 4  # 6 uses of sets, two of them shared
    part = np.array([10, 20, 30, 40, 50])
    scores = lexical_search.combine(p, np.zeros(5, np.int64), np.arange(5), part, 1)[:, 0]
    assert dict(zip(p.items.tolist(), scores.tolist(), strict=True)) == {0: 50 + 40, 1: 50 + 40 + 150, 2: 50 + 30}


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(docs, items.filter("false")).count() == 0
