"""Training-data operators against brute force on small tables with nulls, empty and long texts, ties and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridoc.llm import backoff_lm, binary_ids, chat, exact_dedup, html_extract, packing, quality, queries, spm_sampling, toxicity
from veridoc.llm import weighted_minhash as wm

WORDS = "the cat sat on a mat and then it ran away from big dogs in town".split()
LONG = " ".join(WORDS[i * i % len(WORDS)] + str(i % 97) for i in range(6000))
ROWS = [
    (1, "the cat sat on a mat", "en", "x"), (2, None, None, "y"), (3, "", "en", None), (4, "the cat sat on a mat", "de", "z"),
    (5, LONG, "en", "x"), (5, LONG, "en", "x"), (None, "no id here", "fr", "x"), (7, "It's <|endoftext|> ünïcode — 漢字 \U0001F600\n\n x", "en", "q"),
    (8, LONG.replace("cat1 ", "cow1 ", 1), "en", "q"), (9, "  \n \t ", "en", "q"), (10, "</s> ### a.b ...x A\u0300", "en", "q"),
]
SCHEMA = "doc_id long, text string, lang string, digest string"  # digest clashes with an internal name


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def true_ids(text):
    from tokenizers import Tokenizer

    t = true_ids.__dict__.setdefault("t", Tokenizer.from_file(queries.word_bpe()))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_packing(docs, empty):
    got = packing.packed_pieces(docs, queries.word_bpe(), 256).collect()
    want = Counter((i, true_ids(t).tobytes()) for i, t, *_ in ROWS)
    by = defaultdict(list)
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256 and len(r["ids"]) == 4 * r["length"] and r["offset"] == 0
        by[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    assert len({r["sequence_id"] for r in got}) == len(got) and max(r["sequence_id"] for r in got) == len(got) - 1
    for (i, raw), n in want.items():
        parts = sorted(by[i, len(raw) // 4])
        assert len(parts) % n == 0 and b"".join(p for _, p in parts[::n]) == raw
    assert packing.packed_pieces(empty, queries.word_bpe()).count() == 0


def test_binary_ids_round_trip(docs, empty):
    got = sorted(binary_ids.read_ids(binary_ids.write_ids(docs, queries.word_bpe())).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, true_ids(t).tobytes()) for i, t, *_ in ROWS)
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in got)
    assert binary_ids.read_ids(binary_ids.write_ids(empty, queries.word_bpe())).count() == 0


@pytest.mark.parametrize("n", [0, 1, 59, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 1 << 40, (1 << 64) - 1])
def test_words_round_trip(n, top):
    v = np.random.default_rng(n).integers(0, top, n, np.uint64, endpoint=True)
    words, firsts, literals = binary_ids.encode_words(v)
    assert (binary_ids.decode_words(words, literals, n) == v).all()
    for b in range(len(firsts)):
        own = v[b * binary_ids.BLOCK : (b + 1) * binary_ids.BLOCK]
        assert (binary_ids.decode_block(words, firsts, literals, n, b) == own).all()


def test_chat(spark):
    texts = ["plain", None, "", "a\\b", "### User: x</turn>\n### Assistant: y", "</turn>", "\\", "\\</turn>\\", "<\\/turn>", LONG, ": ", "### "]
    rows = [(c, k, role, t, "x") for c in (1, 2) for k, t in enumerate(texts) for role in ["user" if k % 2 else "assistant"]]
    rows += [(3, None, None, "no turn", "x"), (3, 1, "odd: role</turn>", "t", "x"), (3, 1, "odd: role</turn>", "t", "x"), (None, 1, "user", "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    want = defaultdict(list)
    for c, k, role, t, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", t or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        r, loss = out[c], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_plan_is_native(spark, docs):
    df = spark.sql(queries.HOSTILE)
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_segmentations(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = spm_sampling.sample_segmentations(docs, path, 3).collect()
    assert all(r["decoded_ok"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["sample"], bytes(r["ids"]), r["perturbed"]))
    for i, t, *_ in ROWS:
        own = sorted(set(by[i]))
        if not t:
            assert [x[1] for x in own] == [b""]
        elif i != 5:
            assert len({x[1] for x in own}) == len(own) == 3 and own[0][2] >= own[1][2] >= own[2][2]
    assert spm_sampling.sample_segmentations(empty, path).count() == 0


def test_segmentation_frequencies():
    import public_tokenizers

    lat = spm_sampling.Lattices(public_tokenizers.path("piece_bpe_32k.model"))
    text, n = spm_sampling.normalized("the cat"), 6000

    def cut(w):
        if not w:
            yield ()
        for b in range(1, len(w) + 1):
            if w[:b] in lat.piece:
                yield from ((lat.piece[w[:b]], *rest) for rest in cut(w[b:]))

    every = {a + b: lat.log_ps[list(a + b)].sum() for a in cut("▁the") for b in cut("▁cat")}
    total = np.logaddexp.reduce(list(every.values()))
    p = {s: math.exp(v - total) for s, v in every.items()}
    drawn = spm_sampling.sample_texts([text] * n, np.random.default_rng(5).integers(1, 1 << 58, n).tolist(), lat, 2)
    first = Counter(tuple(lat.spell(f[0][3]).tolist()) for f in drawn)
    second = Counter(tuple(lat.spell(f[1][3]).tolist()) for f in drawn)
    for s in sorted(p, key=p.get)[-3:]:
        assert abs(first[s] / n - p[s]) < 0.03
        assert abs(second[s] / n - sum(p[t] * p[s] / (1 - p[t]) for t in p if t != s)) < 0.03


def test_inclusion_scores_make_unbiased_sums():
    """Drawn without replacement, each segmentation weighted by p / inclusion: the sum of a quantity over the drawn ones is, in
    the mean, its expectation over all (here of 1, and of the number of pieces)."""
    import public_tokenizers

    lat = spm_sampling.Lattices(public_tokenizers.path("piece_bpe_32k.model"))
    text, n = spm_sampling.normalized("cats"), 5000

    def cut(w):
        if not w:
            yield ()
        for b in range(1, len(w) + 1):
            if w[:b] in lat.piece:
                yield from ((lat.piece[w[:b]], *rest) for rest in cut(w[b:]))

    every = list(cut(text))
    weight = np.exp([lat.log_ps[list(c)].sum() for c in every])
    pieces = float((weight * [len(c) for c in every]).sum() / weight.sum())
    drawn = spm_sampling.sample_texts([text] * n, np.random.default_rng(11).integers(1, 1 << 58, n).tolist(), lat, 3)
    for found in drawn[:200]:
        assert all(0 < f[2] <= 1 for f in found) and len({tuple(lat.spell(f[3])) for f in found}) == len(found)
    sums = np.array([[sum(math.exp(f[0]) / f[2] * v for f in found for v in [1.0]), sum(math.exp(f[0]) / f[2] * len(lat.spell(f[3])) for f in found)] for found in drawn])
    error = 4 * sums.std(0) / n**0.5
    assert np.all(np.abs(sums.mean(0) - [1.0, pieces]) < error) and error[0] < 0.1
    few = spm_sampling.sample_texts([spm_sampling.normalized("")], [5], lat, 3)[0]
    assert [f[2] for f in few] == [1.0]  # what has no other segmentation is drawn for sure


def test_segmentations_of_unbroken_and_repeated_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    long = "".join("abcdefghij"[i * i % 10] for i in range(12_000))
    rows = [(1, long, 5), (2, "the cat sat", 6), (2, "the cat sat", 6), (None, "漢字", 7)]
    got = spm_sampling.sample_segmentations(spark.createDataFrame(rows, "doc_id long, text string, sample int"), path, 3).collect()
    assert all(r["decoded_ok"] for r in got) and len(got) == 10  # two unknown letters have one segmentation
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["sample"]].append(bytes(r["ids"]))
    assert all(len(set(by[2, k])) == 1 and len(by[2, k]) == 2 for k in (1, 2, 3))  # repeated rows have one key
    assert len({by[i, k][0] for k in (1, 2, 3) for i in (1,)}) == 3 and len({by[2, k][0] for k in (1, 2, 3)}) == 3


def test_lattices_are_shared_by_words_that_differ_in_what_no_piece_joins():
    import public_tokenizers

    lat = spm_sampling.Lattices(public_tokenizers.path("piece_bpe_32k.model"))
    stems = ["the", "cat", "Haus", "été"]
    texts = [spm_sampling.normalized(a + x + b + y) for a in stems for b in stems for x in (".\n", ",\n", "\n\n") for y in ("", "%%%", "&&&", ".")]
    texts += ["", spm_sampling.normalized("  a  b "), spm_sampling.normalized("▁▁x▁ \U0001F600\U0001F601")]
    raw = [t.encode() for t in texts]
    chunks, word, text = lat.split(raw)
    chunks = chunks.to_pylist()
    assert b"".join(chunks) == b"".join(raw) and word[-1] == len(chunks) and text[-1] == len(word) - 1
    for t, a, b in zip(texts, text[:-1], text[1:]):
        assert [b"".join(chunks[word[i] : word[i + 1]]).decode() for i in range(a, b)] == re.findall("▁*[^▁]+|▁+", t)
        own, at = [c.decode() for c in chunks[word[a] : word[b]]], 0
        for c in own[:-1]:  # no piece holds both sides of a cut
            at += len(c)
            assert not any(t[x:y] in lat.piece for x in range(max(0, at - lat.longest), at) for y in range(at + 1, min(len(t), x + lat.longest) + 1))
    drawn = spm_sampling.sample_texts(texts, list(range(1, len(texts) + 1)), lat, 3)
    assert all(lat.spelled(lat.spell(f[3])) == r if len(f[3]) else not r for found, r in zip(drawn, raw) for f in found)
    assert len(lat.chunk) < 40  # words, without the cuts, would be 192


def test_groups_left_undrawn_change_nothing(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [spm_sampling.normalized(t) for t in (LONG, "漢字" * 400 + " the cat", "漢" * 300, LONG[:40], "", "a")]
    found = []
    for far in (spm_sampling.FAR, -1e9, -0.5):
        monkeypatch.setattr(spm_sampling, "FAR", far)
        found.append(spm_sampling.sample_texts(texts, [3, 4, 5, 6, 7, 8], spm_sampling.Lattices(path), 4))
    for other in found[1:]:
        for x, y in zip(found[0], other, strict=True):
            assert [f[3].tolist() for f in x] == [f[3].tolist() for f in y]
            assert np.allclose([f[:3] for f in x], [f[:3] for f in y], rtol=1e-9)


def brute_metrics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(five)
    covered = {k for i, w in enumerate(five) if n[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [t for _, t, *_ in ROWS] + ["a b c d e " * 30, "x\nx\n \nx", "İSTANBUL ß", " ".join(f"w{i % 7000}" for i in range(15000))])
def test_quality_metrics(text):
    assert quality.text_metrics(text)[:5] == brute_metrics(text)


def test_binomial_bound():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n in ((0, 50), (3, 200), (10, 60)):
        assert abs(tail(k, n, quality.upper_bound(k, n, 0.01)) - 0.01) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0


def test_cutoffs_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{i % 3}" if i % 7 else None, int(rng.random() < (0.5, 0.9, 0.2)[i % 3]), float(rng.gamma(1.0 + (i % 3) / 4, 0.5))) for i in range(6000)]
    rows = [(s, y, x if y else x * 3) for s, y, x in rows] + [("one kind", 1, 0.1), ("s0", None, 99.0)]
    got, n = quality.calibrate(spark.createDataFrame(rows, "s string, y int, x double"), "s", "y", "x", 0.1, 0.95)
    want = {}
    for s in {r[0] for r in rows}:
        good, junk = ([x for t, y, x in rows if t == s and y == label] for label in (1, 0))
        best, gain = None, 0.0
        for c in quality.CUTOFFS:
            k, m = sum(x >= c for x in good), len(good)
            if sum(math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(0.1) + (m - i) * math.log(0.9)) for i in range(k + 1)) > 0.05 / 5:
                break  # a rate of 0.1 would still give so few hits too often
            worth = sum(x >= c for x in junk) / max(len(junk), 1) - k / max(m, 1)
            if worth > gain:
                best, gain = c, worth
        want[s] = best
    assert n == 5 and {r["_q_s"]: r["_q_cut"] for r in got.collect()} == want and len({*want.values()}) > 2


def test_rows_labelled_both_ways_have_no_label(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30)), "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i in range(20) for y in (0, 1)], "doc_id long, quality int")
    assert quality.quality_verdicts(docs, labels).filter("quality.kept").count() == 20


def test_quality_keeps_good_documents(spark, sf, docs, empty):
    d = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op4_quality(spark, d).join(labels, "doc_id").filter("NOT base_failed")
    counts = {(r["quality"], r["kept"]): r["n"] for r in got.groupBy("quality", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts.get((1, False), 0) <= quality.MAX_FALSE_REJECTION * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] > 0.9 * (counts[0, False] + counts.get((0, True), 0))
    none = labels.limit(0)
    rows = quality.quality_verdicts(docs, none).collect()
    assert len(rows) == len(ROWS) and all(r["quality"]["kept"] != r["quality"]["base_failed"] for r in rows)
    assert quality.quality_verdicts(empty, none).count() == 0


def test_quality_certifies_every_labelled_stratum(spark, monkeypatch):
    plain, loud = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}!" for i in range(40))
    rows, labels = [], []
    for k in range(70):  # loud documents are junk in all strata but the last, which has fewest labels, and null is a stratum
        name = None if k == 0 else f"s{k:02d}"
        for j in range(1000 if k < 69 else 900):
            bad = j % 2 == 1
            rows.append((len(rows), loud if bad or k == 69 else plain, name))
            labels.append((len(labels), 1 if k == 69 or not bad else 0))
    rows += [(len(rows) + j, loud, name) for j, name in enumerate(("none", ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality long")
    for few in (quality.BROADCAST_STRATA, 1):
        monkeypatch.setattr(quality, "BROADCAST_STRATA", few)
        got = quality.quality_verdicts(docs, known)
        assert got.columns == [*docs.columns, "quality"]
        kept = Counter({r["lang"]: r["n"] for r in got.filter("quality.kept").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()})
        assert kept == Counter({None: 500, **{f"s{k:02d}": 500 for k in range(1, 69)}, "s69": 900, "none": 1, "": 1})


def test_toxicity(spark, sf, docs, empty):
    d = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = queries.op5_toxicity(spark, d).join(labels, "doc_id").filter("held_out").toPandas()
    rank = got["score"].rank().to_numpy()
    pos = (got["toxic"] == 1).to_numpy()
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95
    flagged = got[got["predicted"] == 1]
    assert (flagged["toxic"] == 1).mean() > 0.95 and len(flagged) > 0.7 * pos.sum()
    assert [r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()] == [0.0] * len(ROWS)
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def brute_backoff(texts, order):
    """(words, score) of each text, by the definition."""
    docs = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())] for t in texts]
    count, held = Counter(), defaultdict(set)
    for d, w in enumerate(docs):
        for i in range(len(w)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0 and (i > 0 or len(w) > 1):
                    count[tuple(w[i - k + 1 : i + 1])] += 1
                    held[tuple(w[i - k + 1 : i + 1])].add(d)
    n = sum(len(w) - 1 for w in docs)
    out = []
    for w in docs:
        total = 0.0
        for i in range(1, len(w)):
            top = min(order, i + 1)
            k = next((k for k in range(top, 1, -1) if len(held[tuple(w[i - k + 1 : i + 1])]) >= 2), 1)
            own = count[tuple(w[i - k + 1 : i + 1])]
            total += (top - k) * math.log(0.4) + math.log(own / (count[tuple(w[i - k + 1 : i])] if k > 1 else n))
        out.append((len(w) - 1, total))
    return out


BLANKS = [(20 + k, t, "en", "x") for k, t in enumerate([" ", "\n", "\t \n ", "the cat ", "\nthe cat\n", "a\u00a0b", "on a mat\u2003", "cat "] * 25)]


def test_toxicity_by_brute_force(monkeypatch):
    rng, vocabulary = np.random.default_rng(2), ["good", "fine", "nice", "Bad", "evil", "plain", "Ünder", "漢字"]
    y = np.arange(80) % 2
    texts = [" ".join(rng.choice(vocabulary, 8, p=[0.2, 0.2, 0.1, 0.05, 0.05, 0.2, 0.1, 0.1] if not t else [0.05, 0.05, 0.1, 0.2, 0.2, 0.2, 0.1, 0.1])) for t in y]
    texts[0], texts[1] = None, "a"
    monkeypatch.setattr(toxicity, "STEPS", 4000)

    def gram_set(text):
        t = f"\x00{'\x00'.join((text or '').lower().split())}\x00"
        return {t[i : i + n] for n in toxicity.NGRAMS for i in range(len(t) - n + 1)}

    sets = [gram_set(t) for t in texts]
    every = sorted(g for g in set.union(*sets) if sum(g in s for s in sets) >= toxicity.MIN_DOCS)
    x = np.array([[g in s for g in every] for s in sets], float)
    p, q = x[y == 1].sum(0) + 1, x[y == 0].sum(0) + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    z, w, b = x * ratio, np.zeros(len(every)), 0.0
    for _ in range(60):  # Newton steps
        m = 1 / (1 + np.exp(-(z @ w + b)))
        zb, g = np.column_stack([z, np.ones(80)]), (m - y) / 80
        h = (zb * (m * (1 - m) / 80)[:, None]).T @ zb + np.diag([toxicity.L2] * len(every) + [1e-12])
        d = np.linalg.solve(h, zb.T @ g + np.append(toxicity.L2 * w, 0.0))
        w, b = w - d[:-1], b - d[-1]
    rows = [toxicity.text_features(t) for t in texts]
    model = toxicity._fit_margin(rows, y.astype(float), toxicity.L2)
    got = np.array([toxicity.margin(r, *model) for r in rows])
    assert np.abs(got - (z @ w + b)).max() < 0.02 * np.abs(got).max()
    dense = np.zeros(toxicity.BUCKETS, np.float32)
    dense[model[0]] = model[1]
    for size in (20, 10**6):
        monkeypatch.setattr(toxicity, "POINTS_AT_ONCE", size)
        assert np.allclose(toxicity.margins(texts, dense, model[2]), got, atol=1e-4)


def test_toxicity_defined_cases(spark):
    bad, fine = "you awful nasty creature go away now", "a calm walk along the quiet river bank"
    rows = [(i, bad if i % 2 else fine) for i in range(60)] + [(100, None), (101, ""), (102, f"{bad} " * 20000), (103, fine), (103, fine), (None, bad)]
    df = spark.createDataFrame([(*r, 7.5) for r in rows], "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (55, None), (102, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(df, labels)
    assert got.columns == df.columns
    got = {(r["doc_id"], r["text"] and r["text"][:40]): r["score"] for r in got.collect()}
    assert got[102, f"{bad} {bad}"[:40]] > 0.7 and got[None, bad[:40]] > 0.7 and got[103, fine[:40]] < 0.3 and got[100, None] == got[101, ""]
    assert all((v > 0.5) == (t == bad[:40]) for (i, t), v in got.items() if i is not None and i < 60)


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize(("sizes", "order"), [(None, 3), ((6, 3, 4), 3), ((6, 3, 4), 2), ((9, 40, 200), 3), ((9, 40, 200), 4)])
def test_backoff_lm(spark, empty, monkeypatch, sizes, order, parts):
    if sizes:
        for name, v in zip(("COMMON", "HOT", "SAMPLE_DOCS"), sizes, strict=True):
            monkeypatch.setattr(backoff_lm, name, v)
        monkeypatch.setattr(backoff_lm, "WORD_SAMPLE_DOCS", sizes[2])
        monkeypatch.setattr(backoff_lm, "BLOCK_DOCS", 7)
    rows = ROWS + BLANKS
    got = backoff_lm.log_scores(spark.createDataFrame(rows, SCHEMA).repartition(parts), order=order).collect()
    null = lambda x: -1 if x is None else x
    want = sorted((null(i), *x) for (i, *_), x in zip(rows, brute_backoff([r[1] for r in rows], order), strict=True))
    have = sorted((null(r["doc_id"]), r["n_words"], r["log_score"]) for r in got)
    assert np.allclose(have, want, atol=1e-6)
    if parts == 1:
        assert backoff_lm.log_scores(empty, order=order).count() == 0


def test_backoff_lm_counts_a_partition_in_slices(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "SLICE", 50)
    want = sorted((i, *x) for i, x in enumerate(brute_backoff([r[1] for r in ROWS], 3)))
    df = spark.createDataFrame([(i, r[1], "en", "x") for i, r in enumerate(ROWS)], SCHEMA)
    assert np.allclose(sorted((r["doc_id"], r["n_words"], r["log_score"]) for r in backoff_lm.log_scores(df).collect()), want, atol=1e-6)
    columns = [(np.arange(2000, dtype=np.uint64) % np.uint64(301)) | backoff_lm.RARE for _ in range(3)]
    turns = list(backoff_lm.slices(columns, backoff_lm.Routes(np.zeros(1, np.uint64), np.zeros(0, np.uint64)), 50))
    assert max(map(len, turns)) < 200 and sorted(np.concatenate(turns).tolist()) == list(range(2000))


def brute_classes(texts):
    sets = wm.shingles(pa.array(texts, pa.string()))
    df = Counter(h for s, _ in sets for h in s.tolist())
    common = [(h, n) for h, n in df.items() if n > wm.F0 * len(texts)]
    w = wm.Weights(np.array([h for h, _ in common], np.uint64), np.array([n for _, n in common], float), len(texts))
    sets = [(h, w.of(h, n)) for h, n in sets]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if group[i] != group[j] and (same or len(sets[i][0]) and wm.similarity(*sets[i], *sets[j]) >= wm.SIMILAR):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = [(i, t, "en", "x") for i, t, *_ in ROWS if i is not None]
    for g in range(12):
        base = rng.choice(vocabulary, 120).tolist()
        shared = rng.choice(vocabulary, 40).tolist()
        for k in range(int(rng.integers(1, 14))):
            own = list(base)
            for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
                own[at] = f"n{rng.integers(10**6)}"
            rows.append((100 * (g + 1) + k, " ".join(own + (shared if g % 2 else [])), "en", "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = wm.near_duplicates(df).collect()
    group = brute_classes([r[1] for r in rows])
    least = {}
    for g, r in zip(group, rows, strict=True):
        least[g] = min(least.get(g, 10**9), r[0])
    want = {r[0]: least[g] for g, r in zip(group, rows, strict=True)}
    assert {r["doc_id"]: r["class_id"] for r in got} == want and len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(set(group))
    kept = wm.near_dedup(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert len(wm.near_duplicates(docs).collect()) == len(ROWS)
    assert wm.near_duplicates(empty).count() == 0


def test_near_copies_in_hot_groups(spark):
    rng, rows, last = np.random.default_rng(8), [], {}
    for g, n in enumerate((100, 117, 134)):  # 5-word Jaccard similarities of 0.818, 0.843 and 0.861
        base = [f"g{g}w{i}" for i in range(n + 4)]
        near = list(base)
        near[30], near[60] = "x", "y"
        for k in range(90):  # each group holds 30 % of the rows
            rows.append((len(rows), " ".join(near if k < 20 else base), "en", "x"))
            last.setdefault(g, len(rows) - 1)
    rows += [(len(rows) + k, " ".join(f"u{w}" for w in rng.integers(10**9, size=50)), "en", "x") for k in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in wm.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: last[i // 90] if i < 270 else i for i, *_ in rows}


def test_every_shingle_has_its_own_idf(spark):
    base = [f"w{i}" for i in range(104)]
    near = [{30: "x", 60: "y"}.get(i, w) for i, w in enumerate(base)]  # 5-word Jaccard similarity of 0.818
    texts = [" ".join(base), " ".join(near), *(" ".join(base + [f"o{g}w{i}" for i in range(400)]) for g in range(2))]
    texts += [" ".join(f"u{g}w{i}" for i in range(40)) for g in range(41)]
    # The shared shingles lie in 4 of 45 texts, less than a tenth: by their idf the pair comes to 0.793.
    got = {r["doc_id"]: r["class_id"] for r in wm.near_duplicates(spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == {i: i for i in range(45)}

    sets = [h for h, _ in wm.shingles(pa.array(texts))]
    want, ranges = Counter(h for s in sets for h in s.tolist()), wm.Ranges(3)
    told = wm.texts_with(spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "batch long, text string"), ranges).toArrow()
    for b in range(7):
        h = np.unique(np.concatenate(sets[b::7]))
        w = wm.weights_of(h, told.filter(pa.compute.equal(told["batch"], b)), ranges, len(texts))
        hit, held = w.held(h)
        assert dict(zip(h[hit].tolist(), held.tolist(), strict=True)) == {x: want[x] for x in h.tolist() if want[x] > 1}


def test_late_blocks_find_links_that_pivots_miss(spark, monkeypatch):
    rows, sets, prints = [], [], np.zeros((6, wm.SAMPLES), np.uint16)
    prints[1:4] = 7  # nodes 1 and 2 are similar, node 3 only looks so
    prints[4:] = np.arange(2 * wm.SAMPLES, dtype=np.uint16).reshape(2, -1) + 9
    for i in range(6):
        h = np.arange(10) + (100 if i == 3 else 0) + (i == 2)
        rows.append((1, i, i, bytearray(prints[i].tobytes())))
        sets.append((i, bytearray(h.astype("<u8").tobytes()), bytearray(np.ones(10, "<f4").tobytes())))
    df = spark.createDataFrame(rows, "key long, node long, label long, prints binary")
    kept = spark.createDataFrame(sets, "node long, h binary, w binary")
    members = spark.createDataFrame([(1, 6)], "key long, n long")
    for block in (512, 2):
        monkeypatch.setattr(wm, "BLOCK", block)
        assert [(r["a"], r["b"]) for r in wm.compare_blocks(df, members, kept).collect()] == [(1, 2)]


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    a, b = (h[:300], rng.integers(1, 4, 300).astype(float)), (h[60:], rng.integers(1, 4, 340).astype(float))
    sims = []
    for k in range(60):
        shift = np.uint64(k * 0x9E3779B9)
        x = wm.sample([(a[0] ^ shift, a[1]), (b[0] ^ shift, b[1])])
        sims.append((x[0] == x[1]).mean())
    assert abs(np.mean(sims) - wm.similarity(*a, *b)) < 0.02


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup.duplicate_groups(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[t or ""].append(-1 if i is None else i)
    assert len(got) == len(ROWS)
    want = Counter()
    for t, ids in groups.items():
        for i in ids:
            want[i, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    null = lambda x: -1 if x is None else x
    assert Counter((null(r["doc_id"]), null(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and Counter(r["text"] or "" for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("limit", [1, 4])
def test_exact_dedup_in_rounds(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "ROUND_ROWS", limit)
    test_exact_dedup(spark, docs, docs.limit(0))


def test_exact_dedup_is_native_and_leaves_unique_texts_in_place(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExternalRDD"))
    once = plan.split("Union")[1].split("SortAggregate")[0]  # the branch of rows that pass: broadcasts only
    assert "BroadcastHashJoin" in once and "hashpartitioning" not in once.split("FileScan")[0]
    assert not any(w in exact_dedup.duplicate_groups(docs)._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))


CLASHES = ("digest", "Digest_", "own_id", "kept_id", "kept_digest", "turn", "maybe", "cell0", "bucket0", "MAP0", "_xd_digest", "_bf_map0", "_nd_digest",
           "m", "s", "doc", "cut", "label", "lo", "hi", "junk", "_q_m", "quality", "verdict", "score", "_tox_score", "tag", "node", "key", "a.b c")


def test_clashing_names_pass_through(spark, sf, tmp_path):
    import corpus_pipeline

    rows = [(i, f"{WORDS[i % 3]} {WORDS[i % 5]} number {i // 2} " + " ".join(f"w{i // 2}x{k}" for k in range(12)), "en", "x", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHES)).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    own = lambda r: all(r[c] == f"mine {c}" for c in CLASHES)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (exact_dedup.exact_dedup, wm.near_dedup, *(lambda d, f=f: f(spark, d, str(tmp_path)) for _, f in corpus_pipeline.STAGES[:4])):
        out = stage(df)
        got = out.collect()
        assert out.columns == df.columns and all(map(own, got)) and 0 < len(got) <= 40
    judged = quality.quality_verdicts(df, labels, out="Score")
    assert [c for c in judged.columns if c != "Score"] == [c for c in df.columns if c != "score"]
    assert {r["Score"]["kept"] for r in judged.collect()} == {True}
    tokens = df.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("ids", "shard", "place", "start", "words", "tie")))
    assert packing.packed_pieces(tokens, queries.word_bpe()).select("doc_id").distinct().count() == 40
    assert binary_ids.read_ids(binary_ids.write_ids(tokens, queries.word_bpe())).count() == 40
    assert len(backoff_lm.log_scores(tokens.withColumn("p", F.lit("x")).withColumn("base", F.lit("y"))).collect()) == 40


def test_pipeline_on_nothing(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"w{i}" for i in range(60000))), (3, " ".join(f"w{i}" for i in range(60000)))], "doc_id long, text string")
    odd = odd.select("doc_id", "text", *(F.lit(None).cast("string").alias(c) for c in ("lang", "source")), F.lit(None).cast("long").alias("n_chars"))
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/odd/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in got} == {3} and sum(r["length"] for r in got) == got[0]["doc_tokens"]


def test_repeat_filter_has_no_false_negatives(spark):
    df = spark.range(20_000).select(F.unhex(F.sha2((F.col("id") % 15_000).cast("string").cast("binary"), 256)).alias("digest"))
    bits = 1 << 18
    bitmaps = exact_dedup.repeat_filter(df, "digest", bits)
    flagged = exact_dedup.probe(df, "digest", bitmaps, bits, "maybe").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.bool_and("maybe").alias("m"))
    assert flagged.filter("n > 1 AND NOT m").isEmpty()
    assert flagged.filter("n = 1 AND m").count() < 1500


def test_html(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    model = html_extract.train(pages)
    word = "This is a sentence of the main article, and it is long enough. "
    page = f"""<html><body><nav class="menu"><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p>
<button>OK</button></div><article><h1>Title &amp; more</h1><p>{word * 3}<br>next&nbsp;line<p>{word * 5}<script>var x = "</p>";</script></article>
<section class="comments"><div class="comment"><p>{word}</p></div></section><footer><p>&copy; site</p></footer></body>"""
    text = html_extract.main_texts([page], model)[0]
    assert text.split("\n\n") == ["Title & more", (word * 3).strip() + " next line", (word * 5).strip()]
    odd = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", "<<<>>&#x;</b></div>"), (5, "u", "<div " + "a" * 50_000)]
    out = html_extract.extract_main_text(spark.createDataFrame(odd, "page_id long, url string, html string"), model).collect()
    assert len(out) == 5 and out[0]["text"] == out[1]["text"] == ""
    assert html_extract.extract_main_text(pages.limit(0), model).count() == 0
    assert html_extract.train(pages.limit(0)) is None
    nodes, _ = html_extract.read_page(page)
    keep = html_extract.decode(nodes, np.random.default_rng(1).random(len(nodes)))
    assert all(keep[n.parent] for n, k in zip(nodes, keep, strict=True) if k and n.parent >= 0)


def test_decode_against_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 11))
        nodes = [html_extract.Node("html", -1, 0)]
        for i in range(1, n):
            nodes.append(html_extract.Node(["div", "body", "p"][int(rng.integers(3))], int(rng.integers(i)), 1))
        p = rng.random(n) * 0.98 + 0.01

        def worth(keep):
            total = 0.0
            for i, x in enumerate(nodes):
                if keep[i] and x.parent >= 0 and not keep[x.parent]:
                    return -math.inf
                total += math.log(p[i] if keep[i] else 1 - p[i])
                total += html_extract.COHESION * (keep[i] and x.parent >= 0 and nodes[x.parent].tag not in ("html", "body"))
            return total

        best = max(worth([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(worth(html_extract.decode(nodes, p).astype(int).tolist()) - best) < 1e-9


def test_flat_trees_give_what_the_model_gives(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    x = rng.random((400, 5))
    df = spark.createDataFrame([(r.tolist(), float(r[0] + r[1] * r[2] > 0.7)) for r in x], "x array<double>, label double")
    model = GBTClassifier(maxIter=6, maxDepth=html_extract.DEPTH, seed=1).fit(df.select(array_to_vector("x").alias("features"), "label"))
    want = [r["probability"][1] for r in model.transform(df.select(array_to_vector("x").alias("features"))).collect()]
    got = html_extract.probability(([html_extract.flatten(t) for t in model.trees], list(model.treeWeights)), x)
    assert np.allclose(got, want)


@pytest.mark.parametrize("tag", ["math", "svg", "object", "select", "template", "noscript"])
def test_html_keeps_what_follows_an_open_element(spark, sf, tag):
    model = html_extract.train(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"))
    word = "This is a sentence of the main article, and it is long enough. "
    for end in ("", f"</{tag}>"):
        page = f"<html><body><article><h1>Title</h1><p>{word * 3}where <{tag}>a = b{end}, so.</p><p>{word * 5}</p></article></body></html>"
        want = ["Title", word * 3 + "where a = b, so.", (word * 5).strip()]
        assert html_extract.main_texts([page], None)[0].split("\n\n") == want
        got = html_extract.main_texts([page], model)[0].split("\n\n")
        assert got[0] == want[0] and got[1].startswith(word * 3 + "where") and got[2] == want[2]
    alone = f"<body><article><p>{word * 3}</p><{tag}><p>{word * 4}</p><p>{word * 5}</p></article></body>"
    assert html_extract.main_texts([alone], None)[0].split("\n\n") == [(word * k).strip() for k in (3, 4, 5)]


def test_pages_give_their_articles(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op10_html_extract(spark, sf).collect()}
    right = 0
    for i, source in pages.items():
        body = re.search(r"<article>(.*)</article>", source, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        right += got[i] == "\n\n".join(p for p in parts if p)
    assert right >= 0.97 * len(pages)


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    texts = [r["text"] or "" for r in docs.collect()]
    assert len(set(texts)) == len(texts) == len(set(brute_classes(texts)))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.agg(F.sum("length")).collect()[0][0] == sum(len(true_ids(t)) for t in texts)
