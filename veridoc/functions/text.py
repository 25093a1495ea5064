"""Scalar text functions, Column to Column, for matching and search.  Null counts as empty unless said otherwise."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import fixed_values as V
from .origins import locate_verbatim, normalize_with_map  # noqa: F401

NOT_WORD = r"[^\p{L}\p{N}_]+"
ELLIPSIS = r"\.\.\.|…"
ARABIC_BLOCKS = "[\u0600-\u06ff\ufdf0-\ufdff]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def expand_ligatures(c: str | Column) -> Column:
    """Honorific ligatures spelled out."""
    return reduce(lambda e, kv: F.replace(e, F.lit(kv[0]), F.lit(kv[1])), V.LIGATURES.items(), _col(c))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no built-in for it.  Use it once, at ingest."""
    return texts.str.normalize("NFKC")


def strip_diacritics(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), V.DIACRITICS + "|ـ", "")


def fold_letters(c: str | Column) -> Column:
    return F.translate(_col(c), V.FOLD_FROM, V.FOLD_TO)


def fold_digits(c: str | Column) -> Column:
    return F.translate(_col(c), V.DIGITS_FROM, V.DIGITS_TO)


def normalize(c: str | Column, compose: bool = False) -> Column:
    """Text for matching: folded letters and digits, lower case, punctuation to single spaces.

    ``compose`` adds compatibility composition, which leaves the JVM; skip it where the corpus was composed at ingest.
    """
    text = F.coalesce(_col(c), F.lit(""))
    text = nfkc(expand_ligatures(text)) if compose else text
    # Letters to fold, marks and ligatures are all of these two blocks, which most texts do not touch.
    folded = bind(text, lambda t: F.when(t.rlike(ARABIC_BLOCKS), fold_digits(fold_letters(strip_diacritics(expand_ligatures(t))))).otherwise(t))
    return F.trim(F.regexp_replace(F.lower(folded), NOT_WORD, " "))


def tokens(c: str | Column, compose: bool = False) -> Column:
    return F.filter(F.split(normalize(c, compose), " "), lambda t: t != "")


def is_stopword(token: Column) -> Column:
    attached = (F.length(token) > 2) & F.substring(token, 1, 1).isin(*V.CLITICS)
    return token.isin(*V.STOPWORDS) | (attached & F.substring(token, 2, 1000).isin(*V.STOPWORDS))


def english_stem(token: Column) -> Column:
    """Drops the first of ing, ed, es, s that leaves three letters."""
    return F.regexp_replace(token, r"^(.{3,}?)(?:ing|ed|es|s)$", "$1")


def light_stem(token: Column) -> Column:
    """Arabic: one conjunction, one article prefix, then every suffix in turn; other scripts: English."""
    t = F.regexp_replace(token, r"^و(?=.{3,}$)", "")
    t = F.regexp_replace(t, f"^(?:{'|'.join(V.PREFIXES)})(?=.{{2,}}$)", "")
    t = reduce(lambda e, s: F.regexp_replace(e, f"^(.{{2,}}){s}$", "$1"), V.SUFFIXES, t)
    return F.when(token.rlike("[ء-ي]"), t).otherwise(english_stem(token))


def stem_words(text: Column) -> Column:
    """``light_stem`` of every word of a text whose words stand between single blanks: each rule runs once over the text."""
    start, end = "(?<![^ ])", "(?![^ ])"

    def arabic(t: Column) -> Column:
        t = F.regexp_replace(t, f"{start}([^ ء-ي]{{3,}}?)(?:ing|ed|es|s){end}", "$1")
        t = F.regexp_replace(t, f"{start}و(?=[^ ]{{3}})", "")
        t = F.regexp_replace(t, f"{start}(?:{'|'.join(V.PREFIXES)})(?=[^ ]{{2}})", "")
        return reduce(lambda e, s: F.regexp_replace(e, f"(?<=[^ ]{{2}}){s}{end}", ""), V.SUFFIXES, t)

    other = lambda t: F.regexp_replace(t, f"(?=[ies])(?<=[^ ]{{3}})(?:ing|ed|es|s){end}", "")
    return bind(text, lambda t: F.when(t.rlike("[ء-ي]"), arabic(t)).otherwise(other(t)))


def stems(c: str | Column, drop_noise: bool = False, compose: bool = False) -> Column:
    """Stems of the content tokens, in order, with repeats."""
    def keep(t: Column) -> Column:
        fine = (F.length(t) >= 2) & ~is_stopword(t)
        return fine & ~t.isin(*V.QUERY_NOISE) if drop_noise else fine

    words = F.array_join(F.filter(F.split(normalize(c, compose), " "), keep), " ")
    return F.filter(F.split(stem_words(words), " "), lambda t: F.length(t) >= 2)


def all_stems(c: str | Column, compose: bool = False) -> Column:
    """Stems of all tokens, stop-words too."""
    return F.filter(F.split(stem_words(normalize(c, compose)), " "), lambda t: t != "")


def content_terms(c: str | Column, drop_noise: bool = False, compose: bool = False) -> Column:
    """Distinct stems in the order first seen."""
    return F.array_distinct(stems(c, drop_noise, compose))


def search_text(c: str | Column, compose: bool = False) -> Column:
    return F.array_join(stems(c, compose=compose), " ")


def split_sentences(c: str | Column, min_chars: int = 25) -> Column:
    """Sentences; one shorter than ``min_chars`` joins the next, a short last one the one before."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), r"(?<=[.!?؟])\s+|\n+")
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    empty = F.array().cast(ArrayType(StringType()))

    def step(acc: Column, part: Column) -> Column:
        held = F.when(acc["held"] == "", part).otherwise(F.concat_ws(" ", acc["held"], part))
        full = F.length(held) >= min_chars
        done = F.when(full, F.array_append(acc["done"], held)).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, F.lit("")).otherwise(held).alias("held"))

    def finish(acc: Column) -> Column:
        done, held, n = acc["done"], acc["held"], F.size(acc["done"])
        joined = F.concat(F.slice(done, F.lit(1), n - 1), F.array(F.concat_ws(" ", F.element_at(done, -1), held)))
        return F.when(held == "", done).when(n == 0, F.array(held)).otherwise(joined)

    return F.aggregate(parts, F.struct(empty.alias("done"), F.lit("").alias("held")), step, finish)


def script_ratio(c: str | Column) -> Column:
    """Shares of Arabic and Latin letters among both; zeros without letters."""
    arabic = F.regexp_count(_col(c), F.lit("[ء-ي]"))
    latin = F.regexp_count(_col(c), F.lit("[A-Za-z]"))
    total = F.nullif(arabic + latin, F.lit(0))
    return F.struct(
        F.coalesce(arabic / total, F.lit(0.0)).alias("arabic"), F.coalesce(latin / total, F.lit(0.0)).alias("latin")
    )


def detect_language(c: str | Column, default: str | Column = "ar") -> Column:
    """Language by script, then by letters of one language, then by the interface's language."""
    text = _col(c)
    default = F.lit(default) if isinstance(default, str) else default
    many = lambda script: F.regexp_count(text, F.lit(script)) > F.floor(F.length(text) / 4)
    share = script_ratio(text)
    return (
        F.when(many("[ऀ-ॿ]"), "hi")
        .when(many("[ঀ-৿]"), "bn")
        .when(many("[Ѐ-ӿ]"), F.when(default == "uz", "uz").otherwise("kk"))
        .when((share["arabic"] == 0) & (share["latin"] == 0), default)
        .when(share["arabic"] >= share["latin"], F.when(text.rlike(V.URDU), "ur").otherwise("ar"))
        .when(text.rlike(V.TURKISH), "tr")
        .when(text.rlike(V.HAUSA), "ha")
        .when(default.isin(*V.LATIN_INTERFACES), default)
        .otherwise("en")
    )


def contains_normalized(haystack: Column, needle: Column) -> Column:
    n = normalize(needle)
    return (n != "") & (F.instr(normalize(haystack), n) > 0)


def clean_text(c: str | Column) -> Column:
    """No-break spaces to spaces, direction marks dropped, runs of blanks to one, trimmed."""
    text = F.regexp_replace(F.translate(_col(c), " ", " "), "[‎‏]", "")
    return F.trim(F.regexp_replace(text, "[ \\t]+", " "))


def flat(c: str | Column) -> Column:
    """All white space to single spaces."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def redact_secrets(c: str | Column) -> Column:
    secret = r"(?i)(sk-[A-Za-z0-9_-]{6,}|bearer\s+[A-Za-z0-9._-]+|x-api-key:\s*\S+)"
    return F.regexp_replace(_col(c), secret, "[REDACTED]")


def hash_identifier(c: str | Column, salt: str, chars: int = 32) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), _col(c)), 256), 1, chars)


def answer_part(content: Column, question: Column) -> Column:
    """The content without the question it starts with."""
    starts = (F.coalesce(question, F.lit("")) != "") & F.startswith(content, question)
    return F.when(starts, F.trim(F.substring(content, F.length(question) + 1, F.length(content)))).otherwise(content)


def sanitize(c: str | Column) -> Column:
    return F.translate(_col(c), "<>", "‹›")


def quote_segments(c: str | Column) -> Column:
    """Normalized parts of a quotation between ellipses."""
    return F.filter(F.transform(F.split(_col(c), ELLIPSIS), lambda s: normalize(s)), lambda s: s != "")


def term_overlap(terms: Column, sentence_stems: Column) -> Column:
    """Share of terms equal to a stem or, from three letters on, contained in one."""
    hit = lambda t: F.exists(sentence_stems, lambda s: (s == t) | ((F.length(t) >= 3) & F.contains(s, t)))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(F.filter(terms, hit)) / F.size(terms))


def coverage(terms: Column, text_terms: Column) -> Column:
    """Share of distinct terms present; 0 without terms."""
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(terms, text_terms)) / F.size(terms))


def person_core(stem: Column) -> Column:
    """A stem without the affixes of person; at least three letters stay."""
    bare = F.regexp_replace(F.regexp_replace(stem, "^ف(?=[تين].{3,}$)", ""), "^[تينا](?=.{3,}$)", "")
    return F.regexp_replace(bare, "^(.{3,}?)(?:كم|هم|ها|وا|ك|ت|و)$", "$1")


def quotable_sentences(c: str | Column, least: int = 25) -> Column:
    """Sentences without questions of a presenter, bare citations and references; speaker labels are cut, short rests dropped."""
    aside = lambda s: s.rlike(V.DIALOGUE_QUESTION) | s.rlike(V.CITATION_ONLY) | s.rlike(V.BIBLIOGRAPHIC)
    said = F.filter(split_sentences(c, least), lambda s: ~aside(s))
    return F.filter(F.transform(said, lambda s: F.trim(F.regexp_replace(s, V.ANSWER_LABEL, ""))), lambda s: F.length(s) >= least)


def cut_long(c: str | Column, most: int = 260) -> Column:
    """Pieces of at most ``most`` characters: cut behind the last mark of the second half, else at a space, else hard."""
    piece = rf"(?s)\G\s*(?:.{{1,{most}}}\z|.{{{most // 2},{most - 1}}}[؛،;,]|.{{1,{most - 1}}} |.{{{most}}})"
    return F.filter(F.transform(F.regexp_extract_all(F.trim(_col(c)), F.lit(piece), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")


def concise(sentence: str | Column, terms: Column, most: int = 260, least: int = 25) -> Column:
    """A long sentence, or one with footnote marks, as its piece that holds most terms; the earliest of equal ones."""
    text = _col(sentence)
    parts = F.flatten(F.transform(F.split(text, V.FOOTNOTE), lambda p: cut_long(p, most)))
    pieces = F.filter(F.transform(parts, lambda p: F.rtrim(p, F.lit(" ،,؛;"))), lambda p: F.length(p) >= least)
    rated = F.transform(pieces, lambda p, k: F.struct(term_overlap(terms, all_stems(p)).alias("o"), (-k).alias("k"), p.alias("p")))
    short = (F.length(text) <= most) & ~text.rlike(V.FOOTNOTE)
    return F.when(short, text).otherwise(F.coalesce(F.array_max(rated)["p"], text))
