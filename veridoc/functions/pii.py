"""Redaction of personal data in DataFrame functions: each found value becomes its kind in brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import _col, bind, fold_digits

#: Self-introductions and what stands for the name.
NAMES = (
    (r"((?:انا |أنا )?اسمي\s+)([ء-ي]+(?:\s+(?:بن|بنت|ابن)\s+[ء-ي]+)?(?:\s+(?!و)[ء-ي]+)?)", "$1[NAME]"),
    (r"((?:اسمه|اسمها)\s+)([ء-ي]+(?:\s+[ء-ي]+)?)", "$1[NAME]"),
    (r"((?:انا|أنا)\s+)([ء-ي]+\s+(?:بن|بنت|ابن)\s+[ء-ي]+)", "$1[NAME]"),
    (r"(?i)(\bmy name is\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", "$1[NAME]"),
)


def classify_number(raw: Column) -> Column:
    """Kind of a run of digits: phone, national_id, card_number, id_number or null."""
    digits = F.regexp_replace(raw, r"\D", "")
    n = F.length(digits)
    return (
        F.when(n < 7, F.lit(None))
        .when(digits.rlike(V.MOBILE) | raw.startswith("+"), "phone")
        .when(digits.rlike(V.NATIONAL_ID), "national_id")
        .when(n.between(13, 19) & F.call_function("luhn_check", digits), "card_number")
        .when(n >= 9, F.when(digits.rlike("^[09]"), "phone").otherwise("id_number"))
    )


def replace_with(text: Column, pattern: str, new) -> tuple[Column, Column]:
    """(text with each match m replaced by new(m), or left where that is null; the matches)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    after = F.transform(found, lambda m: F.coalesce(new(m), m))
    joined = F.zip_with(pieces, after, lambda p, a: F.concat(p, F.coalesce(a, F.lit(""))))
    return F.array_join(joined, ""), found


def _iban(m: Column) -> Column:
    return F.when(F.regexp_replace(m, " ", "").rlike(r"\d{6}"), F.lit("[IBAN]"))


#: Texts without any of these hold nothing to redact.
SIGNS = r"(?i)[0-9@]|my name is\s|اسمي|اسمه|انا\s|أنا\s"


def redact(c: str | Column) -> Column:
    """Struct of the redacted text and the kinds found, in the order e-mail, IBAN, numbers, names.  Each step is computed
    once, and only for texts that hold a sign of personal data."""
    only = lambda flag, kind: F.when(flag, F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))

    def numbers(text: Column, types: Column) -> Column:
        new, runs = replace_with(text, V.NUMBER_RUN, lambda m: F.concat(F.lit("["), F.upper(classify_number(m)), F.lit("]")))
        found = F.array_compact(F.transform(runs, classify_number))
        return F.struct(new.alias("text"), F.concat(types, found).alias("types"))

    def ibans(text: Column, types: Column) -> Column:
        new, runs = replace_with(text, "(?i)" + V.IBAN, _iban)
        return F.struct(new.alias("text"), F.concat(types, only(F.exists(runs, lambda m: _iban(m).isNotNull()), "iban")).alias("types"))

    def names(text: Column, types: Column) -> Column:
        has, new = F.lit(False), text
        for pattern, put in NAMES:
            has = has | F.regexp_like(text, F.lit(pattern))  # a name stays visible to the patterns behind it
            new = F.regexp_replace(new, pattern, put)
        return F.struct(new.alias("text"), F.array_distinct(F.concat(types, only(has, "name"))).alias("types"))

    def emails(text: Column) -> Column:
        return F.struct(F.regexp_replace(text, V.EMAIL, "[EMAIL]").alias("text"), only(F.regexp_like(text, F.lit(V.EMAIL)), "email").alias("types"))

    def steps(text: Column) -> Column:
        return bind(emails(text), lambda s: bind(ibans(s["text"], s["types"]), lambda s: bind(numbers(s["text"], s["types"]), lambda s: names(s["text"], s["types"]))))

    clean = lambda text: F.struct(text.alias("text"), F.array().cast("array<string>").alias("types"))
    return bind(fold_digits(F.coalesce(_col(c), F.lit(""))), lambda t: F.when(t.rlike(SIGNS), steps(t)).otherwise(clean(t)))


def pii_report(df: DataFrame, types: str = "types") -> DataFrame:
    """Rows holding each kind."""
    return df.select(F.explode(types).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))
