"""Text and personal-data functions against the literals they must give."""

import pytest
from pyspark.sql import functions as F

from veridoc.functions import pii, text


def value(spark, column, **cols):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()) or [F.lit(1)])
    return row.select(column.alias("out")).collect()[0]["out"]


@pytest.mark.parametrize(
    "source, expected",
    [("الصَّلاةُ", "الصلاه"), ("إِلى أحمد آدم", "الي احمد ادم"), ("مُسْتَشْفَى", "مستشفي"), (None, ""), ("", ""), ("A-b_c  D!", "a b_c d")],
)
def test_normalize(spark, source, expected):
    assert value(spark, text.normalize(F.lit(source).cast("string"))) == expected
    assert value(spark, text.normalize(F.lit(source).cast("string"), compose=True)) == expected


def test_ligature(spark):
    assert "صلي الله عليه وسلم" in value(spark, text.normalize(F.lit("النبي ﷺ")))


def test_stems(spark):
    assert value(spark, text.light_stem(text.normalize(F.lit("والمسافرين")))) == "مسافر"
    assert value(spark, text.light_stem(text.normalize(F.lit("بالصلاة")))) == value(spark, text.light_stem(text.normalize(F.lit("الصلاة"))))
    assert value(spark, text.content_terms(F.lit("ما حكم قصر الصلاة للمسافر؟"), drop_noise=True)) == ["قصر", "صلا", "مسافر"]
    assert value(spark, text.search_text(F.lit("قصر الصلاة للمسافر"))) == "قصر صلا مسافر"
    assert value(spark, text.english_stem(F.lit("boxes"))) == "box"


def test_sentences(spark):
    cut = value(spark, text.split_sentences(F.lit("Short. This one is certainly long enough. End.")))
    assert cut == ["Short. This one is certainly long enough. End."]
    assert value(spark, text.split_sentences(F.lit(""))) == []


@pytest.mark.parametrize(
    "source, default, expected",
    [("ما حكم الصلاة", "en", "ar"), ("what is this", "ar", "en"), ("bu nedir şimdi", "ar", "tr"), ("apa ini", "id", "id"), ("123", "ar", "ar"),
     ("नमस्ते दुनिया", "ar", "hi"), ("Привет мир", "ar", "kk"), ("Привет мир", "uz", "uz")],
)
def test_language(spark, source, default, expected):
    assert value(spark, text.detect_language(F.lit(source), default)) == expected


@pytest.mark.parametrize(
    "source, types",
    [("جوالي 0551234567 وبريدي test.user@example.com وهويتي 1012345678", {"phone", "email", "national_id"}),
     ("رقمي ٠٥٥١٢٣٤٥٦٧", {"phone"}), ("my name is John Smith, call +44 7911 123456", {"name", "phone"}), ("no data here", set())],
)
def test_redact(spark, source, types):
    got = value(spark, pii.redact(F.lit(source)))
    assert set(got["types"]) == types
    if not types:
        assert got["text"] == source


def test_sentences_are_trimmed_whatever_their_place(spark):
    told = "0 is where this counting begins.  1 follows it after a while here.   2 comes at the very end of all."
    row = spark.createDataFrame([(told,)], "t string").select(text.split_sentences("t").alias("s")).first()
    assert row["s"] == ["0 is where this counting begins.", "1 follows it after a while here.", "2 comes at the very end of all."]
