from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexivec.functions import text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Việt Nam", unicodedata.normalize("NFC", "Việt Nam")),
        ("  Ð  Ã\nÂ   Việt Nam  ", "Ð Ã Â Việt Nam"),
        ("Việt Nam 🇻🇳 東京 AI研究 — مرحبا", "Việt Nam 🇻🇳 東京 AI研究 — مرحبا"),
        ("a 　b", "a b"),
        ("", ""),
        (None, None),
    ],
)
def test_normalized(spark, raw, clean):
    assert one(spark, raw, text.normalized) == clean


def test_errors(spark):
    assert one(spark, "a�b", text.text_error) == "U+FFFD replacement character is not allowed"
    assert one(spark, "hello\x00world", text.text_error) == "disallowed control character U+0000"
    assert one(spark, "a\x85b\x01", text.text_error) == "disallowed control character U+0085"
    assert one(spark, "tab\tline\n", text.text_error) is None
    assert one(spark, ["fine", None], text.first_error, "array<string>") == text.NOT_TEXT_ERROR
    assert one(spark, None, text.first_error, "array<string>") is None


def test_aliases(spark):
    got = one(spark, ["Berlin", " Berlin ", "", None, "City  of Berlin"], text.normalized_each, "array<string>")
    assert got == ["Berlin", "City of Berlin"]
    assert one(spark, None, text.normalized_each, "array<string>") == []


def test_mojibake(spark):
    assert one(spark, "FranÃ§ois", text.is_mojibake)
    assert not one(spark, "Pão Âge", text.is_mojibake)


@pytest.mark.parametrize("t, n", [("", 1), ("abcd", 1), ("abcde", 2), ("ấ" * 9, 3)])
def test_estimated_tokens(spark, t, n):
    assert one(spark, t, text.estimated_tokens) == n


@pytest.mark.parametrize(
    "t, yes",
    [
        ("capital city of the German state", True),
        ("thủ đô của bang ở Đức", False),
        ("the city", False),
        ("red green blue white", False),
        ("", False),
        (None, False),
    ],
)
def test_looks_english(spark, t, yes):
    assert one(spark, t, text.looks_english) is yes


def test_documents(spark):
    df = spark.createDataFrame(
        [("A", "b", ["c", "d"]), ("A", None, []), (None, "b", ["c"])], "label string, description string, aliases array<string>"
    )
    got = [r.d for r in df.select(text.document(F.col("label"), F.col("description"), F.col("aliases")).alias("d")).collect()]
    assert got == ["A. b. Aliases: c; d.", "A.", None]
    both = spark.createDataFrame([("E.", "V."), ("E.", None), (None, None)], "e string, v string")
    got = [r.d for r in both.select(text.index_text(F.col("e"), F.col("v")).alias("d")).collect()]
    assert got == ["English: E.\nVietnamese: V.", "English: E.", None]


def test_instruction_and_tunnel(spark):
    df = spark.createDataFrame([("t", True), ("t", False)], "t string, q boolean")
    assert [r.x for r in df.select(text.instructed(F.col("t"), F.col("q"), "I: ").alias("x")).collect()] == ["I: t", "t"]
    assert one(spark, "see https://ab-1.trycloudflare.com/x", text.tunnel_url) == "https://ab-1.trycloudflare.com"
    assert one(spark, None, text.tunnel_url) is None
