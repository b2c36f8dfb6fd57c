"""Scalar column helpers against the reference's unit-test values and derived rows."""

import pytest
from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.functions import urls as U


def one(spark, col, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(col(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,expected", [("", 0), ("one two three four", 4), ("    ", 1), ("abc", 1), ("abcdefg", 1), ("abcdefgh", 2), (None, 0)])
def test_token_estimate(spark, text, expected):
    assert one(spark, T.token_estimate, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("hello world", "hello world"),
    ("Guest favorite Guest favorite", ""),
    ("We use cookies to improve your experience.", ""),
    ("Share on Facebook Share on Twitter", ""),
    ("Home > Section > Article Home > Section > Article", ""),
    ("infoThe top stories by your preferences. Rest", "Rest"),
    ("Privacy policy  privacy policy", ""),
    ("Text. Subscribe to our newsletter today", "Text. today"),
    ("We use cookies here\nnext line", "next line"),
    ("a\n \n\n\nb\t\t c", "a\n\nb c"),
    ("", ""),
])
def test_noise_filter(spark, text, expected):
    assert one(spark, T.noise_filter, text) == expected


def test_truncation(spark):
    df = spark.createDataFrame([("X" * 150000,)], "c string")
    r = df.select(
        F.length(T.truncate_content(F.col("c"), F.lit(True), F.lit(100000))).alias("a"),
        F.length(T.truncate_content(F.col("c"), F.lit(False), F.lit(100000))).alias("b"),
        F.length(T.truncate_content(F.col("c"), F.lit(True), F.lit(5000))).alias("c5"),
        F.length(T.truncate_content(F.col("c"), F.lit(True), F.lit(0))).alias("z"),
        F.length(T.truncate_content(F.col("c"), F.lit(True), F.lit(150000))).alias("eq"),
        T.truncate_content(F.col("c"), F.lit(True), F.lit(3)).alias("s"),
    ).first()
    assert (r.a, r.b, r.c5, r.z, r.eq) == (100025, 150000, 5025, 150000, 150000)
    assert r.s == "XXX\n\n... [content truncated]"


@pytest.mark.parametrize("url,expected", [
    (None, "url must be a non-empty string"),
    ("", "url must be a non-empty string"),
    ("   ", "url cannot be empty"),
    ("ftp://invalid", "url must start with http:// or https://"),
    ("HTTP://EXAMPLE.COM", "url must start with http:// or https://"),
    ("http://", "URL is malformed: 'http://'. URL is malformed: 'http://'. Must include a valid hostname."),
    ("https:///p", "URL is malformed: 'https:///p'. URL is malformed: 'https:///p'. Must include a valid hostname."),
    ("https://?q=1", "URL is malformed: 'https://?q=1'. URL is malformed: 'https://?q=1'. Must include a valid hostname."),
    ("https://[::1/x", "URL is malformed: 'https://[::1/x'. Invalid IPv6 URL"),
    (" https://example.com ", None),
])
def test_url_validation(spark, url, expected):
    assert one(spark, U.url_error, url) == expected


def test_url_strip(spark):
    assert one(spark, U.url_clean, " https://example.com \x1c") == "https://example.com"


@pytest.mark.parametrize("url,ms", [
    ("https://example.com", 45000), ("https://example.com/a/b/c/d", 60000), ("https://example.com?a=1", 60000),
    ("https://example.com/a/b/c", 45000), ("https://example.com/a/b/c/", 60000), ("https://example.com/?", 45000),
    ("https://example.com/#a/b/c/d", 45000),
])
def test_url_budget(spark, url, ms):
    assert one(spark, U.url_budget_ms, url) == ms


def test_normalize_lines(spark):
    assert one(spark, T.normalize_lines, "  a  \n\n\n\n b \n\x1c\n c") == "a\n\nb\n\nc"
