"""Cell parsing against pandas and the regular expressions of the standard library."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from limpid.functions import coerce as C
from limpid.functions.constants import CASE_FREE_PATTERNS, PATTERNS

NUMBERS = ["1", " 2 ", "-3.5", "+5", ".5", "-.5", "5.", "1e3", "1E-3", "inf", "-Infinity", "12d", "5f", "1,200", "0x10",
           "1_000", "True", "50%", "", " ", "abc", "--1", "1.2.3", "9" * 30, "1e", "٣"]
DATES = ["2024-01-05", "2024-1-5", "2024-01-05 10:30", "2024-01-05T10:30:00Z", "2024/01/05", "01/02/2024", "13/02/2024",
         "05.01.2024", "20240105", "2024-01", "2024", "2024Q1", "Jan 5, 2024", "January 5, 2024", "5 January 2024",
         "5-Jan-2024", "01/02/24", "2024-02-30", "2024-13-01", "hello", "", "12345", "99/99/2024", "May 2024x", "march",
         "3000-01-01", "1600-01-01", "01-02-2024"]
TEXTS = ["a@b.co", "a.b+c@d-e.co.uk", "a@b", "x a@b.co", "é@ü.de", "2024-01-05", "2024-01-05\n", "+44 (0)20 7946", "123-4567",
         "12", "https://x.y/z?q=1", "http://", "ftp://x", "SW1A 1AA", "sw1a1aa", "123e4567-e89b-12d3-a456-426614174000",
         "123E4567-E89B-12D3-A456-426614174000", "plain", "", "https://a b"]


def column(spark, values, *exprs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [tuple(r)[1:] for r in rows.select("i", *exprs).orderBy("i").collect()]


def test_numbers_like_pandas(spark):
    got = [r[0] for r in column(spark, NUMBERS, C.to_number(F.col("c")))]
    want = pd.to_numeric(pd.Series(NUMBERS, dtype=object), errors="coerce")
    for text, g, w in zip(NUMBERS, got, want):
        assert (g is None and pd.isna(w)) or g == pytest.approx(w), text


def test_dates_like_pandas(spark):
    got = [r[0] for r in column(spark, DATES, C.iso_date(C.to_date(F.col("c"))))]
    for text, g in zip(DATES, got):
        w = pd.to_datetime(pd.Series([text], dtype=object), errors="coerce", format="mixed")[0]
        if text in ("march",):      # a bare month depends on the clock
            continue
        if text == "2024Q1":
            assert g == "2024-01-01"
            continue
        assert g == (None if pd.isna(w) else w.strftime("%Y-%m-%d")), text


def test_clock_words_are_not_dates(spark):
    assert column(spark, ["now", "today", "12:30"], C.to_date(F.col("c"))) == [(None,)] * 3


def test_strip_like_python(spark):
    values = ["  a b ", "\ta\n", " x ", "\x1cx\x1f", "", "   ", "a​"]
    assert [r[0] for r in column(spark, values, C.strip(F.col("c")))] == [v.strip() for v in values]


@pytest.mark.parametrize("name", list(PATTERNS))
def test_patterns_cover_the_whole_cell(spark, name):
    pattern = re.compile(PATTERNS[name], re.I if name in CASE_FREE_PATTERNS else 0)
    got = [r[0] for r in column(spark, TEXTS, C.matches(F.col("c"), name))]
    assert got == [pattern.fullmatch(t) is not None for t in TEXTS]


def test_bool_words(spark):
    values = ["TRUE", " yes ", "Y", "t", "on", "1", "False", "no", "N", "f", "OFF", "0", "maybe", "", "1.0", None]
    want = [True] * 6 + [False] * 6 + [None] * 4
    assert [r[0] for r in column(spark, values, C.to_bool(F.col("c")))] == want


def test_equals_any_keeps_types_apart(spark):
    flags = column(spark, ["-999", "-999.0", "N/A", None],
                   C.equals_any(F.col("c"), [-999.0, "N/A"], "object"),
                   C.equals_any(F.col("c"), [-999.0], "object", coerce=True))
    assert flags == [(False, True), (False, True), (True, False), (False, False)]
