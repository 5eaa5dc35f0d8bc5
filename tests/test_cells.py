"""Cell expressions on hand-made values."""

import pytest
from pyspark.sql import types as T

from tabassay.functions import cells


def run(spark, expression, values, dtype="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {dtype}")
    found = rows.selectExpr("i", f"{expression} AS x").orderBy("i").collect()
    return [r["x"] for r in found]


def test_strip_is_unicode(spark):
    values = ["  a ", " b ", "\tc\n", "d", "", None, "\x1ce\x1f", "é f "]
    assert run(spark, cells.strip("c"), values) == [
        None if v is None else v.strip() for v in values
    ]


def test_normalize_cell_drops_the_missing_tokens(spark):
    values = ["", " NA ", "N/A", "NULL", "null", "NaN", "nan", "None", "n/a", " x ", None, "none"]
    assert run(spark, cells.normalize_cell("c"), values) == [None] * 8 + ["n/a", "x", None, "none"]


@pytest.mark.parametrize("text, number", [
    ("1", 1.0), (" -2.5 ", -2.5), ("+3.", 3.0), (".5", 0.5), ("1e3", 1000.0), ("1E-2", 0.01),
    ("inf", float("inf")), ("-Infinity", float("-inf")), ("1d", None), ("5f", None), ("0x10", None),
    ("1e400", None), ("1_000", None), ("", None), ("TBD", None), ("nan", None), ("1,5", None),
    (".", None), ("1 2", None), (None, None),
])
def test_parse_number(spark, text, number):
    assert run(spark, cells.as_number("c", T.StringType()), [text]) == [number]


def test_looks_numeric_follows_float_literals(spark):
    values = ["1", "1_000", "nan", "inf", "-1e5", " 2 ", "1__0", "_1", "1e", "x", "", "٣"]
    expected = []
    for v in values:
        try:
            float(v)
            expected.append(True)
        except ValueError:
            expected.append(False)
    assert run(spark, cells.looks_numeric(cells.strip("c")), values) == expected


def test_date_shape(spark):
    values = ["2024-01-02", "01/02/2024", "01-02-2024", "2024/01/02", "2024-01", "2024",
              "Jan 2, 2024", "5/28/2010", "20240", None]
    assert run(spark, cells.date_shape(cells.strip("c")), values) == [
        "ISO", "US", "EU", "ISO_SLASH", "YYYY-MM", "YYYY", "TEXT", None, None, None]


def test_email_fault(spark):
    values = ["a@b.co", "plain", "a@@b.co", "@b.co", "a@b", "a@b..co", "a@.co", "a@b.", " a@b.co "]
    assert run(spark, cells.email_fault(cells.strip("c")), values) == [
        "", "missing @", "multiple @ symbols", "empty local part", "domain has no dot",
        "invalid domain", "invalid domain", "invalid domain", ""]


def test_mojibake(spark):
    assert run(spark, cells.has_mojibake("c"), ["cafÃ©", "itâ€™s", "Å", "café", "plain"]) == [
        True, True, True, False, False]


def test_empty(spark):
    assert run(spark, cells.is_empty("c", T.StringType()), [None, "", "  ", " NaN ", "x"]) == [
        True, True, True, True, False]
    nan = float("nan")
    assert run(spark, cells.is_empty("c", T.DoubleType()), [1.0, None, nan], "double") == [
        False, True, True]


def test_row_digest_tells_nulls_apart(spark):
    rows = spark.createDataFrame(
        [(None, "a"), ("a", None), ("a", "~"), ("a", ""), ("1:a", "b"), ("1", ":ab")],
        "x string, y string",
    )
    for part in cells.row_digest(rows.schema):
        assert rows.selectExpr(f"{part} AS d").distinct().count() == 6
    zeros = spark.sql("SELECT 0.0D AS d UNION ALL SELECT -0.0D")
    assert zeros.selectExpr(*cells.row_digest(zeros.schema)).distinct().count() == 1
