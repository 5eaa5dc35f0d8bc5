"""Repairs."""

import pytest

from tabassay import (
    apply_fixes, fix_dedupe, fix_drop_nulls, fix_impute_median, fix_impute_mode,
    fix_strip_whitespace, profile_table, suggest_fixes,
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("100", " a ", 1.0), ("200", None, None), (None, "b", 3.0), ("x", "b", 3.0), ("x", "b", 3.0)],
        "t string, s string, d double")


def column(df, name):
    return sorted((r[name] for r in df.collect()), key=lambda v: (v is None, str(v)))


def test_drop_nulls(rows):
    assert fix_drop_nulls(rows, "t").count() == 4


def test_impute_median(rows, spark):
    assert column(fix_impute_median(rows, "t"), "t") == ["100", "150.0", "200", "x", "x"]
    typed = fix_impute_median(rows, "d")
    assert column(typed, "d") == [1, 3, 3, 3, 3] and typed.schema["d"].dataType.simpleString() == "double"
    none = spark.createDataFrame([("x",), (None,)], "t string")
    assert column(fix_impute_median(none, "t"), "t") == ["", "x"]
    many = spark.createDataFrame([(float(i),) for i in range(40_001)] + [(None,)], "d double")
    assert fix_impute_median(many, "d").where("d = 20000").count() == 2


def test_impute_mode_takes_the_smallest_of_the_most_frequent(rows, spark):
    assert column(fix_impute_mode(rows, "s"), "s") == [" a ", "b", "b", "b", "b"]
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    assert column(fix_impute_mode(tie, "s"), "s") == ["a", "a", "b"]
    void = spark.createDataFrame([(None,), (None,)], "s string")
    assert column(fix_impute_mode(void, "s"), "s") == ["", ""]


def test_strip_keeps_null(rows):
    assert column(fix_strip_whitespace(rows, "s"), "s") == ["a", "b", "b", "b", None]


def test_dedupe(rows):
    assert fix_dedupe(rows).count() == 4


def test_dedupe_keeps_rows_that_occur_once_where_they_are(spark):
    data = [(i, f"text {i % 50}", float(i % 7) or None) for i in range(400)] + [(3, "text 3", 3.0), (0, "text 0", None)] * 30
    data += [(1000, None, -0.0), (1000, None, 0.0), (None, None, None), (None, None, None), (1001, "x", float("nan")), (1001, "x", float("nan"))]
    df = spark.createDataFrame(data, "i int, `a b` string, `#h1` double").repartition(5)
    fixed = fix_dedupe(df, True)
    assert fixed.schema == df.schema
    key = lambda r: tuple(map(str, r))
    plain = lambda rows: sorted((key((i, s, 0.0 if d == 0 else d)) for i, s, d in rows))
    assert plain(fixed.collect()) == plain(df.dropDuplicates().collect())
    assert fix_dedupe(df.limit(0), True).count() == 0
    lower = spark.createDataFrame([("A",), ("a",), ("b",)], "s string").selectExpr("s COLLATE UTF8_LCASE AS s")
    assert fix_dedupe(lower, True).count() == 2
    plan = fix_dedupe(df, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "bitmap_construct_agg" in plan


def test_apply_in_order(rows):
    fixed = apply_fixes(rows, {"t": "drop_nulls", "s": "impute_mode", "d": "dedupe"})
    assert fixed.count() == 3
    # after the drop, " a " and "b" are equally frequent: the smaller one is taken
    assert column(fixed, "s") == [" a ", " a ", "b"]


def test_imputes_see_the_rows_left_by_earlier_drops(spark):
    data = [("a", 1.0, 5, None), ("b", None, 5, "x"), (None, 9.0, 7, "x"), ("b", 3.0, None, "y"), ("a", 100.0, 7, "y")]
    df = spark.createDataFrame(data, "m string, d double, i int, k string")
    fixed = apply_fixes(df, {"m": "impute_mode", "k": "drop_nulls", "d": "impute_median", "i": "impute_mode"})
    # m: a and b twice each before the drop; d: 9, 3, 100 after it; i: 7 twice after it
    assert sorted(fixed.collect()) == [("a", 9.0, 7, "x"), ("a", 100.0, 7, "y"), ("b", 3.0, 7, "y"), ("b", 9.0, 5, "x")]
    assert fixed.dtypes == df.dtypes


def test_apply_refuses_the_unknown(rows):
    with pytest.raises(ValueError, match="Unknown fix type"):
        apply_fixes(rows, {"t": "cap_outliers"})
    with pytest.raises(ValueError, match="Unknown column"):
        apply_fixes(rows, {"nope": "drop_nulls"})
    with pytest.raises(ValueError, match="No fixes"):
        apply_fixes(rows, {})


def test_suggestions(spark):
    rows = spark.createDataFrame(
        [("1", " a", None)] * 3 + [(None, "b", "x")] + [("2", "c", None)] * 4, "n string, w string, e string")
    got = {(r["column"], r["fix"]) for r in suggest_fixes(profile_table(rows)).collect()}
    assert got == {("n", "impute_median"), ("w", "strip_whitespace"), ("e", "drop_nulls")}
