"""Profiles and scores against hand-derived values."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabassay import (
    column_quality, column_scores, duplicate_rows, effective_score, profile_table, table_score,
)
from tabassay.plans import frequency
from tabassay.plans.slices import Slicing


def by_column(profile):
    return {r["column"]: r for r in profile.collect()}


def test_retail_profile(retail):
    p = by_column(profile_table(retail, order_by=["store_id"]))
    assert [p[c]["null_pct"] for c in ("store_id", "date", "sku", "sales")] == [0, 25, 0, 0]
    assert {c: r["dtype"] for c, r in p.items()} == {
        "store_id": "numeric", "date": "categorical", "sku": "categorical", "sales": "numeric"}
    sales = p["sales"]
    assert (sales["q1"], sales["median"], sales["q3"]) == (73.75, 125, 162.5)
    assert (sales["outlier_count"], sales["negative_count"], sales["negative_pct"]) == (0, 1, 25)
    assert sales["mean"] == pytest.approx(111.25)
    assert sales["std"] == pytest.approx(statistics.stdev([100, 200, 150, -5]))
    assert p["date"]["date_format_count"] == 1
    assert [tuple(t) for t in p["sku"]["top_values"]] == [("A", 1), ("B", 1), ("C", 1), ("D", 1)]


def test_retail_scores(retail):
    scored = column_quality(profile_table(retail))
    rows = by_column(scored)
    assert {c: r["quality_score"] for c, r in rows.items()} == {
        "store_id": 100, "date": 60, "sku": 100, "sales": 85}
    assert rows["date"]["issues"] == ["25.0% null values", "Likely date column parsed as string"]
    assert rows["date"]["recommendations"] == [
        "Column `date` is 25.0% null — impute with mode",
        "Column `date` appears to contain dates — cast to DATE type"]
    assert rows["sales"]["issues"] == ["1 negative value(s) (25.0%)"]
    table = table_score(scored, duplicate_rows(retail)).first()
    assert table["overall"] == pytest.approx(98.4375)
    assert table["level"] == "Excellent"
    assert table["nulls"] == pytest.approx(1.5625)
    assert column_scores(scored).first()["column_scores"]["date"] == 60


def test_survey_scores(survey):
    scored = column_quality(profile_table(survey))
    rows = by_column(scored)
    assert [rows[c]["dtype"] for c in ("respondent_id", "q1", "q2", "q3")] == [
        "categorical", "numeric", "categorical", "numeric"]
    assert [rows[c]["quality_score"] for c in ("respondent_id", "q1", "q2", "q3")] == [100, 76, 70, 76]
    table = table_score(scored, duplicate_rows(survey))
    assert table.first()["overall"] == pytest.approx(75)
    assert (table.first()["nulls"], table.first()["duplicates"]) == (5, 20)
    assert effective_score(table).first()["level"] == "Good"


def test_a_table_without_rows_still_has_columns(spark):
    empty = spark.createDataFrame([], "a string, b double")
    p = by_column(profile_table(empty))
    assert set(p) == {"a", "b"}
    assert p["a"]["total_count"] == 0 and p["a"]["dtype"] == "numeric"
    table = table_score(column_quality(profile_table(empty)), duplicate_rows(empty)).first()
    assert table["overall"] == 90  # both columns count as low-cardinality numbers


def test_identifier_columns_lose_their_numbers(spark):
    rows = spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS t", "id % 7 AS few")
    p = by_column(profile_table(rows))
    assert [p[c]["dtype"] for c in ("id", "t", "few")] == ["categorical", "categorical", "numeric"]
    free = by_column(profile_table(rows, id_heuristic=False))
    assert free["id"]["dtype"] == "numeric" and free["id"]["median"] == 499.5


def test_half_empty_numbers_are_categorical(spark):
    rows = spark.createDataFrame([(str(i) if i % 10 < 6 else None,) for i in range(40)], "a string")
    p = by_column(profile_table(rows))["a"]
    assert (p["dtype"], p["mean"], p["null_pct"], p["mixed_type_pct"]) == ("categorical", None, 40, 0)


def test_mixed_types(spark):
    numeric = [str(i % 5) for i in range(18)] + ["TBD", "x"]
    text = ["a", "b", "c", "1"] * 5
    rows = spark.createDataFrame(list(zip(numeric, text)), "a string, b string")
    p = by_column(profile_table(rows))
    assert (p["a"]["dtype"], p["a"]["mixed_type_pct"]) == ("numeric", 10)
    assert (p["b"]["dtype"], p["b"]["mixed_type_pct"]) == ("categorical", 75)


def test_heads_follow_the_row_order(spark):
    rows = spark.range(300).selectExpr(
        "id", "CASE WHEN id = 250 THEN 'a@b.co' WHEN id >= 200 THEN '2024-01-01' ELSE 'text' END AS t"
    )
    head = by_column(profile_table(rows, order_by=["id"]))["t"]
    whole = by_column(profile_table(rows))["t"]
    assert (head["date_format_count"], head["invalid_email_count"]) == (0, 0)
    assert (whole["date_format_count"], whole["invalid_email_count"]) == (1, 299)


def test_a_stray_at_sign_makes_no_email_column(spark):
    """Without a row order the look is at the distinct values with the smallest MD5, whatever the size."""
    texts = sorted((f"text {i}" for i in range(300)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    late = next(t for t in (f"a{i}@b" for i in range(9999)) if hashlib.md5(t.encode()).hexdigest() > hashlib.md5(texts[10].encode()).hexdigest())
    early = next(t for t in (f"a{i}@b" for i in range(9999)) if hashlib.md5(t.encode()).hexdigest() < hashlib.md5(texts[0].encode()).hexdigest())
    for stray, found in ((late, 0), (early, 301)):
        rows = spark.createDataFrame([(t,) for t in [*texts, stray]], "t string")
        assert by_column(profile_table(rows))["t"]["invalid_email_count"] == found


def test_heads_follow_the_row_order_in_segments(spark):
    rows = spark.range(600).selectExpr(
        "id", "IF(id % 2 = 0, 'even', NULL) AS part",
        "CASE WHEN id IN (2, 599) THEN 'a@b.co' ELSE 'text' END AS t", "'2024-01-01' AS day",
    )
    found = profile_table(rows, ["t", "day"], segment_by=["part"], order_by=["id"])
    got = {(r["part"], r["column"]): (r["invalid_email_count"], r["date_format_count"]) for r in found.collect()}
    assert got == {("even", "t"): (299, 0), (None, "t"): (0, 0), ("even", "day"): (0, 1), (None, "day"): (0, 1)}


def test_nan_is_missing_and_typed_columns_keep_every_digit(spark):
    rows = spark.sql("""
        SELECT double('nan') AS d, 9007199254740993L AS big, CAST('1.10' AS DECIMAL(30, 20)) AS dec,
               DATE '2024-01-02' AS day, true AS flag
        UNION ALL SELECT 1D, 9007199254740992L, CAST('1.10000000000000000001' AS DECIMAL(30, 20)),
               DATE '2024-01-03', false
    """)
    p = by_column(profile_table(rows, id_heuristic=False))
    assert p["d"]["null_count"] == 1
    assert p["big"]["unique_count"] == 2 and p["dec"]["unique_count"] == 2
    assert p["day"]["date_format_count"] == 1
    assert [tuple(t) for t in p["day"]["top_values"]] == [("2024-01-02", 1), ("2024-01-03", 1)]
    assert {t["value"] for t in p["flag"]["top_values"]} == {"true", "false"}


def test_segments_agree_with_single_profiles(spark):
    rows = spark.range(500).selectExpr(
        "CASE WHEN id % 5 < 3 THEN 'big' WHEN id % 5 = 3 THEN 'small' END AS seg",
        "CAST(id * id % 101 AS DOUBLE) AS v", "CASE WHEN id % 9 = 0 THEN NULL ELSE 'x' END AS t",
    )
    split = profile_table(rows, segment_by=["seg"])
    scored = column_quality(split)
    assert split.count() == 6
    for value in ("big", "small", None):
        one = rows.where(F.col("seg").eqNullSafe(value)).drop("seg")
        alone = {r["column"]: r.asDict() for r in profile_table(one).drop("ordinal").collect()}
        part = split.where(F.col("seg").eqNullSafe(value)).drop("seg", "ordinal").collect()
        for row in part:
            for field, got in row.asDict().items():
                expected = alone[row["column"]][field]
                assert got == (pytest.approx(expected) if isinstance(expected, float) else expected), field
    table = table_score(scored, duplicate_rows(rows, ["seg"]), ["seg"])
    assert table.count() == 3


@pytest.mark.parametrize("slicing", [
    Slicing(), Slicing(slices=64, share=4, worth=10), Slicing(slices=4, share=1000, worth=1)])
@pytest.mark.parametrize("shape", ["spread", "ties", "tails"])
def test_quantiles_do_not_depend_on_the_slices(spark, shape, slicing):
    rng = random.Random(7)
    draw = {
        "spread": lambda: rng.gauss(0, 1),
        "ties": lambda: float(rng.choice([1, 1, 1, 2, 3, 50])),
        "tails": lambda: rng.paretovariate(0.5),
    }[shape]
    values = [draw() for _ in range(20_000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    p = profile_table(rows, id_heuristic=False, slicing=slicing).first()
    expected = rows.selectExpr("percentile(v, array(0.25, 0.5, 0.75)) AS q").first()["q"]
    assert [p["q1"], p["median"], p["q3"]] == pytest.approx(expected, rel=1e-12)


def test_one_shuffle_of_values_is_planned_and_reused(retail):
    plan = profile_table(retail)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "a"), (1, None), (2, "b")], "a int, b string")
    found = duplicate_rows(rows).first()
    assert (found["total_rows"], found["duplicate_rows"], found["duplicate_pct"]) == (5, 2, 40)


LONG = "a line that is longer than what is kept of it, "


def test_long_texts_are_profiled_as_short_ones(spark):
    """Whether a text is keyed by itself or by a digest changes nothing, also among texts of one beginning."""
    values = [LONG + end for end in ("b", "a", "a", "d", "c", "é", "", "f@g", "Ã©")] + ["b", "a", None, " " * 40 + "12.5", "7" + " " * 40]
    values += [" " * 40 + "2024-01-31", "x@y.z" + " " * 40]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "half int, v string")
    for segment_by in ([], ["half"]):
        by_digest = [r.asDict(True) for r in profile_table(df, segment_by=segment_by).where("column = 'v'").orderBy(segment_by or "column").collect()]
        before, frequency.SHORT = frequency.SHORT, 10_000
        try:
            whole = [r.asDict(True) for r in profile_table(df, segment_by=segment_by).where("column = 'v'").orderBy(segment_by or "column").collect()]
        finally:
            frequency.SHORT = before
        assert by_digest == whole
    top = profile_table(df).where("column = 'v'").first()["top_values"]
    assert [t["value"] for t in top][:2] == [LONG + "a", " " * 40 + "12.5"]
