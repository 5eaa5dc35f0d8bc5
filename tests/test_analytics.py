"""Chart aggregates, samples, previews."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tabassay import (
    best_correlation_pair, box_plots, column_health, column_quality, column_series,
    correlation_matrix, dtype_mix, duplicate_rows, health_radar, histogram, issue_mix,
    issue_summary, null_by_column, penalty_breakdown, preview, profile_table, quality_ranking,
    reject_empty, row_completeness, row_sample, scatter_sample, stacked_null, strong_pairs,
    table_score, top_categories,
)
from tabassay.operators import rows


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(40).selectExpr(
        "id", "CAST(id * 2 + 1 AS STRING) AS twice", "-id AS minus", "7 AS one",
        "CASE WHEN id < 5 THEN id END AS few", "'x' AS word", "CASE WHEN id % 2 = 0 THEN id END AS even",
    )


def test_correlations(numbers):
    matrix = correlation_matrix(numbers)
    r = {(row["x_col"], row["y_col"]): row["r"] for row in matrix.collect()}
    assert {x for x, _ in r} == {"id", "twice", "minus", "one", "even"}  # few and word hold too little
    assert r["id", "twice"] == pytest.approx(1) and r["twice", "minus"] == pytest.approx(-1)
    assert r["id", "one"] == 0 and r["one", "one"] == 0 and r["id", "id"] == pytest.approx(1)
    assert r["even", "id"] == r["id", "even"] == pytest.approx(1)
    best = best_correlation_pair(matrix).first()
    assert abs(best["r"]) == pytest.approx(1)
    assert strong_pairs(matrix).count() == 6
    assert all(abs(p["r"]) >= 0.5 for p in strong_pairs(matrix).collect())


def test_correlation_needs_two_columns(spark):
    assert correlation_matrix(spark.range(40)).count() == 0


def test_histogram_matches_numpy(spark):
    import numpy as np

    values = [((i * 7919) % 1000) / 7.0 for i in range(1500)] + [0.1 * i for i in range(100)]
    df = spark.createDataFrame([(v, 3.0) for v in values], "v double, c double")
    got = histogram(df, profile_table(df, id_heuristic=False)).orderBy("column", "bin").collect()
    for name, data in (("v", values), ("c", [3.0] * len(values))):
        counts, edges = np.histogram(data, bins=30)
        mine = [r for r in got if r["column"] == name]
        assert [r["count"] for r in mine] == counts.tolist()
        assert [r["lower"] for r in mine] == pytest.approx(edges[:-1].tolist())


def test_box_plots_need_five_values(spark):
    df = spark.createDataFrame([(float(i), None if i > 3 else float(i)) for i in range(5)], "a double, b double")
    got = box_plots(profile_table(df)).collect()
    assert [r["column"] for r in got] == ["a"]
    assert (got[0]["min"], got[0]["q1"], got[0]["median"], got[0]["q3"], got[0]["max"]) == (0, 1, 2, 3, 4)


def test_row_completeness_counts_nan_text(spark):
    df = spark.createDataFrame([("ok", "x"), ("nan", "y"), (None, "z")], "a string, b string")
    assert {r["nulls_in_row"]: r["row_count"] for r in row_completeness(df).collect()} == {0: 1, 1: 2}
    assert row_completeness(df.where("false")).count() == 0


def test_profile_charts(retail):
    scored = column_quality(profile_table(retail))
    table = table_score(scored, duplicate_rows(retail))
    assert [r["column"] for r in null_by_column(scored).collect()][0] == "date"
    assert [(r["column"], r["score"]) for r in quality_ranking(scored).collect()] == [
        ("date", 60), ("sales", 85), ("store_id", 100), ("sku", 100)]
    summary = issue_summary(scored).first().asDict()
    assert summary == {"nulls": 1, "outliers": 0, "mixed_types": 0, "email": 0, "encoding": 0,
                       "whitespace": 0, "date_format": 0}
    assert [tuple(r) for r in issue_mix(scored).collect()] == [("Nulls", 1)]
    assert {tuple(r) for r in dtype_mix(scored).collect()} == {("Numeric", 2), ("Categorical", 2)}
    assert [tuple(r) for r in penalty_breakdown(table).collect()] == [("Nulls", 1.56)]
    assert {r["metric"]: r["score"] for r in health_radar(scored, table).collect()} == {
        "Completeness": 93.75, "Outliers": 100, "Uniqueness": 100, "Types": 100, "Cardinality": 100,
        "Deep checks": 100}
    assert [tuple(r) for r in stacked_null(scored).collect()] == [("date", 75, 25)]
    top = [tuple(r) for r in top_categories(scored).collect()]
    assert top[0] == ("date: 2024-06-01", 1) and len(top) == 6
    health = column_health(scored, "DATE").collect()
    assert [r["column"] for r in health] == ["date"]
    assert (health[0]["avg_null"], health[0]["needs_attention"], health[0]["excellent"]) == (6.25, 1, 2)


@pytest.mark.parametrize("n", [1, 7, 99, 100, 500])
def test_row_sample_has_exactly_n_rows_and_repeats_itself(spark, n):
    df = spark.range(100).selectExpr("id", "id % 3 AS g")
    ids = [r["id"] for r in row_sample(df, n, ["id"]).collect()]
    assert len(ids) == len(set(ids)) == min(n, 100)
    assert sorted(ids) == sorted(r["id"] for r in row_sample(df.repartition(3), n, ["id"]).collect())


def test_row_sample_keeps_null_keys_and_orders_only_the_last_prefix(spark):
    df = spark.sql("SELECT IF(id % 2 = 0, NULL, id) AS k, id FROM range(4)")
    assert df.count() == row_sample(df, 100, ["k"]).count() == row_sample(df, 4, ["k", "id"]).count() == 4
    big = spark.range(300_000)
    sample = row_sample(big, 200_000, ["id"])
    assert sample.count() == sample.distinct().count() == 200_000
    largest = sample.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 100_000  # no task holds the whole sample


@pytest.mark.parametrize("n", [30, 700, 1500, 2999])
def test_row_sample_of_a_hot_key_orders_a_few_rows_only(spark, monkeypatch, n):
    """A third of the rows share a key, another third are one row; the order is that of one sort over all."""
    df = spark.range(3000).selectExpr("IF(id % 3 = 2, id, id % 3) AS k", "IF(id % 3 = 1, 0, id) AS v").repartition(8)
    want = sorted(map(tuple, row_sample(df, n, ["k"]).collect()))
    monkeypatch.setattr(rows, "SORTED", 4)
    sample = row_sample(df, n, ["k"])
    assert sorted(map(tuple, sample.collect())) == want and len(want) == n
    ranked = [int(r) for r in re.findall(r"#rank#?\d* <= (\d+)", sample._jdf.queryExecution().optimizedPlan().toString())]
    assert all(r <= 4 for r in ranked)
    marks = {k: hashlib.md5(f"{k}42".encode()).hexdigest() for k, _ in want}
    every = sorted((hashlib.md5(f"{r['k']}42".encode()).hexdigest(), r["k"]) for r in df.collect())
    assert sorted((marks[k], k) for k, _ in want) == every[:n]


def test_row_sample_of_one_repeated_row(spark):
    same = spark.range(50).selectExpr("1 AS a")
    assert row_sample(same, 20).count() == 20
    with pytest.raises(ValueError):
        row_sample(same, 0)


def test_scatter(numbers):
    pairs = scatter_sample(numbers, "id", "twice", ["id"], limit=10).collect()
    assert len(pairs) == 10 and all(p["y"] == 2 * p["x"] + 1 for p in pairs)
    assert scatter_sample(numbers, "id", "few", ["id"]).count() == 5


def test_preview_and_series(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else str(i), "w") for i in range(60)], "i int, n string, w string")
    rows = preview(df, ["i"]).collect()
    assert len(rows) == 50 and (rows[0]["i"], rows[0]["n"]) == ("0", "")
    series = column_series(df, "n", ["i"], limit=3).orderBy("position").collect()
    assert [(r["number"], r["text"]) for r in series] == [(None, None), (1, None), (2, None)]
    words = column_series(df, "w", ["i"], limit=2).collect()
    assert [(r["number"], r["text"]) for r in words] == [(None, "w"), (None, "w")]


def test_reject_empty(spark):
    with pytest.raises(ValueError):
        reject_empty(spark.range(0))
    assert reject_empty(spark.range(1)).count() == 1
