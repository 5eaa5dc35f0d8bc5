"""Drift: D against brute force, p-values, changes."""

import random

import pytest

from tabassay import (
    columns_added_removed, distribution_shifted, drift_summary, ks_statistic, schema_drift,
    type_changed,
)
from tabassay.plans.slices import Slicing


def text(spark, values):
    return spark.createDataFrame([(str(v),) for v in values], "value string")


def brute_force(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


def test_golden_pairs(spark):
    apart = distribution_shifted(text(spark, range(50)), text(spark, range(100, 150))).first()
    assert apart["statistic"] == 1 and apart["p_value"] < 0.05
    overlap = distribution_shifted(text(spark, range(80)), text(spark, range(50, 130))).first()
    assert overlap["statistic"] == 0.625


def test_same_distribution_is_not_shifted(spark):
    same = text(spark, range(60))
    assert ks_statistic(same, same).first()["statistic"] == 0
    assert distribution_shifted(same, same).count() == 0


def test_few_values_are_not_tested(spark):
    assert ks_statistic(text(spark, range(10)), text(spark, range(50))).count() == 0
    assert ks_statistic(text(spark, range(11)), text(spark, range(50))).count() == 1


@pytest.mark.parametrize("kind", ["spread", "hot"])
def test_statistic_against_brute_force(spark, kind):
    rng = random.Random(11)
    if kind == "spread":
        a, b = [rng.gauss(0, 1) for _ in range(900)], [rng.gauss(0.2, 1.3) for _ in range(700)]
    else:  # one value holds most rows
        a = [rng.choice([5.0, 5.0, 5.0, rng.random() * 10]) for _ in range(900)]
        b = [rng.choice([5.0, 5.0, rng.random() * 12]) for _ in range(700)]
    for slicing in (Slicing(), Slicing(slices=16, share=3, worth=10)):
        found = ks_statistic(text(spark, a), text(spark, b), slicing=slicing).first()
        assert (found["n_baseline"], found["n_current"]) == (900, 700)
        assert found["statistic"] == pytest.approx(brute_force(a, b), abs=1e-12)


def test_p_value_series(spark):
    import math

    found = distribution_shifted(text(spark, range(80)), text(spark, range(20, 100))).first()
    reach = found["statistic"] * math.sqrt(40)
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * reach * reach) for k in range(1, 101))
    assert found["p_value"] == pytest.approx(series)


def test_changes_and_summary(spark):
    base = spark.range(50).selectExpr("id AS a", "id AS gone", "id AS kept")
    now = spark.range(50).selectExpr("CAST(id + 100 AS STRING) AS a", "id AS kept", "id AS fresh")
    assert {tuple(r) for r in columns_added_removed(base, now).collect()} == {
        ("fresh", "added"), ("gone", "removed")}
    assert [tuple(r) for r in type_changed(base, now).collect()] == [("a", "bigint", "string")]
    drift = schema_drift(base, now)
    assert {(r["column"], r["change"]) for r in drift.collect()} == {
        ("fresh", "added"), ("gone", "removed"), ("a", "type_changed"), ("a", "distribution_shifted")}
    summary = drift_summary(drift).first()
    assert summary["summary"] == "2 breaking changes, 2 warnings"


def test_identical_tables_have_no_drift(spark):
    base = spark.range(5).selectExpr("id AS a")
    assert schema_drift(base, base).count() == 0
    assert drift_summary(schema_drift(base, base)).first()["summary"] == "0 breaking changes, 0 warnings"
