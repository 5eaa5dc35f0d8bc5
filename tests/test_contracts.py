"""Sector profiles, dimensions and contract rules on hand-derived values."""

import pytest

from tabassay import (
    assess_contract, build_rules, column_quality, dimension_contributions, dimension_scores,
    duplicate_rows, empty_cells_per_row, evaluate_rules, profile_registry, profile_table,
    resolve_columns, row_completeness, sample_failures, weighted_score,
)
from tabassay.functions import fixed_values as fv
from tabassay.operators.contracts import Rule


def rules_for(df, sector, required=None):
    return build_rules(df.columns, sector, resolve_columns(df.columns, sector, required)[0])


def outcome(df, rules):
    return {r["rule_id"]: r for r in evaluate_rules(df, rules).collect()}


def dims(df, sector, as_of="2024-06-03", required=None):
    return dimension_scores(
        df, profile_table(df), duplicate_rows(df), sector, as_of=as_of, required=required
    )


def test_registry(spark):
    rows = profile_registry(spark).collect()
    assert {r["profile_id"] for r in rows} == {
        "generic", "retail", "healthcare", "financial", "survey", "ml_training"}
    for pid in fv.SECTOR_PROFILES:
        assert sum(r["weight"] for r in rows if r["profile_id"] == pid) == pytest.approx(1)


def test_resolve_columns():
    assert resolve_columns(["STORE", "dt", "x"], "retail") == (["STORE", "dt"], ["sku", "sales"])
    assert resolve_columns(["a"], "generic", ["a", " missing ", "", "a"]) == (["a"], ["missing"])
    assert resolve_columns(["a"], "generic") == ([], [])
    assert resolve_columns(["item", "sku", "date"], "retail")[0] == ["date", "sku"]


def test_retail_contract(retail):
    rules = rules_for(retail, "retail")
    got = outcome(retail, rules)
    assert len(got) == 7 and sum(r["passed"] for r in got.values()) == 5
    assert (got["not_null_date"]["violation_count"], got["not_null_date"]["violation_pct"]) == (1, 25)
    assert got["not_null_date"]["message"] == "1 null/empty value(s) in date"
    assert (got["sales_non_negative"]["violation_count"], got["sales_non_negative"]["violation_pct"]) == (1, 25)
    assert got["unique_transaction"]["message"] == "Composite key unique"
    scores = dims(retail, "retail")
    d = scores.first()
    assert (d["completeness"], d["uniqueness"], d["validity"], d["type_consistency"], d["outliers"],
            d["timeliness"]) == (93.75, 100, 93.75, 100, 100, 100)
    assert weighted_score(scores, "retail").first()["overall"] == 97.5
    a = assess_contract(retail, evaluate_rules(retail, rules), scores, "retail").first()
    assert (a["contract_passed"], a["rules_passed"], a["rules_total"], a["level"]) == (
        False, 5, 7, "Excellent")
    assert a["required_columns"] == ["store_id", "date", "sku", "sales"]
    assert {r["nulls_in_row"]: r["row_count"] for r in row_completeness(retail).collect()} == {0: 3, 1: 1}


def test_timeliness(retail):
    assert dims(retail, "retail", "2024-06-13").first()["timeliness"] == pytest.approx(97.26)
    assert dims(retail, "retail", "2024-05-24").first()["timeliness"] > 100  # a date to come
    assert dims(retail, "retail", "2034-06-03").first()["timeliness"] == 0


def test_survey_contract(survey):
    rules = rules_for(survey, "survey")
    got = outcome(survey, rules)
    assert {k: (r["passed"], r["violation_count"], r["violation_pct"]) for k, r in got.items()} == {
        "no_duplicate_rows": (False, 1, 20), "not_null_respondent_id": (True, 0, 0),
        "unique_respondent": (False, 2, 40), "high_item_missingness": (False, 1, 20)}
    scores = dims(survey, "survey")
    d = scores.first()
    assert (d["completeness"], d["uniqueness"], d["validity"], d["type_consistency"], d["deep_checks"]) == (
        100, 60, 100, 100, 100)
    a = assess_contract(survey, evaluate_rules(survey, rules), scores, "survey").first()
    assert (a["overall"], a["contract_passed"], a["rules_passed"], a["rules_total"]) == (90, True, 1, 4)
    parts = dimension_contributions(scores, "survey").collect()
    assert sum(p["weighted_contribution"] for p in parts) == pytest.approx(90)
    assert {r["nulls_in_row"]: r["row_count"] for r in row_completeness(survey).collect()} == {0: 3, 1: 1, 3: 1}


def test_not_null_and_keys(spark):
    skus = spark.createDataFrame([("A",), ("",), (None,), ("B",)], "sku string")
    assert outcome(skus, build_rules(["sku"], "generic", ["sku"]))["not_null_sku"]["violation_count"] == 2
    key = spark.createDataFrame(
        [(1, "2024-01-01", "X"), (1, "2024-01-01", "X"), (2, "2024-01-02", "Y")],
        "store_id int, date string, sku string")
    assert outcome(key, rules_for(key, "retail"))["unique_transaction"]["violation_count"] == 2
    missing = spark.createDataFrame([(None,), (None,), ("a",)], "respondent_id string")
    assert outcome(missing, rules_for(missing, "survey"))["unique_respondent"]["violation_count"] == 2
    sales = spark.createDataFrame([(10.0,), (-1.0,), (5.0,)], "sales double")
    low = outcome(sales, rules_for(sales, "retail"))["sales_non_negative"]
    assert (low["violation_count"], low["violation_pct"], low["message"]) == (1, 33.33, "1 value(s) below 0")


def test_email_and_label_rules(spark):
    mails = spark.createDataFrame(
        [("c1", "a@b.co"), ("c2", "bad"), ("c3", " "), ("c4", None), ("c5", " x@y.z ")],
        "customer_id string, email string")
    got = outcome(mails, rules_for(mails, "financial"))["email_format"]
    assert (got["violation_count"], got["total_checked"], got["violation_pct"]) == (1, 3, 33.33)
    labels = spark.createDataFrame([(1, None), (2, 1)], "x int, target int")
    got = outcome(labels, rules_for(labels, "ml_training"))
    assert got["label_present"]["violation_count"] == got["not_null_target"]["violation_count"] == 1


def test_empty_table_and_unknown_rule(spark, retail):
    empty = spark.createDataFrame([], retail.schema)
    got = outcome(empty, rules_for(empty, "retail"))
    assert all(r["passed"] and r["message"] == "Empty dataset" and r["total_checked"] == 0 for r in got.values())
    odd = outcome(retail, [Rule("odd", "Odd", "critical", "no_such_rule")])["odd"]
    assert odd["passed"] and odd["message"] == "Unknown rule type — skipped"


def test_empty_cells(spark):
    rows = spark.createDataFrame(
        [(1.0, "x", 10), (None, "", 20), (float("nan"), " NaN ", None)], "a double, b string, c int")
    assert [r["empty_cells"] for r in empty_cells_per_row(rows).collect()] == [0, 2, 3]


def test_samples_of_failures(retail, survey):
    rows = sample_failures(retail, rules_for(retail, "retail"), ["store_id"]).collect()
    assert [(r["rule_id"], r["rank"], r["store_id"]) for r in rows] == [
        ("not_null_date", 1, "4"), ("sales_non_negative", 1, "4")]
    rows = sample_failures(survey, rules_for(survey, "survey"), ["respondent_id"]).collect()
    assert [(r["rule_id"], r["respondent_id"]) for r in rows] == [
        ("no_duplicate_rows", "R1"), ("no_duplicate_rows", "R1"),
        ("unique_respondent", "R1"), ("unique_respondent", "R1"), ("high_item_missingness", "R3")]


def test_samples_of_repeated_keys_against_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(i, rng.choice(["hot"] * 3 + [f"k{rng.randrange(150)}", None])) for i in range(400)]
    df = spark.createDataFrame(data, "id int, respondent_id string")
    counts = {}
    for _, k in data:
        counts[k] = counts.get(k, 0) + 1
    expected = [i for i, k in data if counts[k] > 1][:5]
    rule = Rule("u", "u", "warning", "unique", ["respondent_id"])
    got = [r["id"] for r in sample_failures(df, [rule], ["id"]).orderBy("rank").collect()]
    assert got == expected


def test_rules_by_segment(spark):
    rows = spark.createDataFrame(
        [("a", "1"), ("a", "1"), ("b", None), ("b", "2"), (None, "3")], "seg string, respondent_id string")
    rules = [Rule("d", "d", "warning", "no_duplicate_rows"),
             Rule("n", "n", "critical", "not_null", ["respondent_id"])]
    got = {(r["seg"], r["rule_id"]): r["violation_count"] for r in evaluate_rules(rows, rules, ["seg"]).collect()}
    assert got == {("a", "d"): 1, ("a", "n"): 0, ("b", "d"): 0, ("b", "n"): 1, (None, "d"): 0, (None, "n"): 0}
