"""Evidence, triage and report."""

from tabassay import (
    assess_contract, build_rules, column_quality, columns_of_interest, dimension_contributions,
    dimension_scores, duplicate_rows, evaluate_rules, evidence_completeness,
    evidence_issue_counts, evidence_samples, profile_table, report_rows, resolve_columns,
    schema_drift, table_score, triage_issues, evidence_envelope, triage_summary,
)


def parts(df, sector):
    scored = column_quality(profile_table(df))
    rules = build_rules(df.columns, sector, resolve_columns(df.columns, sector)[0])
    return scored, rules, evaluate_rules(df, rules)


def test_survey_triage(survey):
    scored, rules, rows = parts(survey, "survey")
    found = triage_issues(rows, columns_of_interest(scored)).collect()
    assert [(r["issue_id"], r["action"]) for r in found] == [
        ("confirm_no_duplicate_rows", "manual_review"), ("confirm_unique_respondent", "manual_review"),
        ("confirm_high_item_missingness", "document")]
    assert {r["confidence"] for r in found} == {0.85}
    assert found[0]["explanation"] == (
        "Deterministic contract flagged 1 violation(s) (20.0%): 1 duplicate row(s). "
        "Review samples before treating as actionable.")
    assert {r["confidence"] for r in triage_issues(rows, columns_of_interest(scored), sampled=True).collect()} == {0.65}


def test_clean_table_is_rejected_once(spark):
    clean = spark.createDataFrame([(f"R{i}", str(i)) for i in range(5)], "respondent_id string, q string")
    scored, _, rows = parts(clean, "survey")
    found = triage_issues(rows, columns_of_interest(scored)).collect()
    assert [(r["verdict"], r["issue_id"]) for r in found] == [("rejected", "no_failed_rules")]


def test_mixed_columns_are_warned_about(spark):
    rows = spark.createDataFrame([(f"R{i}", "Agree" if i % 2 else "3") for i in range(10)], "respondent_id string, q string")
    scored, _, rule_rows = parts(rows, "survey")
    found = triage_issues(rule_rows, columns_of_interest(scored)).collect()
    assert [(r["issue_id"], r["column"], r["severity"]) for r in found] == [("mixed_q", "q", "warning")]


def test_evidence_references_and_summary(spark, survey):
    scored, rules, rows = parts(survey, "survey")
    samples = evidence_samples(survey, rules, ["respondent_id"])
    issues = triage_issues(rows, columns_of_interest(scored), samples=samples)
    assert issues.first()["evidence_refs"] == ["rule:no_duplicate_rows", "violations:1", "sample_failures[0..1]"]
    whole = triage_summary(evidence_envelope(survey, rows), issues).first()
    assert whole["summary"] == "Reviewed 5 rows (5 total). 3 issue(s) to review."
    part = triage_summary(evidence_envelope(survey, rows, survey.union(survey)), issues).first()
    assert part["summary"] == (
        "Reviewed 5 rows (10 total) (sampled analysis — counts may differ on full data). 3 issue(s) to review.")
    assert (part["sampled"], part["rules_failed"]) == (True, 3)
    mixed = spark.createDataFrame([(f"R{i}", "Agree" if i % 2 else "3") for i in range(10)], "respondent_id string, q string")
    scored, _, rows = parts(mixed, "survey")
    assert triage_issues(rows, columns_of_interest(scored)).first()["evidence_refs"] == [
        "ColumnProfile.mixed_type_pct=50.0", "top_values:[3 (5), Agree (5)]"]


def test_evidence(survey):
    scored, rules, _ = parts(survey, "survey")
    assert [r["column"] for r in columns_of_interest(scored).collect()] == ["q2", "q1", "q3"]
    assert {r["rule_id"] for r in evidence_samples(survey, rules, ["respondent_id"]).collect()} == {
        "no_duplicate_rows", "unique_respondent", "high_item_missingness"}
    assert [tuple(r) for r in evidence_completeness(survey).collect()] == [(0, 3), (1, 1), (3, 1)]
    assert evidence_issue_counts(scored).first()["nulls"] == 3


def test_report(retail):
    scored, rules, rows = parts(retail, "retail")
    duplicates = duplicate_rows(retail)
    dims = dimension_scores(retail, scored, duplicates, "retail", as_of="2024-06-03")
    report = report_rows(
        scored, table_score(scored, duplicates),
        assessment=assess_contract(retail, rows, dims, "retail"),
        contributions=dimension_contributions(dims, "retail"),
        rule_rows=rows,
        drift=schema_drift(retail, retail.drop("sku")),
    ).collect()
    lines = [(r["section"], r["text"]) for r in report]
    assert lines[:3] == [
        ("profile", "Profile: Retail / Transactional"), ("profile", "Profile Score: 97.5/100 — Excellent"),
        ("profile", "Data contract: failed (5/7 rules)")]
    assert ("dimensions", "Type Consistency: 100.0 (weight 10%)") in lines
    assert ("contract_failures", "sales ≥ 0 (critical): 1 value(s) below 0") in lines
    assert ("score", "Overall Score: 98.4/100 — Excellent") in lines
    assert ("breakdown", "Nulls: -1.6 points") in lines
    assert ("columns", "sku | categorical | 0.0% | 4 | Excellent | —") in lines
    assert lines[-2:] == [("drift", "Summary: 1 breaking changes, 0 warnings"), ("drift_changes", "Removed column: sku")]


def test_report_of_a_clean_table(spark):
    clean = spark.createDataFrame([("a",), ("b",)], "w string")
    scored = column_quality(profile_table(clean))
    texts = [r["text"] for r in report_rows(scored, table_score(scored, duplicate_rows(clean))).collect()]
    assert texts[-1] == "No issues detected — data looks clean!"
