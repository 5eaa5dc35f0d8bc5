"""Evidence for a review of a table, its triage, and the rows of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import literal
from ..plans.keys import side_by_side
from .analytics import issue_summary, row_completeness, title
from .contracts import Rule, sample_failures
from .scoring import PENALTIES, one_decimal


def columns_of_interest(scored: DataFrame, limit: int = 12) -> DataFrame:
    """At most twelve columns that have issues, those that miss most first."""
    return (
        scored.where("size(issues) > 0")
        .orderBy(F.desc("null_pct"), F.desc("mixed_type_pct"), "ordinal")
        .limit(limit)
        .selectExpr(
            "ordinal", "column", "dtype", "round(null_pct, 2) AS null_pct", "unique_count",
            "round(mixed_type_pct, 2) AS mixed_type_pct", "issues", "recommendations",
            "top_values",
        )
    )


def evidence_samples(
    df: DataFrame, rules: list[Rule], order_by: list[str], max_rows: int = 5
) -> DataFrame:
    """The first ``max_rows`` rows of each failed rule."""
    return sample_failures(df, rules, order_by, max_rows)


def evidence_completeness(df: DataFrame, top_n: int = 5) -> DataFrame:
    """The first buckets of the row completeness, fewest empty cells first."""
    return row_completeness(df).orderBy("nulls_in_row").limit(top_n)


def evidence_issue_counts(profile: DataFrame) -> DataFrame:
    """Columns per issue kind; outliers count from 5 % on."""
    return issue_summary(profile, outliers_above=5)


def triage_issues(
    rule_rows: DataFrame, interest: DataFrame, *, samples: DataFrame | None = None, sampled: bool = False
) -> DataFrame:
    """(verdict, issue_id, rule_id, column, severity, title, explanation, evidence_refs, action, confidence).

    Failed rules and strongly mixed columns are confirmed.  If there are none although
    some rule passed, one entry says so.  ``samples`` are ``evidence_samples``; the evidence
    of a rule refers to those it has.  The wordings are fixed values.
    """
    confidence = "0.65D" if sampled else "0.85D"
    flagged = rule_rows.where("NOT passed")
    if samples is None:
        flagged = flagged.selectExpr("*", "CAST(NULL AS BIGINT) AS sample_rows")
    else:  # as many rows as there are rules
        counts = samples.groupBy("rule_id").agg(F.expr("count(1) AS sample_rows"))
        flagged = flagged.join(F.broadcast(counts), "rule_id", "left")
    failed = flagged.selectExpr(
        "0 AS part", "ordinal",
        "'confirmed' AS verdict", "concat('confirm_', rule_id) AS issue_id", "rule_id",
        "CAST(NULL AS STRING) AS column", "severity", "name AS title",
        "concat('Deterministic contract flagged ', violation_count, ' violation(s) (',"
        " violation_pct, '%): ', message, '. Review samples before treating as actionable.')"
        " AS explanation",
        "array_compact(array(concat('rule:', rule_id), concat('violations:', violation_count),"
        " concat('sample_failures[0..', sample_rows - 1, ']'))) AS evidence_refs",
        "CASE WHEN rule_id = 'no_duplicate_rows' AND violation_pct < 2 THEN 'fix'"
        " WHEN rule_id = 'high_item_missingness' THEN 'document' ELSE 'manual_review' END"
        " AS action",
    )
    mixed = interest.where("mixed_type_pct > 10").selectExpr(
        "1 AS part", "ordinal",
        "'confirmed' AS verdict", "concat('mixed_', column) AS issue_id",
        "CAST(NULL AS STRING) AS rule_id", "column", "'warning' AS severity",
        "concat('Mixed encoding in ', column) AS title",
        "concat('Column has ', mixed_type_pct, '% non-numeric values in a numeric-leaning"
        " column — common in survey Likert exports with text labels.') AS explanation",
        "array(concat('ColumnProfile.mixed_type_pct=', mixed_type_pct), concat('top_values:[',"
        " coalesce(array_join(transform(slice(top_values, 1, 3), v -> concat(v.value, ' (', v.n, ')')), ', '), ''),"
        " ']')) AS evidence_refs",
        "'manual_review' AS action",
    )
    # One row whatever happens: kept when some rule passed and nothing was confirmed.
    outcome = rule_rows.selectExpr("int(passed) AS passed", "int(NOT passed) AS confirmed").unionByName(
        mixed.selectExpr("0 AS passed", "1 AS confirmed")
    )
    rejected = (
        outcome.agg(F.expr("sum(passed) AS passed"), F.expr("sum(confirmed) AS confirmed"))
        .where("passed > 0 AND confirmed = 0")
        .selectExpr(
            "2 AS part", "0 AS ordinal", "'rejected' AS verdict", "'no_failed_rules' AS issue_id",
            "CAST(NULL AS STRING) AS rule_id", "CAST(NULL AS STRING) AS column",
            "CAST(NULL AS STRING) AS severity", "CAST(NULL AS STRING) AS title",
            "'All contract rules passed on analyzed data; no semantic flags to confirm.'"
            " AS explanation",
            "CAST(array() AS ARRAY<STRING>) AS evidence_refs",
            "CAST(NULL AS STRING) AS action",
        )
    )
    return (
        failed.unionByName(mixed)
        .unionByName(rejected)
        .orderBy("part", "ordinal")
        .selectExpr(
            "verdict", "issue_id", "rule_id", "column", "severity", "title", "explanation",
            "evidence_refs", "action", f"{confidence} AS confidence",
        )
    )


def evidence_envelope(
    analyzed: DataFrame, rule_rows: DataFrame, whole: DataFrame | None = None
) -> DataFrame:
    """One row (rows_analyzed, total_rows, sampled, rules_passed, rules_failed); ``whole`` if a sample was analyzed."""
    rows = analyzed.agg(F.expr("count(1) AS rows_analyzed"))
    rules = rule_rows.agg(F.expr("count_if(passed) AS rules_passed"), F.expr("count_if(NOT passed) AS rules_failed"))
    parts = [rows, rules] if whole is None else [rows, rules, whole.agg(F.expr("count(1) AS total_rows"))]
    total = "rows_analyzed" if whole is None else "total_rows"
    return side_by_side(parts, []).selectExpr(
        "rows_analyzed", f"{total} AS total_rows", f"rows_analyzed < {total} AS sampled", "rules_passed", "rules_failed"
    )


def triage_summary(envelope: DataFrame, issues: DataFrame) -> DataFrame:
    """The row of ``evidence_envelope`` with (confirmed, summary) of its triage; the wording is a fixed value."""
    confirmed = issues.agg(F.expr("count_if(verdict = 'confirmed') AS confirmed"))
    return side_by_side([envelope, confirmed], []).selectExpr(
        *envelope.columns, "confirmed",
        "concat('Reviewed ', rows_analyzed, ' rows (', total_rows, ' total)',"
        " IF(sampled, ' (sampled analysis — counts may differ on full data)', ''),"
        " '. ', confirmed, ' issue(s) to review.') AS summary",
    )


def report_rows(
    scored: DataFrame,
    table: DataFrame,
    *,
    assessment: DataFrame | None = None,
    contributions: DataFrame | None = None,
    rule_rows: DataFrame | None = None,
    drift: DataFrame | None = None,
) -> DataFrame:
    """(section, ordinal, text): the report, section by section.

    Each table but ``drift`` is read once, so that what it is computed from runs once. The wordings are fixed values.
    """
    scores = "concat({}, '/100 — ', level)"
    parts = []

    def line(section: int, name: str, text: str, ordinal: str = "0") -> str:
        return (
            f"struct({section} AS part, {literal(name)} AS section,"
            f" CAST({ordinal} AS INT) AS ordinal, {text} AS text)"
        )

    def add(rows: DataFrame, *lines: str) -> None:
        parts.append(rows.selectExpr(f"inline(array({', '.join(lines)}))"))

    if assessment is not None:
        contract = (
            "concat('Data contract: ', IF(contract_passed, 'passed', 'failed'), ' (',"
            " rules_passed, '/', rules_total, ' rules)')"
        )
        add(assessment,
            line(0, "profile", "concat('Profile: ', profile_label)", "0"),
            line(0, "profile", f"concat('Profile Score: ', {scores.format(one_decimal('overall'))})", "1"),
            line(0, "profile", contract, "2"))
    if contributions is not None:
        add(contributions, line(1, "dimensions",
            f"concat({title('dimension')}, ': ', {one_decimal('score')}, ' (weight ',"
            " format_string('%.0f', round(weight * 100, 0)), '%)')", "ordinal"))
    if rule_rows is not None:
        add(rule_rows.where("NOT passed"), line(2, "contract_failures",
            "concat(name, ' (', severity, '): ', message)", "ordinal"))
    add(table,
        line(3, "score", f"concat('Overall Score: ', {scores.format(one_decimal('overall'))})"),
        *[line(4, "breakdown", f"concat({title(literal(p))}, ': -', {one_decimal(p)}, ' points')", str(i))
          for i, p in enumerate(PENALTIES)])
    column = line(5, "columns",
        f"concat_ws(' | ', column, dtype, concat({one_decimal('null_pct')}, '%'),"
        " format_string('%,d', unique_count), quality_level,"
        " IF(size(issues) > 0, array_join(issues, '; '), '—'))", "ordinal")
    advice = f"transform(recommendations, (text, place) -> {line(6, 'recommendations', 'text', 'ordinal * 100 + place')})"
    none = line(6, "recommendations", "'No issues detected — data looks clean!'")
    # one row, which holds a few lines per column of the schema
    parts.append(
        scored.selectExpr(f"{column} AS line", f"{advice} AS advice")
        .agg(F.expr("collect_list(line) AS lines"), F.expr("flatten(collect_list(advice)) AS advice"))
        .selectExpr(f"inline(concat(lines, IF(size(advice) > 0, advice, array({none}))))")
    )
    if drift is not None:
        from .drift import drift_summary

        add(drift_summary(drift), line(7, "drift", "concat('Summary: ', summary)"))
        add(drift, line(8, "drift_changes",
            "CASE change WHEN 'added' THEN concat('Added column: ', column)"
            " WHEN 'removed' THEN concat('Removed column: ', column)"
            " WHEN 'type_changed' THEN concat(column, ': ', old_type, ' → ', new_type)"
            " ELSE concat(column, ': p = ', format_string('%.4f', round(p_value, 4))) END",
            "CASE change WHEN 'added' THEN 0 WHEN 'removed' THEN 1 WHEN 'type_changed' THEN 2 ELSE 3 END"))
    return reduce(DataFrame.unionByName, parts).orderBy("part", "ordinal", "text").drop("part")
