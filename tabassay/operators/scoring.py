"""Quality scores of columns and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions import fixed_values as fv
from ..functions.cells import literal, quoted
from ..plans.keys import by, side_by_side
from .profile import share

LOW_CARDINALITY = "(dtype = 'numeric' AND cardinality < 0.05 AND unique_count < 20)"
PENALTIES = ["nulls", "duplicates", "outliers", "type_mismatch", "low_cardinality", "deep_issues"]


def one_decimal(value: str) -> str:
    return f"format_string('%.1f', round({value}, 1))"


def level_of(score: str) -> str:
    """Name of the score level."""
    *bounded, (last, _) = fv.LEVELS
    whens = " ".join(f"WHEN {score} >= {low} THEN {literal(name)}" for name, low in bounded)
    return f"CASE {whens} ELSE {literal(last)} END"


def _findings() -> list[tuple[str, str, str | None, str | None]]:
    """(condition, points lost, issue, advice) in the order they are reported.

    The wordings are fixed values.
    """
    null_pct, mixed = one_decimal("null_pct"), one_decimal("mixed_type_pct")
    outlier_pct = one_decimal("outlier_pct")
    column = "concat('Column `', column, '`"
    signed = " OR ".join(f"contains(lower(column), {literal(p)})" for p in fv.SIGNED_NAME_PARTS)
    remedy = "CASE WHEN dtype = 'numeric' THEN 'median' ELSE 'mode' END"
    return [
        (
            "null_pct > 0",
            "least(1.2D * null_pct, 30D)",
            f"concat({null_pct}, '% null values')",
            f"{column} is ', {null_pct}, '% null — ', CASE WHEN null_pct > 60"
            f" THEN 'consider dropping' ELSE concat('impute with ', {remedy}) END)",
        ),
        (
            "mixed_type_pct > 5",
            "least(0.8D * mixed_type_pct, 20D)",
            f"concat({mixed}, '% non-numeric values in otherwise numeric column')",
            f"{column} has mixed types — investigate non-numeric entries like \\'TBD\\', \\'N/A\\'')",
        ),
        (
            "dtype = 'numeric' AND outlier_pct > 0",
            "least(outlier_pct, 25D)",
            f"concat({outlier_pct}, '% outliers (IQR method)')",
            f"{column} has ', {outlier_pct}, '% outliers — review for data entry errors')",
        ),
        (
            "extreme_outlier_count > 0",
            "least(3D * extreme_outlier_count, 20D)",
            "concat(extreme_outlier_count, ' extreme outlier(s) (5× IQR)')",
            f"{column} has ', extreme_outlier_count,"
            " ' extreme outlier(s) — likely data entry errors')",
        ),
        (
            f"negative_count > 0 AND NOT ({signed})",
            "least(1.5D * negative_pct, 15D)",
            f"concat(negative_count, ' negative value(s) (', {one_decimal('negative_pct')}, '%)')",
            f"{column} has negative values — validate with source system')",
        ),
        (
            LOW_CARDINALITY,
            "10D",
            "'Low cardinality numeric (likely categorical)'",
            f"{column} has only ', unique_count,"
            " ' unique values — consider treating as categorical')",
        ),
        (
            "date_format_count >= 2",
            "15D",
            "concat(date_format_count, ' different date formats detected')",
            f"{column} has mixed date formats — standardize to ISO 8601')",
        ),
        (
            "date_format_count >= 1 AND dtype = 'categorical' AND mixed_type_pct < 50",
            "10D",
            # several shapes were reported just before
            "CASE WHEN date_format_count < 2 THEN 'Likely date column parsed as string' END",
            f"{column} appears to contain dates — cast to DATE type')",
        ),
        (
            "invalid_email_count > 0",
            "least(0.8D * invalid_email_pct, 15D)",
            "concat(invalid_email_count, ' invalid email(s)')",
            f"{column} has ', invalid_email_count, ' malformed emails — validate input')",
        ),
        (
            "whitespace_count > 0",
            "least(0.5D * whitespace_pct, 10D)",
            "concat(whitespace_count, ' value(s) with leading/trailing whitespace')",
            f"{column} has whitespace issues — use .str.strip()')",
        ),
        (
            "encoding_issues > 0",
            "10D",
            "concat(encoding_issues, ' value(s) with encoding corruption (mojibake)')",
            f"{column} has encoding issues — re-import in UTF-8')",
        ),
    ]


def column_quality(profile: DataFrame) -> DataFrame:
    """The profile with quality_score, quality_level, issues and recommendations."""
    findings = _findings()
    lost = " - ".join(f"CASE WHEN {when} THEN {points} ELSE 0D END" for when, points, _, _ in findings)

    def texts(index: int) -> str:
        parts = ", ".join(f"CASE WHEN {f[0]} THEN {f[index]} END" for f in findings)
        return f"array_compact(array({parts}))"

    return profile.selectExpr(
        "*",
        f"greatest(0D, least(100D, 100D - {lost})) AS quality_score",
        f"{texts(2)} AS issues",
        f"{texts(3)} AS recommendations",
    ).selectExpr("*", f"{level_of('quality_score')} AS quality_level")


def duplicate_rows(df: DataFrame, segment_by: list[str] | tuple = ()) -> DataFrame:
    """(segment..., total_rows, duplicate_rows, duplicate_pct): repeats beyond the first."""
    keys = [quoted(s) for s in segment_by]
    one, two = cells.row_digest(df.schema)
    copies = (
        df.selectExpr(*keys, f"{one} AS digest1", f"{two} AS digest2")
        .groupBy(*by(segment_by), "digest1", "digest2")
        .agg(F.expr("count(1) AS n"))
    )
    counted = copies.groupBy(*by(segment_by)).agg(
        F.expr("coalesce(sum(n), 0) AS total_rows"),
        F.expr("coalesce(sum(n - 1), 0) AS duplicate_rows"),
    )
    return counted.selectExpr(
        *keys, "total_rows", "duplicate_rows",
        f"{share('duplicate_rows', 'total_rows')} AS duplicate_pct",
    )


def table_score(
    scored: DataFrame, duplicates: DataFrame, segment_by: list[str] | tuple = ()
) -> DataFrame:
    """(segment..., overall, level, six penalties) from scored columns and duplicates."""
    segment_by = list(segment_by)
    deep = "int(date_format_count >= 2) + int(invalid_email_count > 0) + int(encoding_issues > 0)"
    of_columns = scored.groupBy(*by(segment_by)).agg(*map(F.expr, [
        "0.25D * avg(null_pct) AS nulls",
        "coalesce(0.2D * avg(outlier_pct) FILTER (WHERE dtype = 'numeric'), 0D) AS outliers",
        "15D * avg(int(mixed_type_pct > 5)) AS type_mismatch",
        f"10D * avg(int({LOW_CARDINALITY})) AS low_cardinality",
        f"10D * avg({deep}) AS deep_issues",
    ]))
    of_rows = duplicates.selectExpr(
        *[quoted(s) for s in segment_by], "least(2D * duplicate_pct, 20D) AS duplicates"
    )
    keys = [quoted(s) for s in segment_by]
    return (
        side_by_side([of_columns, of_rows], segment_by)
        .selectExpr(*keys, *[f"coalesce({p}, 0D) AS {p}" for p in PENALTIES])
        .selectExpr("*", f"greatest(0D, 100D - ({' + '.join(PENALTIES)})) AS overall")
        .selectExpr(*keys, "overall", f"{level_of('overall')} AS level", *PENALTIES)
    )


def column_scores(scored: DataFrame, segment_by: list[str] | tuple = ()) -> DataFrame:
    """(segment..., column_scores): a map from column to score."""
    return scored.groupBy(*by(list(segment_by))).agg(
        F.expr("map_from_entries(collect_list(struct(column, quality_score))) AS column_scores")
    )


def effective_score(table: DataFrame, assessment: DataFrame | None = None) -> DataFrame:
    """(overall, level): of the sector assessment when there is one, else of the profiler."""
    chosen = table if assessment is None else assessment
    return chosen.select("overall", "level")
