"""Aggregates behind the quality charts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import listed, literal, quoted
from ..plans.frequency import TEXT, kind_of, positions
from ..plans.keys import by, side_by_side
from .contracts import empty_cells
from .profile import column_list
from .rows import row_sample

MIN_NUMBERS = 10  # a column with more numbers than this is correlated
BINS = 30

# Issue kinds, in report order, and what makes a column count.
ISSUES = [
    ("nulls", "null_pct > 0"),
    ("outliers", "outlier_pct > 0"),
    ("mixed_types", "mixed_type_pct > 5"),
    ("email", "invalid_email_count > 0"),
    ("encoding", "encoding_issues > 0"),
    ("whitespace", "whitespace_count > 0"),
    ("date_format", "date_format_count >= 2"),
]

# Health metrics and what each loses.
HEALTH = [
    ("Completeness", "missing"),
    ("Outliers", "outlying"),
    ("Uniqueness", "5D * duplicates"),
    ("Types", "6D * type_mismatch"),
    ("Cardinality", "8D * low_cardinality"),
    ("Deep checks", "8D * deep_issues"),
]


def title(name: str) -> str:
    """Expression: a snake-case name as a title."""
    return f"initcap(replace({name}, '_', ' '))"


# ---------------------------------------------------------------- correlation


def numeric_candidates(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns that are numbers or could be read as such."""
    return [
        f.name for f in df.schema
        if f.name in (columns or df.columns)
        and (isinstance(f.dataType, cells.NUMERIC) or kind_of(f.dataType) == TEXT)
    ]


MOMENTS = ["n", "odd", "x", "y", "xx", "yy", "xy"]


def _pair_moments(k: int):
    """The Arrow function that adds up, over a task's rows, the moments of all pairs of k numbers.

    Each batch gives them as products of its matrices of values and of masks; a task puts out
    k * (k + 1) / 2 rows however many rows it read.  ``odd`` counts rows with an infinite number.
    """

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, k)
            x = np.nan_to_num(flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, k), nan=np.inf, posinf=np.inf, neginf=np.inf)
            odd = (there & np.isinf(x)).astype(float)
            x, there = np.where(np.isinf(x), 0.0, x), there.astype(float)
            sums, squares = x.T @ there, (x * x).T @ there
            infinite = odd.T @ there
            found = np.stack([there.T @ there, infinite + infinite.T, sums, sums.T, squares, squares.T, x.T @ x])
            total = found if total is None else total + found
        if total is not None:
            i, j = np.triu_indices(k)
            moments = [pa.array(m[i, j]) for m in total]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *moments], ["a", "b", *MOMENTS])

    return run


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(i, j, x_col, y_col, r): Pearson over rows where both are numbers, 0 if undefined.

    Every column with more than ten numbers takes part.  One scan counts and averages the
    columns; a second one adds up the moments of all pairs around these averages, in matrix
    products per Arrow batch, so a task shuffles one row per pair.  A spread below a millionth
    of a pair's distance from the average is taken for rounding, that is for none.
    """
    names = numeric_candidates(df, columns)
    if not names:
        schema = "i int, j int, x_col string, y_col string, r double"
        return df.sparkSession.createDataFrame([], schema)
    numbers = [cells.as_number(quoted(c), df.schema[c].dataType) for c in names]
    wide = df.selectExpr(f"array({', '.join(numbers)}) AS x")
    one_by_one = df.selectExpr(*[f"{number} AS c{i}" for i, number in enumerate(numbers)])
    finite = "abs(c{i}) < double('inf')"
    means = ", ".join(f"avg(c{i}) FILTER (WHERE {finite.format(i=i)})" for i in range(len(names)))
    counts = ", ".join(f"count(c{i})" for i in range(len(names)))
    known = one_by_one.agg(F.expr(f"array({means}) AS means"), F.expr(f"array({counts}) AS counts"))
    known = known.select(F.struct("means", "counts")).scalar()
    centred = wide.withColumn("known", known).selectExpr("zip_with(x, known.means, (v, m) -> v - m) AS x")
    sums = (
        centred.mapInArrow(_pair_moments(len(names)), "a int, b int, " + ", ".join(f"{m} double" for m in MOMENTS))
        .groupBy("a", "b")
        .agg(*[F.sum(m).alias(m) for m in MOMENTS])
        .withColumn("counts", known.getField("counts"))
        # a single eligible column makes no matrix
        .where(
            f"counts[a] > {MIN_NUMBERS} AND counts[b] > {MIN_NUMBERS}"
            f" AND size(filter(counts, n -> n > {MIN_NUMBERS})) > 1"
        )
    )
    spread = {z: f"IF({z}{z} - {z} * {z} / n > 1e-12 * {z}{z}, {z}{z} - {z} * {z} / n, NULL)" for z in "xy"}
    r = f"try_divide(xy - x * y / n, sqrt({spread['x']}) * sqrt({spread['y']}))"
    r = f"IF(odd = 0 AND n > 1, nanvl({r}, NULL), NULL)"
    at = f"array({', '.join(str(df.columns.index(c)) for c in names)})"
    name = f"array({listed(names)})"
    return sums.selectExpr(
        "explode(IF(a = b, array(struct(a, b)), array(struct(a, b), struct(b AS a, a AS b)))) AS p", f"{r} AS q"
    ).selectExpr(
        f"{at}[p.a] AS i", f"{at}[p.b] AS j", f"{name}[p.a] AS x_col", f"{name}[p.b] AS y_col",
        "coalesce(IF(abs(q) > 1, signum(q), q), 0D) AS r",
    )


def best_correlation_pair(matrix: DataFrame) -> DataFrame:
    """(x_col, y_col, r) of the strongest pair, the first one on ties."""
    return matrix.where("i < j").orderBy(F.expr("abs(r)").desc(), "i", "j").limit(1).select(
        "x_col", "y_col", "r"
    )


def strong_pairs(matrix: DataFrame, least: float = 0.5, limit: int = 8) -> DataFrame:
    """(x_col, y_col, r) of the pairs with |r| at or above the threshold, strongest first."""
    return (
        matrix.where(f"i < j AND abs(r) >= {least}D")
        .orderBy(F.expr("abs(r)").desc(), "i", "j")
        .limit(limit)
        .select("x_col", "y_col", "r")
    )


def scatter_sample(
    df: DataFrame, x_col: str, y_col: str, key: list[str] | None = None, limit: int = 800
) -> DataFrame:
    """(x, y) of at most ``limit`` rows where both are numbers."""
    x, y = (cells.as_number(quoted(c), df.schema[c].dataType) for c in (x_col, y_col))
    both = df.where(f"({x}) IS NOT NULL AND ({y}) IS NOT NULL")
    return row_sample(both, limit, key).selectExpr(f"{x} AS x", f"{y} AS y")


# ---------------------------------------------------------------- values


def box_plots(profile: DataFrame, limit: int = 8) -> DataFrame:
    """(column, min, q1, median, q3, max, outliers) of the numeric columns in worst state."""
    return (
        profile.where("dtype = 'numeric'")
        .orderBy(F.expr("outlier_pct + null_pct").desc(), "ordinal")
        .limit(limit)
        .where("parsed_count >= 5")
        .selectExpr(
            "column", "min_val AS min", "q1", "median", "q3", "max_val AS max",
            "outlier_count AS outliers",
        )
    )


def histogram(df: DataFrame, profile: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, bin, lower, count): 30 equal bins from min to max, the last one closed.

    Only columns the profile calls numeric have one; a constant column spans +-0.5.
    """
    names = numeric_candidates(df, columns)
    pos = positions(df)
    wide = df.selectExpr(*[
        f"{cells.as_number(quoted(c), df.schema[c].dataType)} AS `{pos[c]}`" for c in names
    ])
    values = wide.unpivot([], [F.col(f"`{pos[c]}`") for c in names], "pos", "num")
    spans = (
        column_list(df, names)
        .join(profile.select("column", "dtype", "min_val", "max_val"), "column")
        .where("dtype = 'numeric' AND min_val IS NOT NULL")
        .selectExpr(
            "pos", "column",
            "IF(min_val = max_val, min_val - 0.5D, min_val) AS low",
            "IF(min_val = max_val, max_val + 0.5D, max_val) AS high",
        )
    )
    guess = f"least(CAST(floor((num - low) / (high - low) * {BINS}) AS INT), {BINS - 1})"
    edge = f"(low + {{}} * ((high - low) / {BINS}))"  # lower edge of a bin
    counted = (
        values.where("num IS NOT NULL")
        .join(F.broadcast(spans), "pos")
        .selectExpr("pos", "num", "low", "high", f"{guess} AS guess")
        .selectExpr(  # the guess may be one off where rounding meets an edge
            "pos",
            f"CASE WHEN num < {edge.format('guess')} THEN guess - 1"
            f" WHEN num >= {edge.format('(guess + 1)')} AND guess < {BINS - 1} THEN guess + 1"
            " ELSE guess END AS bin",
        )
        .groupBy("pos", "bin")
        .agg(F.expr("count(1) AS count"))
    )
    bins = spans.selectExpr("pos", "column", "low", "high", f"explode(sequence(0, {BINS - 1})) AS bin")
    return bins.join(F.broadcast(counted), ["pos", "bin"], "left").selectExpr(
        "column", "bin", f"{edge.format('bin')} AS lower", "coalesce(count, 0) AS count"
    )


def row_completeness(df: DataFrame) -> DataFrame:
    """(nulls_in_row, row_count): rows by their number of empty cells."""
    return df.selectExpr(f"{empty_cells(df)} AS nulls_in_row").groupBy("nulls_in_row").agg(
        F.expr("count(1) AS row_count")
    )


# ---------------------------------------------------------------- profile charts


def _worst_null(profile: DataFrame, limit: int) -> DataFrame:
    return profile.orderBy(F.desc("null_pct"), "ordinal").limit(limit)


def null_by_column(profile: DataFrame, limit: int = 15) -> DataFrame:
    """(column, null_pct) of the columns that miss most."""
    return _worst_null(profile, limit).selectExpr("column", "round(null_pct, 2) AS null_pct")


def null_matrix(scored: DataFrame) -> DataFrame:
    """(column, null_pct, dtype, quality) of every column."""
    return scored.selectExpr("column", "null_pct", "dtype", "quality_score AS quality")


def quality_ranking(scored: DataFrame) -> DataFrame:
    """(column, score), worst first."""
    return scored.orderBy("quality_score", "ordinal").selectExpr(
        "column", "round(quality_score, 1) AS score"
    )


def issue_summary(profile: DataFrame, outliers_above: float = 0) -> DataFrame:
    """One row: how many columns have each kind of issue."""
    tests = dict(ISSUES) | {"outliers": f"outlier_pct > {outliers_above}"}
    return profile.agg(*[F.expr(f"count_if({test}) AS {name}") for name, test in tests.items()])


def issue_mix(profile: DataFrame) -> DataFrame:
    """(name, count) of the issue kinds that occur."""
    rows = ", ".join(f"struct({title(literal(n))} AS name, {n} AS count)" for n, _ in ISSUES)
    return issue_summary(profile).selectExpr(f"inline(array({rows}))").where("count > 0")


def dtype_mix(profile: DataFrame) -> DataFrame:
    """(name, value): columns per dtype."""
    return profile.groupBy("dtype").agg(F.expr("count(1) AS value")).selectExpr(
        "initcap(dtype) AS name", "value"
    )


def penalty_breakdown(table: DataFrame) -> DataFrame:
    """(name, penalty) of the table penalties that matter."""
    from .scoring import PENALTIES

    rows = ", ".join(f"struct({title(literal(p))} AS name, {p} AS penalty)" for p in PENALTIES)
    return (
        table.selectExpr(f"inline(array({rows}))")
        .where("penalty > 0.05")
        .selectExpr("name", "round(penalty, 2) AS penalty")
    )


def health_radar(profile: DataFrame, table: DataFrame) -> DataFrame:
    """(metric, score): six health metrics from 0 to 100."""
    means = profile.agg(
        F.expr("coalesce(avg(null_pct), 0D) AS missing"),
        F.expr("coalesce(avg(outlier_pct) FILTER (WHERE dtype = 'numeric'), 0D) AS outlying"),
    )
    rows = ", ".join(
        f"struct({literal(metric)} AS metric, greatest(0D, 100D - {loss}) AS score)"
        for metric, loss in HEALTH
    )
    penalties = table.select("duplicates", "type_mismatch", "low_cardinality", "deep_issues")
    return side_by_side([means, penalties], []).selectExpr(f"inline(array({rows}))")


def stacked_null(profile: DataFrame) -> DataFrame:
    """(column, valid, null): shares of the ten columns that miss most."""
    return _worst_null(profile, 10).where("null_pct > 0").selectExpr(
        "substring(column, 1, 20) AS column",
        "round(100 - null_pct, 1) AS valid",
        "round(null_pct, 1) AS null",
    )


def top_categories(profile: DataFrame, per_column: int = 3, limit: int = 12) -> DataFrame:
    """(label, count): the most frequent values of the categorical columns."""
    return (
        profile.where("dtype = 'categorical'")
        .selectExpr("ordinal", "column", f"posexplode(slice(top_values, 1, {per_column})) AS (place, top)")
        .orderBy(F.desc("top.n"), "ordinal", "place")
        .limit(limit)
        .selectExpr(
            "concat(column, ': ', substring(top.value, 1, 16)) AS label", "top.n AS count"
        )
    )


def column_health(scored: DataFrame, query: str = "") -> DataFrame:
    """The columns worst first, searched by name, dtype and issue text.

    ``avg_null``, ``needs_attention`` and ``excellent`` speak of all columns.
    """
    everything = Window.partitionBy()
    text = literal(query.strip().lower())
    found = (
        f"contains(lower(column), {text}) OR contains(dtype, {text})"
        f" OR exists(issues, i -> contains(lower(i), {text}))"
    )
    listed = scored.select(
        "ordinal", "column", "dtype", "null_pct", "quality_score", "quality_level", "issues",
        F.avg("null_pct").over(everything).alias("avg_null"),
        F.count_if(F.expr("quality_score < 70")).over(everything).alias("needs_attention"),
        F.count_if(F.expr("quality_score >= 90")).over(everything).alias("excellent"),
    )
    return listed.where(found).orderBy("quality_score", "ordinal")
