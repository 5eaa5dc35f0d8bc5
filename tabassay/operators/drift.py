"""Drift of a table against a baseline: columns, types, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import literal, quoted
from ..plans.frequency import TEXT, kind_of
from ..plans.keys import attach
from ..plans.slices import DEFAULT, Slicing, in_slices

MIN_VALUES = 10  # a side needs more numbers than this
SIGNIFICANCE = 0.05


def _listed(spark, rows: list[str], schema: str) -> DataFrame:
    """Rows known from the schemas alone."""
    if rows:
        return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")
    return spark.createDataFrame([], schema)


def columns_added_removed(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change): added or removed, by name."""
    old, new = set(baseline.columns), set(current.columns)
    rows = [(c, "added") for c in sorted(new - old)] + [(c, "removed") for c in sorted(old - new)]
    entries = [f"struct({literal(c)} AS column, '{change}' AS change)" for c, change in rows]
    return _listed(current.sparkSession, entries, "column string, change string")


def type_changed(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(column, old_type, new_type) of common columns whose storage type differs."""
    entries = [
        f"struct({literal(c)} AS column,"
        f" {literal(baseline.schema[c].dataType.simpleString())} AS old_type,"
        f" {literal(current.schema[c].dataType.simpleString())} AS new_type)"
        for c in sorted(set(baseline.columns) & set(current.columns))
        if baseline.schema[c].dataType != current.schema[c].dataType
    ]
    return _listed(current.sparkSession, entries, "column string, old_type string, new_type string")


def _values(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """(pos, num, old, new) rows over the numbers of some columns; pos is the column."""
    wide = df.selectExpr(*[
        f"{cells.as_number(quoted(c), df.schema[c].dataType)} AS {quoted(c)}" for c in columns
    ])
    long = wide.unpivot([], [F.col(quoted(c)) for c in columns], "pos", "num")
    old = int(side == "old")
    return long.where("num IS NOT NULL").selectExpr("pos", "num", f"{old} AS old", f"{1 - old} AS new")


def ks_statistic(
    baseline: DataFrame,
    current: DataFrame,
    columns: list[str] | None = None,
    slicing: Slicing = DEFAULT,
) -> DataFrame:
    """(column, n_baseline, n_current, statistic): two-sample Kolmogorov-Smirnov D.

    D needs the running counts of both sides over all distinct values of a column.  The
    values are cut into slices of about equal size; a running sum inside each slice starts
    from the totals of the slices before it.  So no task orders a whole column, and the
    answer does not depend on where the cuts fall.
    """
    common = [c for c in baseline.columns if c in current.columns]
    columns = [
        c for c in (columns or common)
        if any(
            isinstance(t, cells.NUMERIC) or kind_of(t) == TEXT
            for t in (baseline.schema[c].dataType, current.schema[c].dataType)
        )
    ]
    if not columns:
        schema = "column string, n_baseline bigint, n_current bigint, statistic double"
        return current.sparkSession.createDataFrame([], schema)
    rows = _values(baseline, columns, "old").unionByName(_values(current, columns, "new"))
    counted = rows.groupBy("pos", "num").agg(F.expr("sum(old) AS old"), F.expr("sum(new) AS new"))
    sliced = in_slices(counted, [], slicing)
    column = Window.partitionBy("pos")
    earlier = column.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("pos", "slice").agg(F.expr("sum(old) AS old"), F.expr("sum(new) AS new"))
    starts = sums.select(
        "pos",
        "slice",
        F.coalesce(F.sum("old").over(earlier), F.lit(0)).alias("old_before"),
        F.coalesce(F.sum("new").over(earlier), F.lit(0)).alias("new_before"),
        F.sum("old").over(column).alias("n_baseline"),
        F.sum("new").over(column).alias("n_current"),
    ).where(f"n_baseline > {MIN_VALUES} AND n_current > {MIN_VALUES}")
    inside = Window.partitionBy("pos", "slice").orderBy("num")
    running = sliced.select(
        "pos",
        "slice",
        F.sum("old").over(inside).alias("old_upto"),
        F.sum("new").over(inside).alias("new_upto"),
    )
    apart = "abs((old_before + old_upto) / n_baseline - (new_before + new_upto) / n_current)"
    return (
        attach(running, starts, [], "slice", ("pos", "slice"))
        .groupBy("pos", "n_baseline", "n_current")
        .agg(F.expr(f"max({apart}) AS statistic"))
        .withColumnRenamed("pos", "column")
    )


def with_p_value(statistics: DataFrame) -> DataFrame:
    """The statistics with ``p_value``, the asymptotic Kolmogorov series."""
    reach = "statistic * sqrt(n_baseline / (n_baseline + n_current) * n_current)"
    series = (
        "2D * aggregate(sequence(1, 100), 0D,"
        " (s, k) -> s + IF(k % 2 = 1, 1D, -1D) * exp(-2D * k * k * reach * reach))"
    )
    return statistics.selectExpr("*", f"{reach} AS reach").selectExpr(
        *statistics.columns,
        f"CASE WHEN reach < 0.2D THEN 1D ELSE least(greatest({series}, 0D), 1D) END AS p_value",
    )


def distribution_shifted(
    baseline: DataFrame, current: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """The columns whose distributions differ significantly, with statistic and p_value."""
    tested = with_p_value(ks_statistic(baseline, current, columns))
    return tested.where(f"p_value < {SIGNIFICANCE}D")


def schema_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change, old_type, new_type, p_value), one row per change.

    Pass the whole current table, also when its profile was made from a sample.
    """
    nothing = "CAST(NULL AS STRING)"
    names = columns_added_removed(baseline, current).selectExpr(
        "column", "change", f"{nothing} AS old_type", f"{nothing} AS new_type",
        "CAST(NULL AS DOUBLE) AS p_value",
    )
    types = type_changed(baseline, current).selectExpr(
        "column", "'type_changed' AS change", "old_type", "new_type",
        "CAST(NULL AS DOUBLE) AS p_value",
    )
    shifts = distribution_shifted(baseline, current).selectExpr(
        "column", "'distribution_shifted' AS change", f"{nothing} AS old_type",
        f"{nothing} AS new_type", "p_value",
    )
    return names.unionByName(types).unionByName(shifts)


def drift_summary(drift: DataFrame) -> DataFrame:
    """(breaking, warnings, summary) of the drift rows."""
    return drift.agg(
        F.expr("count_if(change IN ('type_changed', 'removed')) AS breaking"),
        F.expr("count_if(change IN ('added', 'distribution_shifted')) AS warnings"),
    ).selectExpr(
        "breaking", "warnings",
        "concat(breaking, ' breaking changes, ', warnings, ' warnings') AS summary",
    )
