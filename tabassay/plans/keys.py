"""Joins on grouping keys that may be NULL, and small results side by side."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import quoted


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys meet; the key columns of ``left`` are kept."""
    kept = [c for c in right.columns if c not in keys]
    renamed = right.selectExpr(
        *[f"{quoted(k)} AS `#k{i}`" for i, k in enumerate(keys)], *map(quoted, kept)
    )
    condition = " AND ".join(f"{quoted(k)} <=> `#k{i}`" for i, k in enumerate(keys))
    joined = left.join(renamed, F.expr(condition), how)
    return joined if how == "left_semi" else joined.selectExpr(*map(quoted, left.columns + kept))


SALTS = 32


def attach(
    rows: DataFrame,
    summary: DataFrame,
    segment_by: list[str],
    spread: str,
    keys: tuple = ("pos",),
    how: str = "inner",
) -> DataFrame:
    """Many rows, each with the summary that has its segment and ``keys``.

    Without segments the summary has a few rows per column of the schema and is broadcast.
    With segments it grows with the data, and one segment may hold a third of the rows: then
    its rows are spread over several tasks by the expression ``spread``, and the summary
    rows (a few numbers each) are repeated for them.
    """
    on = [*segment_by, *keys]
    if not segment_by:
        return join_keys(rows, F.broadcast(summary), on, how)
    salted = rows.selectExpr("*", f"pmod(xxhash64({spread}), {SALTS}) AS `#salt`")
    copies = summary.selectExpr("*", f"explode(sequence(0L, {SALTS - 1}L)) AS `#salt`")
    return join_keys(salted, copies, [*on, "#salt"], how).drop("#salt")


def per_column(summary: DataFrame, segment_by: list[str]) -> DataFrame:
    """Hint a per-column summary as broadcast when its size is bounded.

    Without segments such a table has one row per column of the schema.  With
    segments it grows with the data, so the choice is left to the optimizer.
    """
    return summary if segment_by else F.broadcast(summary)


def settled(*tables: DataFrame) -> list[DataFrame]:
    """Results of a few rows per column of the schema, computed now and once, whatever reads them afterwards.

    All are computed in one job, so they share their shuffles. Their rows pass through the driver, so this is not for tables
    that grow with the data, as those of segments do.
    """
    rows = [t.agg(F.expr(f"collect_list(struct({', '.join(map(quoted, t.columns))})) AS t{i}")) for i, t in enumerate(tables)]
    stacked, spark = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).toArrow(), tables[0].sparkSession
    kept = [stacked[f"t{i}"].combine_chunks().flatten().flatten() for i in range(len(tables))]
    return [spark.createDataFrame(pa.table(k, names=t.columns), t.schema) for k, t in zip(kept, tables)]


def by(segment_by: list[str]) -> list:
    return [F.expr(quoted(s)) for s in segment_by]


def side_by_side(parts: list[DataFrame], segment_by: list[str]) -> DataFrame:
    """Aggregates with one row per segment, put into one row per segment.

    The parts have no column in common but the segment.  They are stacked and folded,
    so nothing is joined when there is no segment to join on.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in stacked.columns if c not in segment_by]
    return stacked.groupBy(*by(segment_by)).agg(
        *[F.expr(f"max({quoted(v)}) AS {quoted(v)}") for v in values]
    )
