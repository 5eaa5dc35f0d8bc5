"""Previews, samples and series: a bounded number of rows, in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions.cells import quoted

SEED = "42"
#: Hex digits of a row's place in the order of a sample: 32 of the key and up to 34 of the row, in steps.
STEP, DIGITS = 5, 70
#: Rows that one task may order.
SORTED = 100_000


def reject_empty(df: DataFrame) -> DataFrame:
    """The table itself; an error when it has no column or no row."""
    if not df.columns or df.isEmpty():
        raise ValueError("File has no rows or columns")
    return df


def _in_full(df: DataFrame, order_by: list[str]) -> list[str]:
    """``order_by``, then all other columns: rows that still tie are equal, so every run shows the same."""
    rest = [f for f in df.schema if f.name not in order_by]
    return [*map(quoted, order_by), *[
        f"to_json({quoted(f.name)})" if isinstance(f.dataType, (T.MapType, T.VariantType)) else quoted(f.name) for f in rest
    ]]


def preview(df: DataFrame, order_by: list[str], limit: int = 50) -> DataFrame:
    """The first rows as text, missing cells blank; ties of ``order_by`` by the other columns, NULLs first."""
    return df.orderBy(*map(F.expr, _in_full(df, order_by))).limit(limit).selectExpr(*[
        f"coalesce({cells.as_text(quoted(f.name), f.dataType)}, '') AS {quoted(f.name)}"
        for f in df.schema
    ])


def row_sample(df: DataFrame, n: int, key: list[str] | None = None) -> DataFrame:
    """Exactly n rows (all when there are fewer), the same rows on every run.

    Rows are taken in the order of a hash of ``key``, of the whole row when it is not
    given; rows with equal keys by their content. A NULL in a key is a value like any other.
    A count per five leading hex digits (a million counts at most) tells how far
    down that order the sample reaches: rows of smaller digits are all taken where they are. Those that share the last digits
    are counted by five further digits, until they are at most ``SORTED``, which one task orders, or equal in all
    digits. So neither a key nor a row that fills the table is ordered in one task.
    """
    if n < 1:
        raise ValueError("a sample has at least one row")
    digest = f"concat({', '.join(map('hex({})'.format, cells.row_digest(df.schema)))}, '{SEED}')"
    if key:
        parts = [f"coalesce(CAST({quoted(k)} AS STRING), '\\0')" for k in key]
        if len(parts) > 1:  # lengths keep ('a', 'bc') apart from ('ab', 'c')
            parts = [f"length({p}), ':', {p}" for p in parts]
        mark = f"md5(concat({', '.join(parts)}, '{SEED}'))"
    else:
        mark = f"md5({digest})"
    # padded, so that every row has the same number of digits
    marked = df.selectExpr(*map(quoted, df.columns), f"rpad(concat({mark}, {digest}), {DIGITS}, '#') AS `#order`")
    order = F.col("#order")
    prefix, before = "", 0
    while len(prefix) < DIGITS:
        last = (
            marked.where(order.startswith(prefix))
            .groupBy(F.substring(order, 1, len(prefix) + STEP).alias("prefix"))
            .agg(F.expr("count(1) AS n"))
            .selectExpr("prefix", "n", f"{before} + sum(n) OVER (ORDER BY prefix) AS upto")
            .where(f"upto >= {n}")
            .agg(F.expr("min_by(struct(prefix, n, upto - n AS before), prefix) AS last"))
        ).first()["last"]
        if last is None:  # fewer than n rows, so all
            return df
        prefix, before = last["prefix"], last["before"]
        if last["n"] <= SORTED:
            break
    at = marked.where(order.startswith(prefix))
    if last["n"] <= SORTED:
        rank = F.row_number().over(Window.orderBy("#order"))
        at = at.withColumn("#rank", rank).where(F.col("#rank") <= n - before).drop("#rank")
    else:  # equal rows
        at = at.limit(n - before)
    return marked.where(order < prefix).unionByName(at).drop("#order")


def column_series(
    df: DataFrame, column: str, order_by: list[str], limit: int = 5000
) -> DataFrame:
    """(position, number, text) of the first rows: numbers if over 60 % of all rows parse; ties as in a preview."""
    c, dtype = quoted(column), df.schema[column].dataType
    number, text = cells.as_number(c, dtype), cells.as_text(c, dtype)
    parsed = df.agg(F.expr(f"count({number}) > 0.6D * greatest(count(1), 1)")).scalar()
    order = ", ".join(_in_full(df, order_by))
    first = (
        df.orderBy(*map(F.expr, _in_full(df, order_by)))
        .limit(limit)
        .selectExpr(
            f"row_number() OVER (ORDER BY {order}) AS position",
            f"{number} AS number",
            f"{text} AS text",
        )
    )
    return first.withColumn("numeric", parsed).selectExpr(
        "position", "IF(numeric, number, NULL) AS number", "IF(numeric, NULL, text) AS text"
    )
