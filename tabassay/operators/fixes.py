"""Allow-listed repairs, table to table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions import fixed_values as fv
from ..functions.cells import quoted
from ..plans.frequency import Frequencies
from ..plans.marks import with_marks
from ..plans.quantiles import exact_quantiles


IMPUTES = ("impute_median", "impute_mode")
#: Bits of the filter of repeated rows: at most 8 MB, whatever the table's size.
REPEAT_BITS = 1 << 26


def fix_drop_nulls(df: DataFrame, column: str) -> DataFrame:
    """Without the rows that miss the column."""
    c = cells.present(quoted(column), df.schema[column].dataType)
    return df.where(f"{c} IS NOT NULL")


def _medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, a column per column: the median of its numbers, from one frequency table."""
    numbers = df.selectExpr(*[
        f"{cells.as_number(quoted(c), df.schema[c].dataType)} AS {quoted(c)}" for c in columns
    ])
    frequencies = Frequencies(numbers, columns, [])
    found = exact_quantiles(frequencies.numbers(), [0.5], [])
    return found.agg(*[
        F.expr(f"max(quantiles[0]) FILTER (WHERE pos = '{frequencies.pos[c]}') AS {quoted(c)}")
        for c in columns
    ])


def _modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, a column per column: the smallest of its most frequent values, kept in its type.

    A row becomes one row per column, copies collapse before the shuffle.
    """
    own = {c: cells.present(quoted(c), df.schema[c].dataType) for c in columns}
    entries = ", ".join(
        "struct(" + ", ".join([f"{i} AS `#i`"] + [
            f"{own[c] if c == wanted else f'CAST(NULL AS {df.schema[c].dataType.simpleString()})'} AS {quoted(c)}"
            for c in columns
        ]) + ")"
        for i, wanted in enumerate(columns)
    )
    filled = " OR ".join(f"{quoted(c)} IS NOT NULL" for c in columns)
    counted = (
        df.selectExpr(f"inline(array({entries}))").where(filled)
        .groupBy("`#i`", *map(quoted, columns)).agg(F.expr("count(1) AS `#n`"))
    )
    return counted.agg(*[
        F.expr(f"min_by({quoted(c)}, struct(-`#n`, {quoted(c)})) FILTER (WHERE `#i` = {i}) AS {quoted(c)}")
        for i, c in enumerate(columns)
    ])


def _imputed(df: DataFrame, source: DataFrame, fixes: dict[str, str]) -> DataFrame:
    """``df`` with the missing cells of the columns filled by what ``source`` says of them.

    The medians are one plan and the modes another, whatever the number of columns.
    """
    for kind, of in (("impute_median", _medians), ("impute_mode", _modes)):
        columns = [c for c, fix in fixes.items() if fix == kind]
        if not columns:
            continue
        filled = {}
        for column in columns:
            dtype = df.schema[column].dataType
            choices = [
                F.expr(cells.present(quoted(column), dtype)), F.col(f"`#fill`.{quoted(column)}").cast(dtype)
            ]
            if isinstance(dtype, T.StringType):
                choices.append(F.lit(""))
            filled[column] = F.coalesce(*choices)
        row = of(source, columns).select(F.struct(*map(quoted, columns)).alias("#fill"))
        df = df.withColumn("#fill", row.scalar()).withColumns(filled).drop("#fill")
    return df


def fix_impute_median(df: DataFrame, column: str) -> DataFrame:
    """Missing cells get the median of the numbers: as text in a text column
    (blank when there is none), as a number in a typed one, which keeps its type."""
    return _imputed(df, df, {column: "impute_median"})


def fix_impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Missing cells get the smallest of the most frequent values (blank text if none)."""
    return _imputed(df, df, {column: "impute_mode"})


def fix_strip_whitespace(df: DataFrame, column: str) -> DataFrame:
    """Trimmed cells; a missing cell stays missing."""
    text = cells.as_text(quoted(column), df.schema[column].dataType)
    return df.withColumns({column: F.expr(cells.strip(text))})


def fix_dedupe(df: DataFrame, digests_first: bool = False) -> DataFrame:
    """Each distinct row once.

    ``digests_first`` is for wide rows of which few repeat, on a cluster: digests are counted first, and a filter of fixed size marks
    those that repeat. Rows it does not mark occur once and stay where they are, only the others are shuffled whole
    and compared, so a chance match costs time and no row. The table, which must read the same each time, is read three
    times. Rows that compare equal must hash alike, so text that ignores case or accents by its type takes the plain way.
    """
    if not digests_first or "collate" in df.schema.simpleString():
        return df.dropDuplicates()
    one, two = cells.row_digest(df.schema)
    copies = df.selectExpr(f"{one} AS hash", f"{two} AS other").groupBy("hash", "other").count().where("count > 1")
    rows = df.select(F.struct("*").alias("row"), F.expr(one).alias("hash"))
    marked = with_marks(rows, copies, "marked", REPEAT_BITS)
    once, doubtful = (marked.where(which).select("row.*") for which in ("NOT marked", "marked"))
    return once.unionByName(doubtful.dropDuplicates())


def apply_fixes(df: DataFrame, fixes: dict[str, str]) -> DataFrame:
    """Repairs by column, in the given order; ``dedupe`` anywhere comes first.

    Each column has one repair, so what is imputed depends on the rows dropped before and on
    no other repair: the imputes between two drops share their plans.
    """
    if not fixes:
        raise ValueError("No fixes specified")
    unknown = sorted(set(fixes.values()) - set(fv.FIX_TYPES))
    if unknown:
        raise ValueError(f"Unknown fix type(s): {', '.join(unknown)}")
    absent = [c for c in fixes if c not in df.columns]
    if absent:
        raise ValueError(f"Unknown column(s): {', '.join(absent)}")
    if "dedupe" in fixes.values():
        df = fix_dedupe(df)
    source, waiting = df, {}  # source: the rows that are left, their cells as they were
    for column, fix in fixes.items():
        if fix in IMPUTES:
            waiting[column] = fix
        elif fix == "strip_whitespace":
            df = fix_strip_whitespace(df, column)
        elif fix == "drop_nulls":
            df, waiting = _imputed(df, source, waiting), {}
            df, source = fix_drop_nulls(df, column), fix_drop_nulls(source, column)
    return _imputed(df, source, waiting)


def suggest_fixes(profile: DataFrame) -> DataFrame:
    """(ordinal, column, fix): what the profile of a column calls for."""
    return profile.selectExpr(
        "ordinal",
        "column",
        "explode(array_compact(array("
        " CASE WHEN null_pct > 50 THEN 'drop_nulls'"
        "  WHEN null_pct > 0 AND dtype = 'numeric' THEN 'impute_median'"
        "  WHEN null_pct > 0 THEN 'impute_mode' END,"
        " CASE WHEN whitespace_count > 0 THEN 'strip_whitespace' END))) AS fix",
    )
