"""Column profiles: one row per (segment, column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions import fixed_values as fv
from ..functions.cells import literal, quoted
from ..plans.frequency import TEXT, Frequencies, kind_of, positions
from ..plans.keys import attach, by, join_keys, per_column
from ..plans.quantiles import exact_quantiles
from ..plans.slices import DEFAULT, Slicing

QUARTILES = [0.25, 0.5, 0.75]


def share(part: str, whole: str) -> str:
    """Percentage, 0 when there is nothing to divide by."""
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0D END"


def _count(condition: str) -> str:
    return f"coalesce(sum(n) FILTER (WHERE {condition}), 0)"


def column_list(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, ordinal, column): as many rows as the schema has fields."""
    pos = positions(df)
    rows = ", ".join(
        f"struct('{pos[c]}' AS pos, {df.columns.index(c)} AS ordinal, {literal(c)} AS column)"
        for c in columns
    )
    return df.sparkSession.range(1).selectExpr(f"inline(array({rows}))")


def _column_facts(frequencies: Frequencies) -> DataFrame:
    """Counts, moments and flags of each column, from its distinct values."""
    keys = frequencies.keys
    facts = frequencies.facts().groupBy(*[F.expr(k) for k in keys]).agg(*map(F.expr, [
        "sum(n) AS total_count",
        f"{_count('NOT filled')} AS null_count",
        "count_if(filled) AS unique_count",
        f"{_count('num IS NOT NULL')} AS parsed_count",
        "try_divide(sum(num * n), sum(n) FILTER (WHERE num IS NOT NULL)) AS mean",
        "min(num) AS min_val",
        "max(num) AS max_val",
        f"{_count('num < 0')} AS negatives",
        f"{_count('numeric_like')} AS numeric_like",
        f"{_count('outer_space')} AS outer_space",
        f"{_count('mojibake')} AS mojibake",
        f"{_count('bad_email')} AS bad_email",
        f"{_count('code_like')} AS code_like",
        f"{_count('filled')} AS code_base",
        "coalesce(bit_count(bit_or(shape)), 0) AS shapes",
    ]))
    # The generator hands all columns on together, so readers that need only some of them
    # still ask for the same aggregate, and it is computed once.
    values = [c for c in facts.columns if c not in frequencies.segment_by and c != "pos"]
    return facts.selectExpr(*keys, f"inline(array(struct({', '.join(values)})))")


def _head_facts(
    df: DataFrame, columns: list[str], order_by: list[str], segment_by: list[str]
) -> DataFrame:
    """The prefix heuristics over the first non-null values in ``order_by`` order.

    One scan for all text columns; a task shuffles at most a hundred rows of each.
    """
    pos = positions(df)
    keys = [*by(segment_by), F.col("pos")]
    order = [f"`#o{i}`" for i in range(len(order_by))]
    entries = ", ".join(
        f"struct('{pos[c]}' AS pos, {cells.as_text(quoted(c), df.schema[c].dataType)} AS value)"
        for c in columns
    )
    head = (
        df.selectExpr(
            *map(quoted, segment_by), *[f"{quoted(c)} AS {o}" for c, o in zip(order_by, order)],
            f"inline(array({entries}))",
        )
        .where("value IS NOT NULL")
        .withColumn("row", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*map(F.expr, order), "value")))
        .where(F.col("row") <= fv.DATE_HEAD)
    )
    code_like = cells.mixes_letters_and_digits(cells.strip("value"))
    return head.groupBy(*keys).agg(*map(F.expr, [
        f"coalesce(bit_count(bit_or({cells.date_shape_bit(cells.strip('value'))})), 0) AS head_shapes",
        f"coalesce(bool_or(row <= {fv.EMAIL_HEAD} AND contains(value, '@')), false) AS head_has_at",
        f"count_if(row <= {fv.ID_HEAD} AND {code_like}) AS head_code_like",
        f"count_if(row <= {fv.ID_HEAD}) AS head_code_base",
    ]))


def _decide_dtype(facts: DataFrame, id_heuristic: bool) -> DataFrame:
    """numeric or categorical, per column."""
    identifier = (
        "cardinality > 0.65 AND unique_count > 50"
        " AND (code_like / greatest(code_base, 1) > 0.2 OR cardinality > 0.7)"
        if id_heuristic
        else "false"
    )
    unread = "total_count - parsed_count"
    return facts.selectExpr("*", "unique_count / total_count AS cardinality").selectExpr(
        "*",
        f"CASE WHEN {identifier} THEN 'categorical'"
        f" WHEN {unread} - null_count > 0.3 * total_count THEN 'categorical'"
        f" WHEN {unread} < 0.3 * total_count THEN 'numeric' ELSE 'categorical' END AS dtype",
    )


def _spread(numbers: DataFrame, quartiles: DataFrame, segment_by: list[str]) -> DataFrame:
    """Second pass: everything measured against the quartiles of the column.

    Squares are taken around the median, so that the variance does not cancel out.
    """

    def outside(width: float) -> str:
        return f"num < q1 - {width}D * (q3 - q1) OR num > q3 + {width}D * (q3 - q1)"

    return (
        attach(numbers, quartiles, segment_by, "num")
        .groupBy(*by(segment_by), "pos")
        .agg(*map(F.expr, [
            f"{_count(outside(1.5))} AS outliers",
            f"{_count(outside(5.0))} AS extremes",
            "sum(n * (num - median)) / sum(n) AS shift",
            "sum(n * (num - median) * (num - median)) AS squares",
        ]))
    )


def profile_table(
    df: DataFrame,
    columns: list[str] | None = None,
    *,
    segment_by: list[str] | tuple = (),
    order_by: list[str] | tuple = (),
    id_heuristic: bool = True,
    slicing: Slicing = DEFAULT,
) -> DataFrame:
    """Profile every column: one row per (segment, column), lazily.

    The date-shape and e-mail heuristics look at 100 and 10 values of a text column, as a
    look at all would find some date or ``@`` in any large enough column.  ``order_by`` names
    a row order; with it these are the first non-null values, and the identifier heuristic
    looks at the first 50.  Without it they are the distinct values with the smallest MD5,
    and the identifier heuristic, which is a share, looks at all values.
    """
    segment_by, order_by = list(segment_by), list(order_by)
    columns = [c for c in (columns or df.columns) if c not in segment_by]
    group, keys = [*segment_by, "pos"], [quoted(s) for s in segment_by] + ["pos"]
    dtypes = {c: df.schema[c].dataType for c in columns}
    frequencies = Frequencies(df, columns, segment_by)

    facts = _column_facts(frequencies)
    texts = [c for c in columns if kind_of(dtypes[c]) == TEXT]
    parts = []
    if not texts:
        facts = facts.selectExpr("*", "CAST(NULL AS INT) AS head_shapes", "false AS head_has_at")
    elif order_by:
        head = _head_facts(df, texts, order_by, segment_by)
        joined = join_keys(facts, per_column(head, segment_by), group, "left")
        codes = ["code_like", "code_base"]
        facts = joined.selectExpr(
            *[f"coalesce(head_{c}, {c}) AS {c}" if c in codes else quoted(c) for c in facts.columns],
            "head_shapes", "head_has_at",
        )
    else:
        parts.append(frequencies.heads())
    facts = _decide_dtype(facts, id_heuristic)

    numbers = frequencies.numbers()
    readable = any(isinstance(t, cells.NUMERIC) or kind_of(t) == TEXT for t in dtypes.values())
    if readable:
        quartiles = exact_quantiles(numbers, QUARTILES, segment_by, slicing).selectExpr(
            *keys, "quantiles[0] AS q1", "quantiles[1] AS median", "quantiles[2] AS q3"
        )
        parts += [quartiles, _spread(numbers, quartiles, segment_by)]
    categorical = facts.where("dtype = 'categorical'").selectExpr(*keys)
    parts.append(frequencies.top_values(categorical))

    known = column_list(df, columns)
    rows = (
        join_keys(facts, per_column(known, []), ["pos"])
        if segment_by
        else known.join(facts, "pos", "left")  # a table without rows still has columns
    )
    for part in parts:
        rows = join_keys(rows, per_column(part, segment_by), group, "left")
    if not readable:
        absent = ["q1", "median", "q3", "outliers", "extremes", "shift", "squares"]
        rows = rows.selectExpr("*", *[f"CAST(NULL AS DOUBLE) AS {c}" for c in absent])
    return _finish(rows, segment_by)


def _finish(rows: DataFrame, segment_by: list[str]) -> DataFrame:
    keys = [quoted(s) for s in segment_by]
    numeric = "dtype = 'numeric'"

    def count(name: str, when: str) -> str:
        return f"CAST(CASE WHEN {when} THEN coalesce({name}, 0) ELSE 0 END AS BIGINT)"

    text = f"NOT {numeric}"
    asked = f"{text} AND (contains(lower(column), 'email') OR head_has_at)"
    filled = "(total_count - null_count)"
    counted = rows.selectExpr(
        *keys,
        "ordinal",
        "column",
        "coalesce(dtype, 'numeric') AS dtype",
        *[f"coalesce({c}, 0) AS {c}" for c in ("total_count", "null_count", "unique_count", "parsed_count")],
        "coalesce(cardinality, 0D) AS cardinality",
        *[
            f"CASE WHEN {numeric} THEN {c} END AS {c}"
            for c in ("mean", "min_val", "q1", "median", "q3", "max_val")
        ],
        f"CASE WHEN {numeric} AND parsed_count = 1 THEN 0D WHEN {numeric} AND parsed_count > 1 THEN"
        " sqrt(greatest((squares - parsed_count * shift * shift) / (parsed_count - 1), 0D)) END AS std",
        f"{count('outliers', numeric)} AS outlier_count",
        f"{count('extremes', numeric)} AS extreme_outlier_count",
        f"{count('negatives', numeric)} AS negative_count",
        f"CASE WHEN {text} THEN top_values END AS top_values",
        f"{count('coalesce(head_shapes, shapes)', text)} AS date_format_count",
        f"{count('outer_space', text)} AS whitespace_count",
        f"{count('mojibake', text)} AS encoding_issues",
        f"{count('bad_email', asked)} AS invalid_email_count",
        "numeric_like",
    )
    return counted.selectExpr(
        *keys, "ordinal", "column", "dtype", "total_count", "null_count",
        f"{share('null_count', 'total_count')} AS null_pct",
        "unique_count", "cardinality", "parsed_count",
        "mean", "std", "min_val", "q1", "median", "q3", "max_val",
        "outlier_count", f"{share('outlier_count', 'parsed_count')} AS outlier_pct",
        "extreme_outlier_count",
        "negative_count", f"{share('negative_count', 'parsed_count')} AS negative_pct",
        "top_values", "date_format_count",
        "whitespace_count", f"{share('whitespace_count', filled)} AS whitespace_pct",
        "encoding_issues",
        "invalid_email_count", f"{share('invalid_email_count', filled)} AS invalid_email_pct",
        f"CASE WHEN {numeric} THEN {share(f'({filled} - parsed_count)', 'total_count')}"
        f" WHEN numeric_like > 0 AND numeric_like < {filled}"
        f" THEN (1 - numeric_like / {filled}) * 100 ELSE 0D END AS mixed_type_pct",
    )
