"""The value-frequency table: one row per (segment, column, distinct value).

It is the only wide shuffle of a profile.  Map-side aggregation collapses
repeated values before the shuffle, so a value that fills a third of a column
travels as one row per task.  Everything expensive (pattern tests, number
parsing, printing) runs on distinct values after it.

A value lives in one of three typed slots: ``w`` whole numbers (also timestamps,
dates and booleans), ``r`` reals, ``t`` text (also decimals, which keep every digit).

Of a long text only its first letters (``t``), a digest of 128 bits (``d``), its number (``r``)
and the results of the tests (``flags``) are shuffled.  The few long texts that are shown are
fetched afterwards, by a second scan that a filter of fixed size cuts down to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions import fixed_values as fv
from ..functions.cells import quoted
from .keys import attach, join_keys

WHOLE, REAL, DECIMAL, TEXT = "whole", "real", "decimal", "text"
MOMENT, DAY, FLAG = "moment", "day", "flag"

#: Texts of more letters are keyed by a digest; of these, so many letters are kept.
SHORT = 32
#: Bits of the filter that finds the texts to fetch: half a megabyte, whatever the table.
FILTER_BITS, BUCKET_BITS = 1 << 22, 1 << 15
#: Bits of ``flags``; the date shapes follow from ``SHAPES`` on.
TESTS = ("numeric_like", "outer_space", "mojibake", "bad_email", "code_like", "has_at")
SHAPES = 8
DIGEST = "unhex(md5(CAST(t AS BINARY)))"


def _text_tests() -> dict[str, str]:
    """What is tested on a text ``t`` and its stripped form ``s``."""
    return {
        "numeric_like": cells.looks_numeric("s"),
        "outer_space": "t != s",
        "mojibake": cells.has_mojibake("t"),
        "bad_email": f"{cells.email_fault('s')} != ''",
        "code_like": cells.mixes_letters_and_digits("s"),
        "has_at": "contains(t, '@')",
    }


def _flags() -> str:
    bits = [f"IF({test}, {1 << TESTS.index(name)}, 0)" for name, test in _text_tests().items()]
    shape = f"shiftleft(coalesce({cells.date_shape_bit('s')}, 0), {SHAPES})"
    return " | ".join([*bits, shape])


def _flag(name: str) -> str:
    """A test's result: from the flags of a long text, else from the text itself."""
    return (
        f"CASE WHEN d IS NOT NULL THEN flags & {1 << TESTS.index(name)} != 0"
        f" ELSE s IS NOT NULL AND {_text_tests()[name]} END"
    )


def kind_of(dtype: T.DataType) -> str:
    for kind, types in (
        (WHOLE, cells.INTEGRAL),
        (REAL, cells.REAL),
        (DECIMAL, T.DecimalType),
        (MOMENT, (T.TimestampType, T.TimestampNTZType)),
        (DAY, T.DateType),
        (FLAG, T.BooleanType),
    ):
        if isinstance(dtype, types):
            return kind
    return TEXT


def positions(df: DataFrame) -> dict[str, str]:
    """A short key per column, used in place of its name inside the plans."""
    return {c: f"#{i}" for i, c in enumerate(df.columns)}


def _slots(c: str, dtype: T.DataType) -> tuple[str, str, str]:
    kind = kind_of(dtype)
    whole = {
        WHOLE: f"CAST({c} AS BIGINT)",
        MOMENT: f"unix_micros(CAST({c} AS TIMESTAMP))",
        DAY: f"CAST(unix_date({c}) AS BIGINT)",
        FLAG: f"CAST({c} AS BIGINT)",
    }.get(kind, "CAST(NULL AS BIGINT)")
    real = f"CAST({cells.present(c, dtype)} AS DOUBLE)" if kind == REAL else "CAST(NULL AS DOUBLE)"
    text = f"CAST({c} AS STRING)" if kind in (DECIMAL, TEXT) else "CAST(NULL AS STRING)"
    return whole, real, text


class Frequencies:
    """The frequency table of some columns, and the views the operators read from it."""

    def __init__(self, df: DataFrame, columns: list[str], segment_by: list[str]):
        self.pos = positions(df)
        self.segment_by = segment_by
        self.keys = [quoted(s) for s in segment_by] + ["pos"]
        self.kinds: dict[str, list[str]] = {}
        # Segments travel as unpivoted values: as identifiers they would keep their column
        # ids, and Spark would then not see that two readers of the table are alike.
        kept = [f"`#s{i}`" for i in range(len(segment_by))]
        wide = [f"{quoted(s)} AS {k}" for s, k in zip(segment_by, kept)]
        entries = []
        for name in columns:
            dtype, pos = df.schema[name].dataType, self.pos[name]
            self.kinds.setdefault(kind_of(dtype), []).append(pos)
            slots = [f"`{pos}{slot}`" for slot in "wrt"]
            wide += [f"{e} AS {s}" for e, s in zip(_slots(quoted(name), dtype), slots)]
            entries.append(f"({', '.join([*kept, *slots])}) AS `{pos}`")
        outputs = [*map(quoted, segment_by), "w", "r", "t"]
        unpivot = f"UNPIVOT INCLUDE NULLS (({', '.join(outputs)}) FOR pos IN ({', '.join(entries)}))"
        long = df.sparkSession.sql(
            "SELECT * FROM {wide} " + unpivot.replace("{", "{{").replace("}", "}}"),
            wide=df.selectExpr(*wide),
        )
        self.long = long
        if TEXT in self.kinds:
            long = (
                long.selectExpr(*self.keys, "w", "r", "t", f"CASE WHEN {self._is_long()} THEN {cells.strip('t')} END AS s")
                .selectExpr(
                    *self.keys, "w",
                    f"CASE WHEN s IS NOT NULL THEN {cells.parse_number('s')} ELSE r END AS r",
                    f"CASE WHEN s IS NOT NULL THEN left(t, {SHORT}) ELSE t END AS t",
                    f"CASE WHEN s IS NOT NULL THEN {DIGEST} END AS d",
                    f"CASE WHEN s IS NOT NULL THEN {_flags()} END AS flags",
                )
            )
        values = ["w", "r", "t", *(["d", "flags"] if TEXT in self.kinds else [])]
        table = long.groupBy(*[F.expr(k) for k in self.keys], *values).agg(F.expr("count(1) AS n"))
        self.table = table if TEXT in self.kinds else table.selectExpr("*", "CAST(NULL AS BINARY) AS d", "0 AS flags")

    def _of(self, *kinds: str) -> str:
        """Condition: the row belongs to a column of one of these kinds."""
        found = [p for kind in kinds for p in self.kinds.get(kind, [])]
        return f"pos IN ({cells.listed(found)})" if found else "false"

    def _is_long(self) -> str:
        return f"length(t) > {SHORT} AND {self._of(TEXT)}"

    def _read(self) -> DataFrame:
        """The table with ``s``, the stripped text of short texts in text columns.

        n > 0 always holds.  It ties the values to their count, so that filters on them
        stay above the aggregation and all readers of the table share one shuffle.
        """
        stripped = f"CASE WHEN n > 0 AND d IS NULL AND {self._of(TEXT)} THEN {cells.strip('t')} END AS s"
        return self.table.selectExpr(*self.keys, "n", "w", "r", "t", "d", "flags", stripped)

    def _number(self) -> str:
        choices = [
            (WHOLE, f"WHEN w IS NOT NULL AND {self._of(WHOLE)} THEN CAST(w AS DOUBLE)"),
            (DECIMAL, f"WHEN {self._of(DECIMAL)} THEN CAST(t AS DOUBLE)"),
            (TEXT, f"WHEN s IS NOT NULL THEN {cells.parse_number('s')}"),
        ]
        whens = " ".join(text for kind, text in choices if kind in self.kinds)
        return f"CASE WHEN n > 0 THEN CASE WHEN r IS NOT NULL THEN r {whens} END END"

    def _printed(self) -> str:
        return (
            f"CASE WHEN t IS NOT NULL THEN t WHEN r IS NOT NULL THEN CAST(r AS STRING)"
            f" WHEN {self._of(MOMENT)} THEN CAST(timestamp_micros(w) AS STRING)"
            f" WHEN {self._of(DAY)} THEN CAST(date_from_unix_date(CAST(w AS INT)) AS STRING)"
            f" WHEN {self._of(FLAG)} THEN CAST(w = 1 AS STRING)"
            f" ELSE CAST(w AS STRING) END"
        )

    def numbers(self) -> DataFrame:
        """(segment..., pos, num, n) over the values that are numbers.

        The generator keeps the filter above the parsing, which else would run twice. Where texts are parsed, a shuffle of the numbers
        follows, which all readers share, so that a text is parsed for them once.
        """
        parsed = self._read().selectExpr(*self.keys, "n", f"explode(array({self._number()})) AS num").where("num IS NOT NULL")
        if TEXT not in self.kinds:
            return parsed.selectExpr(*self.keys, "num", "n")
        once = parsed.groupBy(*[F.expr(k) for k in self.keys], "num").agg(F.expr("sum(n) AS n"))
        return once.selectExpr(*self.keys, "CASE WHEN n > 0 THEN num END AS num", "n")

    def facts(self) -> DataFrame:
        """What each distinct value says about its column; typed values skip text tests."""
        filled = "(w IS NOT NULL OR r IS NOT NULL OR t IS NOT NULL)"
        tests = {name: _flag(name) if TEXT in self.kinds else "false" for name in TESTS if name != "has_at"}
        typed_number = self._of(WHOLE, REAL, DECIMAL)
        year = f"w BETWEEN 1000 AND 9999 AND {self._of(WHOLE)}"
        day = f"w IS NOT NULL AND {self._of(DAY)}"
        return (
            self._read()
            .selectExpr(
                *self.keys, "n", "w", "(s IS NOT NULL OR d IS NOT NULL) AS is_text", f"{filled} AS filled",
                f"{self._number()} AS num",
                *[f"{test} AS {name}" for name, test in tests.items()],
            )
            .selectExpr(
                *self.keys, "n", "filled", "num",
                f"(numeric_like OR (filled AND {typed_number})) AS numeric_like",
                "outer_space", "mojibake", "code_like",
                "(bad_email OR (filled AND NOT is_text)) AS bad_email",
                f"CASE WHEN {year} THEN {cells.shape_bit('YYYY')}"
                f" WHEN {day} THEN {cells.shape_bit('ISO')} END AS shape",
            )
        )

    def heads(self) -> DataFrame:
        """(segment..., pos, head_shapes, head_has_at) of the text columns, from a few distinct values.

        Those with the smallest MD5 are looked at, so the size of a table does not decide
        what is found.  Results of the tests are shuffled, not texts, and of each column
        and task only as many as are looked at.
        """
        keys = [F.expr(c) for c in self.keys]
        order = Window.partitionBy(*keys).orderBy("digest")
        return (
            self._read()
            .where("s IS NOT NULL OR d IS NOT NULL")
            .selectExpr(
                *self.keys, f"coalesce(d, {DIGEST}) AS digest", f"{_flag('has_at')} AS has_at",
                f"CASE WHEN d IS NOT NULL THEN shiftright(flags, {SHAPES}) ELSE {cells.date_shape_bit('s')} END AS shape",
            )
            .withColumn("row", F.row_number().over(order))
            .where(F.col("row") <= fv.DATE_HEAD)
            .groupBy(*keys)
            .agg(*map(F.expr, [
                "coalesce(bit_count(bit_or(shape)), 0) AS head_shapes",
                f"coalesce(bool_or(row <= {fv.EMAIL_HEAD} AND has_at), false) AS head_has_at",
            ]))
        )

    def _fetched(self, chosen: DataFrame) -> DataFrame:
        """(segment..., pos, d, whole): the long texts that have a chosen digest.

        A second scan keeps the texts whose digest has its bit set in a filter of fixed size, and only these are shuffled.  The
        filter may let a few others pass; they find no partner.  Without long texts to show, the filter is empty and
        the scan does not run.
        """
        place = f"pmod(xxhash64(d), {FILTER_BITS})"
        filter_ = (
            chosen.where("d IS NOT NULL").selectExpr(f"{place} AS b").groupBy(F.expr(f"b div {BUCKET_BITS} AS bucket"))
            .agg(F.expr(f"bitmap_construct_agg(b % {BUCKET_BITS}) AS bits"))
        )
        at = f"({place} % {BUCKET_BITS})"
        byte = f"CAST(conv(hex(substring(bits, CAST({at} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
        texts = self.long.where(self._is_long()).selectExpr(*self.keys, "t AS whole", f"{DIGEST} AS d")
        found = texts.join(F.broadcast(filter_), F.expr(f"bucket = {place} div {BUCKET_BITS}"))
        found = found.where(f"shiftright({byte}, CAST({at} % 8 AS INT)) & 1 = 1")
        return found.groupBy(*[F.expr(k) for k in self.keys], "d").agg(F.expr("min(whole) AS whole"))

    def top_values(self, wanted: DataFrame, k: int = 5) -> DataFrame:
        """The k most frequent values of the ``wanted`` columns, ties by value.

        Only k rows per column and task are shuffled, and those that cannot be told from them without
        their whole texts: the rank is limited before it.
        """
        keys = [F.expr(c) for c in self.keys]
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), "w", "r", "t")
        values = self.table.selectExpr(*self.keys, "w", "IF(t IS NULL, r, NULL) AS r", "t", "d", "n")
        rows = attach(values, wanted, self.segment_by, "w, r, t, d")
        rows = rows.where("CASE WHEN n > 0 THEN coalesce(w, r) IS NOT NULL OR t IS NOT NULL END")
        if TEXT in self.kinds:
            chosen = rows.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= k).drop("rank")
            rows = join_keys(chosen, self._fetched(chosen), [*self.segment_by, "pos", "d"], "left")
            rows = rows.selectExpr(*self.keys, "w", "r", "coalesce(whole, t) AS t", "n")
        best = (
            rows.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .selectExpr(*self.keys, "rank", f"{self._printed()} AS value", "n")
        )
        entries = "array_sort(collect_list(struct(rank, value, n)))"  # at most k of them
        return best.groupBy(*keys).agg(
            F.expr(f"transform({entries}, e -> struct(e.value AS value, e.n AS n)) AS top_values")
        )
