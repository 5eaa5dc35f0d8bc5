"""SQL expressions for one cell.  All are native: no Python runs per row.

Each function takes and returns expression text, ready for ``selectExpr`` or
``F.expr``; ``quoted`` turns a column name into such text.  The tests take text that
is already stripped where they say so, so that a query strips a value once.
"""

from __future__ import annotations

from pyspark.sql import types as T

from . import fixed_values as fv

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + REAL + (T.DecimalType,)


def quoted(name: str) -> str:
    """A column by its literal name, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """Any text as a string literal."""
    safe = "".join(
        c if c.isprintable() and c not in "'\\" else f"\\u{ord(c):04x}" for c in text
    )
    return f"'{safe}'"


def listed(texts: list[str]) -> str:
    return ", ".join(literal(t) for t in texts)


def strip(c: str) -> str:
    """Trim every Unicode white-space character, as Python's ``str.strip``.

    Text that starts and ends with a printable ASCII character is left as it is,
    which spares the set-based trim most of its work.
    """
    edges = f"substring({c}, 1, 1) BETWEEN '!' AND '~' AND substring({c}, -1, 1) BETWEEN '!' AND '~'"
    return f"(CASE WHEN {edges} THEN {c} ELSE btrim({c}, {literal(fv.WHITE_SPACE)}) END)"


def present(c: str, dtype: T.DataType) -> str:
    """The value, with a floating NaN turned into NULL."""
    return f"nanvl({c}, NULL)" if isinstance(dtype, REAL) else c


def as_text(c: str, dtype: T.DataType) -> str:
    return c if isinstance(dtype, T.StringType) else f"CAST({present(c, dtype)} AS STRING)"


def normalize_cell(c: str) -> str:
    """Trimmed text; the missing-value tokens become NULL."""
    s = strip(c)
    return f"CASE WHEN {s} NOT IN ({listed(fv.NA_TOKENS)}) THEN {s} END"


def is_empty(c: str, dtype: T.DataType) -> str:
    """Missing, blank after trimming, or the text ``nan`` in any case."""
    if not isinstance(dtype, T.StringType):
        return f"({present(c, dtype)} IS NULL)"
    return f"({c} IS NULL OR lower({strip(c)}) IN ('', 'nan'))"


def parse_number(s: str) -> str:
    """Lenient parse of stripped text: NULL for anything outside the numeric grammar.

    The grammar is tested first, so the cast never meets text that only Spark
    accepts (``1d``) and does not have to fail on ordinary words.  A finite text that
    is too large for a double is no number either.
    """
    value = f"try_cast({s} AS DOUBLE)"
    return (
        f"CASE WHEN {s} RLIKE {literal(fv.FINITE_NUMBER)} THEN"
        f" nullif(nullif({value}, double('inf')), double('-inf'))"
        f" WHEN {s} RLIKE {literal(fv.INFINITE_NUMBER)} THEN {value} END"
    )


def as_number(c: str, dtype: T.DataType) -> str:
    """A column as double: typed numbers as they are, text through the grammar."""
    if isinstance(dtype, NUMERIC):
        return f"CAST({present(c, dtype)} AS DOUBLE)"
    return parse_number(strip(c)) if isinstance(dtype, T.StringType) else "CAST(NULL AS DOUBLE)"


def looks_numeric(s: str) -> str:
    """Stripped text is a number in the wider grammar."""
    return f"({s} RLIKE {literal(fv.FLOAT_LITERAL)})"


def _first_shape(s: str, results: list[str]) -> str:
    tests = zip(fv.DATE_SHAPES, results)
    whens = " ".join(f"WHEN {s} RLIKE {literal(p)} THEN {r}" for (_, p), r in tests)
    return f"CASE {whens} END"


def date_shape(s: str) -> str:
    """Name of the first date shape the stripped text has, else NULL."""
    return _first_shape(s, [literal(name) for name, _ in fv.DATE_SHAPES])


def shape_bit(name: str) -> int:
    return 1 << [n for n, _ in fv.DATE_SHAPES].index(name)


def date_shape_bit(s: str) -> str:
    """The shape as one bit, so that the shapes of a column add up with ``bit_or``."""
    return _first_shape(s, [str(shape_bit(name)) for name, _ in fv.DATE_SHAPES])


def has_mojibake(c: str) -> str:
    """Any of the listed fragments; one that holds another listed one adds nothing."""
    listed_ones = fv.MOJIBAKE
    needed = [m for m in listed_ones if not any(o != m and o in m for o in listed_ones)]
    return "(" + " OR ".join(f"contains({c}, {literal(m)})" for m in needed) + ")"


def mixes_letters_and_digits(s: str) -> str:
    """Stripped text has a line with a letter and a digit; most long texts have no digit."""
    return f"({s} RLIKE '[0-9]' AND {s} RLIKE {literal(fv.LETTER_AND_DIGIT)})"


def email_fault(s: str) -> str:
    """Why the stripped text is no e-mail address; empty when it is one."""
    domain = f"substring_index({s}, '@', -1)"
    return (
        f"CASE WHEN {s} IS NULL THEN NULL"
        f" WHEN NOT contains({s}, '@') THEN 'missing @'"
        f" WHEN length({s}) - length(replace({s}, '@', '')) > 1 THEN 'multiple @ symbols'"
        f" WHEN startswith({s}, '@') THEN 'empty local part'"
        f" WHEN NOT contains({domain}, '.') THEN 'domain has no dot'"
        f" WHEN contains({domain}, '..') OR startswith({domain}, '.') OR endswith({domain}, '.')"
        f" THEN 'invalid domain' ELSE '' END"
    )


def is_moment(dtype: T.DataType) -> bool:
    """Whether the type holds days or times, so that nothing has to be parsed."""
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def as_timestamp(c: str, dtype: T.DataType) -> str:
    """A cell as a timestamp: typed ones as they are, text by a list of formats."""
    if is_moment(dtype):
        return f"CAST({c} AS TIMESTAMP)"
    s = strip(as_text(c, dtype))
    tries = ", ".join(f"try_to_timestamp({s}, {literal(f)})" for f in fv.DATE_FORMATS)
    return f"coalesce({tries})"


def row_digest(schema: T.StructType, columns: list[str] | None = None) -> list[str]:
    """Two 64-bit hashes of whole rows: equal rows, NULLs included, have equal hashes.

    Together they are a 128-bit digest.  Hashing reads the typed values, so nothing is
    printed, and shuffling the digest instead of the row keeps wide tables cheap to compare.
    """
    values, gaps = [], []
    for name in columns or schema.names:
        dtype, c = schema[name].dataType, quoted(name)
        gaps.append(f"{c} IS NULL")
        if isinstance(dtype, REAL):
            c = f"({c} + 0)"  # -0.0 equals 0.0
        elif isinstance(dtype, T.MapType):
            c = f"to_json({c})"
        values.append(c)
    there, back = ", ".join(values + gaps), ", ".join(gaps + values[::-1])
    return [f"xxhash64(1, {there})", f"xxhash64(2, {back})"]
