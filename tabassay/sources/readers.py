"""Readers for delimited text, JSON records and Parquet: every cell becomes text."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions import fixed_values as fv
from ..functions.cells import literal, quoted
from ..operators.rows import reject_empty
from ..plans.keys import join_keys
from .quoted_lines import quoted_records

DELIMITED, JSON, PARQUET = (".csv", ".tsv", ".txt"), (".json",), (".parquet",)


# ---------------------------------------------------------------- normalisation


def dedupe_names(names: list[str]) -> list[str]:
    """Trimmed names; the n-th repeat of a name gets ``__n``, also if only the case differs.

    Spark finds columns whatever their case, so ``ID`` beside ``id`` could not be addressed.
    """
    seen: dict[str, int] = {}
    out, used = [], set()
    for name in (n.strip() for n in names):
        count = seen.get(name.lower(), 0)
        new = f"{name}__{count}" if count else name
        while new.lower() in used:
            count += 1
            new = f"{name}__{count}"
        seen[name.lower()] = count + 1
        used.add(new.lower())
        out.append(new)
    return out


def dedupe_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*dedupe_names(df.columns))


def drop_unnamed_empty(df: DataFrame) -> DataFrame:
    """Without the wholly missing columns called ``Unnamed:...``; one scan of those only."""
    candidates = [c for c in df.columns if c.startswith("Unnamed:")]
    if not candidates:
        return df
    filled = df.agg(*[F.expr(f"count({quoted(c)}) AS `#{i}`") for i, c in enumerate(candidates)]).first()
    empty = {c for c, n in zip(candidates, filled) if n == 0}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c not in empty])


def join_list_cells(c: str, element: T.DataType) -> str:
    """A list cell as text: its normalised, present elements, comma separated."""
    text = "to_json(e)" if isinstance(element, (T.StructType, T.MapType)) else "CAST(e AS STRING)"
    if isinstance(element, T.ArrayType):
        text = join_list_cells("e", element.elementType)
    kept = f"filter(transform({c}, e -> {cells.normalize_cell(text)}), x -> x IS NOT NULL)"
    return f"nullif(array_join({kept}, ', '), '')"


def text_cell(c: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.ArrayType):
        return join_list_cells(c, dtype.elementType)
    if isinstance(dtype, T.MapType):
        return f"to_json({c})"
    return cells.as_text(c, dtype)


def normalize_cells(df: DataFrame) -> DataFrame:
    """Every column as trimmed text, the missing-value tokens as NULL."""
    return df.selectExpr(*[
        f"{cells.normalize_cell(text_cell(quoted(f.name), f.dataType))} AS {quoted(f.name)}"
        for f in df.schema
    ])


def normalize_table(df: DataFrame) -> DataFrame:
    return normalize_cells(drop_unnamed_empty(dedupe_headers(df)))


# ---------------------------------------------------------------- delimited text


def _delimiter_counts(text: str) -> list[str]:
    return [f"length({text}) - length(replace({text}, {literal(d)}, ''))" for d in fv.DELIMITERS]


def sniff_delimiter(spark: SparkSession, path: str) -> DataFrame:
    """(path, delimiter) per file: the most frequent one in the first 2,048 characters.

    Lines of a file beyond those that its first 2,048 characters can fill are read but not shuffled; a path
    and a number per file are broadcast.
    """
    return _file_heads(spark, path).select("path", "delimiter")


def _file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, delimiter, digest of the whole header record) per file.

    The header record ends with the first line after which quotes are even; where that is none
    of the lines kept, the path stands for it, so that the file is alike to no other.
    """
    size = fv.DELIMITER_SAMPLE
    lines = (
        spark.read.option("lineSep", "\n").text(path)
        .selectExpr("_metadata.file_path AS path", "_metadata.file_block_start AS block",
                    "monotonically_increasing_id() AS line", "value")
        .where("block = 0")
    )
    # a task numbers its lines one after the other, so the first number of a file tells which are its first lines before any shuffle
    firsts = lines.groupBy("path").agg(F.min("line").alias("first"))
    lines = join_keys(lines, F.broadcast(firsts), ["path"]).where(f"line - first < {size}").selectExpr(
        "path", "line", f"left(value, {size}) AS value", "md5(CAST(value AS BINARY)) AS digest",
        "length(value) - length(replace(value, '\"', '')) AS quotes",
    )
    in_file = Window.partitionBy("path").orderBy("line")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    head = lines.withColumn("row", F.row_number().over(in_file)).where(F.col("row") <= size)
    # a running length, so that a file contributes its sample and not its block
    placed = (
        head.withColumn("start", F.coalesce(F.sum(F.expr("length(value) + 1")).over(earlier), F.lit(0)))
        .withColumn("even", (F.sum("quotes").over(in_file.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 0).cast("int"))
        .withColumn("closed", F.coalesce(F.sum("even").over(earlier), F.lit(0)))
    )
    sample = (
        placed.where(f"start < {size} OR closed = 0")
        .groupBy("path")
        .agg(
            F.expr(f"left(array_join(transform(array_sort(collect_list(CASE WHEN start < {size} THEN struct(row, value) END)),"
                   f" x -> x.value), '\n'), {size}) AS sample"),
            F.expr("array_join(transform(array_sort(collect_list(CASE WHEN closed = 0 THEN struct(row, digest) END)),"
                   " x -> x.digest), ',') AS record"),
            F.max("even").alias("ends"),
        )
    )
    counts = ", ".join(
        f"struct({c} AS n, {-i} AS preference, {literal(d)} AS delimiter)"
        for i, (c, d) in enumerate(zip(_delimiter_counts("sample"), fv.DELIMITERS))
    )
    return sample.selectExpr(
        "path", f"array_max(array({counts})).delimiter AS delimiter", "IF(ends = 1, md5(CAST(record AS BINARY)), path) AS header"
    )


def _mangled(header: list[str | None]) -> list[str]:
    """Names for the raw header cells: blank ones are numbered, exact repeats get ``.n``."""
    out: list[str] = []
    for i, cell in enumerate(header):
        base = name = cell if cell else f"Unnamed: {i}"
        n = 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def scan_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """A delimited file or folder with headers, as text.

    ``sep`` is found for each file when it is not given (a ``.tsv`` has tabs); files of one
    delimiter and header record are read together, and those of others joined on by column name. With a given ``sep``
    all files must have one header, else it is an error. A row with more cells than its header is an error, one
    with fewer is filled up. Quotes may hold line breaks, so a file is read by one task; with ``multi_line=False``
    files stay splittable and must have none. With ``split`` many tasks read a UTF-8 file whose quotes hold line breaks, at the
    price of three scans; a quote inside a cell that is not quoted is then an error (``quoted_records``).
    """
    if split and encoding.upper() not in ("UTF-8", "UTF8"):
        raise ValueError("only UTF-8 files can be split")
    if sep is None and path.lower().endswith(".tsv"):
        sep = "\t"
    if sep is not None:
        _reject_other_headers(spark, path, sep, encoding, multi_line)
        return normalize_table(_read_delimited(spark, [path], sep, encoding, multi_line, split))
    alike: dict[tuple[str, str], list[str]] = {}
    for head in _file_heads(spark, path).orderBy("path").toLocalIterator():
        alike.setdefault((head["delimiter"], head["header"]), []).append(unquote(head["path"]))
    if not alike:
        raise ValueError("File has no rows or columns")
    parts = [
        dedupe_headers(_read_delimited(spark, files, d, encoding, multi_line, split)) for (d, _), files in alike.items()
    ]
    return normalize_table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


SURPLUS = "#surplus"


def _options(sep: str, encoding: str, multi_line: bool) -> dict:
    return {
        "sep": sep, "encoding": encoding, "escape": '"', "multiLine": multi_line,
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }


def _reject_other_headers(spark: SparkSession, path: str, sep: str, encoding: str, multi_line: bool) -> None:
    """An error where files of a path have other header cells than the first; only records that differ as text are parsed."""
    firsts = _file_heads(spark, path).groupBy("header").agg(F.min("path").alias("path")).orderBy("path")
    read = spark.read.options(**_options(sep, encoding, multi_line), header=False)
    known = None
    for row in firsts.toLocalIterator():
        file = unquote(row["path"])
        header = read.csv([file]).first()
        if header is None:
            continue
        known = known or (file, list(header))
        if list(header) != known[1]:
            raise ValueError(f"The header of {file} differs from that of {known[0]}")


def _read_delimited(
    spark: SparkSession, paths: list[str], sep: str, encoding: str, multi_line: bool, split: bool = False
) -> DataFrame:
    options = _options(sep, encoding, multi_line)
    header = spark.read.options(**options, header=False).csv(paths).first()
    if header is None:
        raise ValueError("File has no rows or columns")
    names = [*(f"c{i}" for i in range(len(header))), SURPLUS]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if split:
        # a generator, so that a record is parsed once whatever is asked of it
        parsed = F.from_csv("record", schema.toDDL(), {k: str(v) for k, v in options.items()})
        rows = quoted_records(spark, paths, sep).select(F.inline(F.array(parsed)))
    else:
        rows = spark.read.options(**options, header=True, enforceSchema=True).schema(schema).csv(paths)
    message = f"a row has more cells than the {len(header)} of its header"
    whole = rows.where(f"IF(`{SURPLUS}` IS NULL, true, raise_error({literal(message)}))").drop(SURPLUS)
    return whole.toDF(*_mangled(list(header)))


# ---------------------------------------------------------------- JSON and Parquet


def flatten_json(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns, at any depth."""

    def leaves(prefix: str, path: str, dtype: T.DataType) -> list[str]:
        if isinstance(dtype, T.StructType):
            return [
                leaf
                for f in dtype
                for leaf in leaves(f"{prefix}.{f.name}", f"{path}.{quoted(f.name)}", f.dataType)
            ]
        return [f"{path} AS {quoted(prefix)}"]

    return df.selectExpr(*[e for f in df.schema for e in leaves(f.name, quoted(f.name), f.dataType)])


def _json_layouts(spark: SparkSession, path: str, options: dict) -> dict[str, list[str]]:
    """Files by the key of the top-level object that holds their rows; "" where none does."""
    first = (
        spark.read.text(path)
        .selectExpr(
            "_metadata.file_path AS path", r"regexp_extract(value, '[\\[{]', 0) AS bracket",
            "struct(_metadata.file_block_start, monotonically_increasing_id()) AS place",
        )
        .where("bracket != ''")
        .groupBy("path")
        .agg(F.expr("min_by(bracket, place) AS bracket"))
    )
    layouts: dict[str, list[str]] = {}
    objects = []
    for row in first.orderBy("path").toLocalIterator():
        files = objects if row["bracket"] == "{" else layouts.setdefault("", [])
        files.append(unquote(row["path"]))
    if objects:
        raw = spark.read.options(**options).json(objects)
        held = {f.name: f.dataType for f in raw.schema if isinstance(f.dataType, T.ArrayType)}
        keys = [k for k in fv.RECORD_KEYS if k in held and isinstance(held[k].elementType, T.StructType)]
        whens = " ".join(f"WHEN {quoted(k)} IS NOT NULL THEN {literal(k)}" for k in keys)
        key = f"CASE {whens} ELSE '' END" if keys else "''"
        for row in raw.selectExpr("_metadata.file_path AS path", f"{key} AS key").orderBy("path").toLocalIterator():
            layouts.setdefault(row["key"], []).append(unquote(row["path"]))
    return layouts


def scan_json_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """JSON documents, one a file: an array of objects, an object with its rows under a known key, or one object.

    Each file is judged by itself, and only a top-level object is searched for rows; files of
    one layout are read together, and those of others joined on by column name.
    """
    options = {"multiLine": True, "primitivesAsString": True, "encoding": encoding, "mode": "FAILFAST"}
    parts = []
    for key, files in (_json_layouts(spark, path, options) or {"": [path]}).items():
        raw = spark.read.options(**options).json(files)
        if key:
            raw = raw.selectExpr(f"inline({quoted(key)})")
        if raw.columns:
            parts.append(normalize_cells(dedupe_headers(flatten_json(raw))))
    if not parts:
        raise ValueError("File has no rows or columns")
    return normalize_table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as text; read it with ``spark.read.parquet`` to keep its types."""
    return normalize_table(spark.read.parquet(path))


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its file extension; an error when it is unknown or the table empty."""
    lower = path.lower().rstrip("/")
    for suffixes, scan in (
        (DELIMITED, scan_delimited), (JSON, scan_json_records), (PARQUET, scan_parquet)
    ):
        if lower.endswith(suffixes):
            return reject_empty(scan(spark, path, **options))
    raise ValueError(f"Unsupported file type. Supported: {', '.join(sorted(DELIMITED + JSON + PARQUET))}")
