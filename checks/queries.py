"""One query per operator, with the SQL that must give the same rows.

Computed doubles are rounded on both sides, since sums differ in their last digits with
the order of the rows.  A query whose name ends in ``_typed`` reads native columns, one
that ends in ``_by_segment`` profiles each segment of a table in one job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tabassay as ta
from tabassay.functions import cells
from tabassay.functions import fixed_values as fv
from tabassay.functions.cells import quoted
from tabassay.operators import sketches

from . import oracle as o
from . import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ORDER_COLS = {c: "text" for c in ("order_key", "store_id", "date", "sku", "sales", "email", "note")}
SURVEY_COLS = {"respondent_id": "text", "q1": "text", "q2": "text", "q3": "text", "score": "real"}
LINE_COLS = {
    "l_orderkey": "whole", "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole",
    "l_quantity": "real", "l_extendedprice": "real", "l_discount": "real", "l_tax": "real",
    "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "other",
}
AS_OF = "2003-01-01"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- inputs


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, sf_dir):
    return views.in_spark(spark, sf_dir, views.MESSY_ORDERS)


def survey(spark, sf_dir):
    return views.in_spark(spark, sf_dir, views.MESSY_SURVEY)


def labels(spark, sf_dir):
    return views.in_spark(spark, sf_dir, views.MESSY_LABELS)


def clients(spark, sf_dir):
    return views.in_spark(spark, sf_dir, views.MESSY_CLIENTS)


def drift_pair(spark, sf_dir):
    return (
        views.in_spark(spark, sf_dir, views.DRIFT_BASELINE),
        views.in_spark(spark, sf_dir, views.DRIFT_CURRENT),
    )


SOURCES = {"orders": orders, "survey": survey, "labels": labels, "clients": clients}


def scored(spark, sf_dir, name="orders"):
    """The scored profile of a view."""
    return ta.column_quality(ta.profile_table(SOURCES[name](spark, sf_dir)))


def scores(spark, sf_dir, name="orders"):
    return ta.table_score(
        scored(spark, sf_dir, name), ta.duplicate_rows(SOURCES[name](spark, sf_dir))
    )


def shared_folder(spark) -> str:
    """A new folder below the shared one that the session names, else below its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tabassay-{uuid.uuid4().hex}"


ORDERS_SQL = views.in_duckdb(views.MESSY_ORDERS)
SURVEY_SQL = views.in_duckdb(views.MESSY_SURVEY)
LABELS_SQL = views.in_duckdb(views.MESSY_LABELS)
CLIENTS_SQL = views.in_duckdb(views.MESSY_CLIENTS)
ORDERS_PROF = o.profile(ORDERS_SQL, ORDER_COLS)
SURVEY_PROF = o.profile(SURVEY_SQL, SURVEY_COLS)
ORDERS_SCORED = ORDERS_PROF + o.SCORED + o.duplicates(list(ORDER_COLS)) + o.TABLE
SURVEY_SCORED = SURVEY_PROF + o.SCORED + o.duplicates(list(SURVEY_COLS)) + o.TABLE

# ---------------------------------------------------------------- A  sources, samples


def _normal_select(columns) -> str:
    return ", ".join(f"{o.normal(f'CAST({c} AS VARCHAR)')} AS {c}" for c in columns)


@query("a1_scan_delimited", f"SELECT {_normal_select(ORDER_COLS)} FROM ({ORDERS_SQL})")
def _(spark, sf):
    path = shared_folder(spark)
    orders(spark, sf).write.options(
        header=True, sep="|", escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return ta.scan_delimited(spark, path)


_SEPARATORS = {"comma": ",", "tab": "\t", "semicolon": ";", "bar": "|"}


@query(
    "a2_sniff_delimiter",
    " UNION ALL ".join(f"SELECT '{n}' AS folder, {o.lit(d)} AS delimiter" for n, d in _SEPARATORS.items()),
)
def _(spark, sf):
    base = shared_folder(spark)
    for name, sep in _SEPARATORS.items():
        table(spark, sf, "lineitem").selectExpr(
            "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"
        ).write.options(header=True, sep=sep).csv(f"{base}/{name}")
    found = ta.sniff_delimiter(spark, f"{base}/*")
    return found.selectExpr("regexp_extract(path, '([a-z]+)/[^/]+$', 1) AS folder", "delimiter").distinct()


def _as_json_arrays(rows: DataFrame, path: str) -> None:
    """Every partition as one JSON array of objects, streamed."""
    import pyarrow as pa

    def wrap(batches):
        first = True
        for batch in batches:
            lines = [("" if first and i == 0 else ",") + v for i, v in enumerate(batch[0].to_pylist())]
            if lines:
                lines[0] = ("[" if first else "") + lines[0]
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    rows.mapInArrow(wrap, "value string").write.text(path)


_BROKEN_TEXTS = (
    f"SELECT {_normal_select(['conv_id', 'turn', 'role', 'text'])} FROM (SELECT conv_id, turn, role,"
    " role || chr(10) || chr(34) || text || chr(34) || ', ' AS text FROM conversations)"
)


def _with_broken_texts(spark, sf) -> str:
    """Conversations whose texts hold line breaks, quotes and separators, as delimited files."""
    path = shared_folder(spark)
    table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "role", "concat(role, '\\n\"', text, '\", ') AS text"
    ).write.options(header=True, escape='"', quoteAll=True).csv(path)
    return path


@query("a1_scan_delimited_line_breaks", _BROKEN_TEXTS)
def _(spark, sf):
    return ta.scan_delimited(spark, _with_broken_texts(spark, sf))


@query("a1_scan_delimited_split", _BROKEN_TEXTS)
def _(spark, sf):
    """The same files, each read by as many tasks as it has blocks."""
    return ta.scan_delimited(spark, _with_broken_texts(spark, sf), split=True)


@query(
    "a1_scan_delimited_mixed_folder",
    "SELECT CAST(l_orderkey AS VARCHAR) AS orders, l_returnflag AS flag, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem",
)
def _(spark, sf):
    path = shared_folder(spark)
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS orders", "l_returnflag AS flag", "l_linenumber AS line")
    rows.where("line <= 2").write.options(header=True, sep=",").csv(path)
    rows.where("line > 2").select("line", "orders", "flag").write.mode("append").options(header=True, sep=";").csv(path)
    return ta.scan_delimited(spark, path)


@query(
    "a12_row_sample_null_keys",
    "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY md5(coalesce(CAST(k AS VARCHAR), chr(0)) || '42')) AS n"
    " FROM (SELECT event_id, user_id, CASE WHEN event_id = 7 THEN NULL ELSE event_id END AS k FROM events)) WHERE n <= 5000",
)
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "user_id", "nullif(event_id, 7) AS k")
    return ta.row_sample(rows, 5000, ["k"]).select("event_id", "user_id")


@query(
    "a3_scan_json_records",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user,"
    " event_type AS kind, event_type || ', ' || CAST(user_id AS VARCHAR) AS tags FROM events",
)
def _(spark, sf):
    path = shared_folder(spark)
    rows = table(spark, sf, "events").selectExpr(
        "to_json(struct(event_id, struct(user_id AS id, struct(event_type AS kind) AS more) AS user,"
        " array(event_type, ' ', 'NA', string(user_id)) AS tags)) AS value"
    )
    _as_json_arrays(rows, path)
    read = ta.scan_json_records(spark, path)
    return read.selectExpr("event_id", "`user.id` AS user", "`user.more.kind` AS kind", "tags")


@query(
    "a3_scan_json_mixed_folder",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind,"
    " CASE WHEN event_id % 2 = 1 THEN '{\"type\":\"' || event_type || '\"}' END AS items FROM events",
)
def _(spark, sf):
    path = shared_folder(spark)
    events = table(spark, sf, "events")
    _as_json_arrays(events.where("event_id % 2 = 1").selectExpr(
        "to_json(struct(event_id, array(struct(event_type AS type)) AS items)) AS value"), f"{path}/arrays")
    wrapped = events.where("event_id % 2 = 0").groupBy((F.col("event_id") / 2 % 64).cast("int").alias("file"))
    rows = wrapped.agg(F.expr("to_json(struct(collect_list(struct(event_id, event_type AS kind)) AS data)) AS value"))
    rows.write.partitionBy("file").text(f"{path}/wrapped")
    return ta.scan_json_records(spark, f"{path}/{{arrays,wrapped/*}}").select("event_id", "kind", "items")


@query("a4_flatten_json", "SELECT * FROM events")
def _(spark, sf):
    nested = table(spark, sf, "events").selectExpr(
        "event_id", "ts", "struct(user_id, struct(event_type, value, props) AS what) AS who"
    )
    flat = ta.flatten_json(nested)
    return flat.toDF(*[c.split(".")[-1] for c in flat.columns])


@query(
    "a5_scan_parquet",
    f"SELECT {_normal_select(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'])} FROM customer",
)
def _(spark, sf):
    return ta.scan_parquet(spark, f"{sf}/customer.parquet")


@query("a6_dedupe_headers", "SELECT c_custkey AS id, c_nationkey AS id__1, c_name AS name FROM customer")
def _(spark, sf):
    return ta.dedupe_headers(
        table(spark, sf, "customer").selectExpr("c_custkey AS ` id`", "c_nationkey AS `id `", "c_name AS name")
    )


@query("a7_drop_unnamed_empty", "SELECT c_custkey, c_name AS \"Unnamed: 2\" FROM customer")
def _(spark, sf):
    return ta.drop_unnamed_empty(table(spark, sf, "customer").selectExpr(
        "c_custkey", "CAST(NULL AS STRING) AS `Unnamed: 1`", "c_name AS `Unnamed: 2`"
    ))


@query("a8_normalize_cells", f"SELECT {_normal_select(SURVEY_COLS)} FROM ({SURVEY_SQL})")
def _(spark, sf):
    return ta.normalize_cells(survey(spark, sf))


@query(
    "a9_join_list_cells",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE"
    " concat_ws(', ', p_brand, p_type) END AS parts FROM part",
)
def _(spark, sf):
    lists = table(spark, sf, "part").selectExpr(
        "p_partkey", "IF(p_partkey % 5 = 0, array('', 'NA', NULL), array(p_brand, NULL, ' nan ', p_type)) AS parts"
    )
    return ta.normalize_cells(lists)


@query("a10_reject_empty", "SELECT * FROM orders")
def _(spark, sf):
    return ta.reject_empty(table(spark, sf, "orders"))


@query(
    "a11_preview",
    f"SELECT {', '.join(f'coalesce({c}, {o.lit(str())}) AS {c}' for c in ORDER_COLS)}"
    f" FROM ({ORDERS_SQL}) ORDER BY order_key LIMIT 50",
)
def _(spark, sf):
    return ta.preview(orders(spark, sf), ["order_key"])


@query(
    "a11_preview_ties",
    """SELECT coalesce(CAST(user_id AS VARCHAR), '') AS user_id, event_type, CAST(event_id AS VARCHAR) AS event_id
        FROM events ORDER BY event_type, events.user_id NULLS FIRST, events.event_id LIMIT 200""",
)
def _(spark, sf):
    """A few types of events: nearly all rows tie."""
    return ta.preview(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["event_type"], 200)


@query("a12_row_sample", "SELECT * FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '42') LIMIT 1000")
def _(spark, sf):
    return ta.row_sample(table(spark, sf, "events"), 1000, ["event_id"])


@query(
    "a13_column_series",
    f"""SELECT row_number() OVER (ORDER BY order_key) AS position,
          CASE WHEN numeric THEN {o.number('sales')} END AS number,
          CASE WHEN NOT numeric THEN sales END AS text
        FROM ({ORDERS_SQL}) CROSS JOIN (SELECT count({o.number('sales')}) > 0.6 * count(*) AS numeric
          FROM ({ORDERS_SQL})) ORDER BY order_key LIMIT 5000""",
)
def _(spark, sf):
    return ta.column_series(orders(spark, sf), "sales", ["order_key"])


@query(
    "a13_column_series_ties",
    """SELECT row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber, l_quantity) AS position,
        CAST(l_quantity AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text
        FROM lineitem ORDER BY l_returnflag, l_orderkey, l_linenumber, l_quantity LIMIT 5000""",
)
def _(spark, sf):
    """Three flags order all lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return ta.column_series(lines, "l_quantity", ["l_returnflag"])


# ---------------------------------------------------------------- B  column profiles


SKETCHED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _close(sketched: DataFrame, lines: DataFrame) -> DataFrame:
    """Exact counts, and whether the estimates are within their stated errors."""
    values = ", ".join(f"struct('{c}' AS column, CAST({c} AS DOUBLE) AS v)" for c in SKETCHED)
    ranks = lines.selectExpr(f"inline(array({values}))").join(F.broadcast(sketched.withColumnRenamed("unique_count", "estimate")), "column")
    within = " AND ".join(
        f"count_if(v < {q}) <= ({p} + {sketches.RANK_ERROR}) * count(1) AND count_if(v <= {q}) >= ({p} - {sketches.RANK_ERROR}) * count(1)"
        for q, p in sketches.QUARTILES.items()
    )
    return (
        ranks.groupBy("column", "estimate")
        .agg(F.count("*").alias("total_count"), F.count_distinct("v").alias("unique_count"), F.expr(f"{within} AS quartiles_close"))
        .selectExpr("column", "total_count", "unique_count", f"abs(estimate - unique_count) <= {sketches.DISTINCT_ERROR} * unique_count AS distinct_close", "quartiles_close")
    )


SKETCHED_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS total_count, count(DISTINCT {c}) AS unique_count,"
    f" TRUE AS distinct_close, TRUE AS quartiles_close FROM lineitem" for c in SKETCHED
)


@query("b5_b7_approximate", SKETCHED_SQL)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return _close(ta.approximate_profile(lines, SKETCHED), lines)


@query("b5_b7_approximate_merged", SKETCHED_SQL)
def _(spark, sf):
    """Sketches kept per flag and status of a line, merged into sketches of the table."""
    lines = table(spark, sf, "lineitem")
    kept = ta.column_sketches(lines, SKETCHED, segment_by=["l_returnflag", "l_linestatus"])
    return _close(ta.read_sketches(ta.merge_sketches(kept)), lines)


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, everything else as it is."""
    return df.selectExpr(*[
        f"round({quoted(c)}, {places}) AS {quoted(c)}" if t == "double" else quoted(c)
        for c, t in df.dtypes
    ])


def profile_query(name, fields, source="orders"):
    """A slice of a profile.  ``fields`` maps a column to ``n`` (as it is) or ``r`` (rounded)."""
    prof = {"orders": ORDERS_PROF, "survey": SURVEY_PROF}[source]
    sql = ", ".join(
        f"round({c}, 4) AS {c}" if how == "r" else f"CAST({c} AS BIGINT) AS {c}" if how == "n" else c
        for c, how in fields.items()
    )

    @query(name, f"{prof} SELECT \"column\", {sql} FROM prof")
    def _(spark, sf):
        profile = ta.profile_table(SOURCES[source](spark, sf))
        return profile.selectExpr("column", *[
            f"round({c}, 4) AS {c}" if how == "r" else f"CAST({c} AS BIGINT) AS {c}" if how == "n" else c
            for c, how in fields.items()
        ])


@query(
    "b1_coerce_numeric",
    f"SELECT order_key, {o.number('sales')} AS sales, {o.number('store_id')} AS store_id,"
    f" {o.number('date')} AS date FROM ({ORDERS_SQL})",
)
def _(spark, sf):
    df = orders(spark, sf)
    return df.selectExpr("order_key", *[
        f"{cells.as_number(c, df.schema[c].dataType)} AS {c}" for c in ("sales", "store_id", "date")
    ])


profile_query("b2_infer_dtype", {"dtype": "="}, "survey")


@query(
    "b3_detect_id_column",
    o.profile("SELECT * FROM orders", {
        "o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "real",
        "o_orderdate": "other", "o_orderpriority": "text"})
    + " SELECT \"column\", dtype, round(cardinality, 4) AS cardinality FROM prof",
)
def _(spark, sf):
    profile = ta.profile_table(table(spark, sf, "orders"))
    return profile.selectExpr("column", "dtype", "round(cardinality, 4) AS cardinality")


profile_query("b4_null_stats", {"total_count": "n", "null_count": "n", "null_pct": "r"}, "survey")
profile_query("b5_distinct_stats", {"unique_count": "n", "cardinality": "r"})
profile_query("b6_numeric_moments", {"parsed_count": "n", "mean": "r", "std": "r", "min_val": "r", "max_val": "r"})
profile_query("b7_quartiles", {"q1": "r", "median": "r", "q3": "r"}, "survey")
profile_query("b8_iqr_outliers", {"outlier_count": "n", "outlier_pct": "r"})
profile_query("b9_extreme_outliers", {"extreme_outlier_count": "n"})
profile_query("b10_negatives", {"negative_count": "n", "negative_pct": "r"})
profile_query("b13_date_format_count", {"date_format_count": "n"})
profile_query("b14_whitespace_stats", {"whitespace_count": "n", "whitespace_pct": "r"})
profile_query("b15_mojibake_count", {"encoding_issues": "n"})
profile_query("b17_invalid_email_stats", {"invalid_email_count": "n", "invalid_email_pct": "r"})
profile_query("b18_mixed_type_numeric", {"dtype": "=", "mixed_type_pct": "r"})
profile_query("b19_mixed_type_categorical", {"dtype": "=", "mixed_type_pct": "r"}, "survey")


@query(
    "b11_top_values",
    ORDERS_PROF + o.TOP + " SELECT \"column\", CAST(place AS INT) AS place, value, n FROM top",
)
def _(spark, sf):
    return ta.profile_table(orders(spark, sf)).selectExpr(
        "column", "posexplode(top_values) AS (at, top)"
    ).selectExpr("column", "at + 1 AS place", "top.value AS value", "top.n AS n")


@query(
    "b12_classify_date_format",
    f"SELECT {o.shape('date')} AS shape, count(*) AS n FROM ({ORDERS_SQL}) GROUP BY 1",
)
def _(spark, sf):
    shaped = orders(spark, sf).selectExpr(f"{cells.strip('date')} AS s").selectExpr(
        f"{cells.date_shape('s')} AS shape"
    )
    return shaped.groupBy("shape").agg(F.expr("count(1) AS n"))


@query(
    "b16_validate_email",
    f"SELECT {o.email_fault('email')} AS fault, count(*) AS n FROM ({ORDERS_SQL}) GROUP BY 1",
)
def _(spark, sf):
    judged = orders(spark, sf).selectExpr(f"{cells.strip('email')} AS s").selectExpr(
        f"{cells.email_fault('s')} AS fault"
    )
    return judged.groupBy("fault").agg(F.expr("count(1) AS n"))


# Every profile field but top_values, doubles rounded.
_COUNTS = [
    "total_count", "null_count", "unique_count", "parsed_count", "outlier_count",
    "extreme_outlier_count", "negative_count", "date_format_count", "whitespace_count",
    "encoding_issues", "invalid_email_count",
]
_DOUBLES = [
    "null_pct", "cardinality", "mean", "std", "min_val", "q1", "median", "q3", "max_val",
    "outlier_pct", "negative_pct", "whitespace_pct", "invalid_email_pct", "mixed_type_pct",
]
PROFILE_FIELDS = ["column", "dtype", *[f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS],
                  *[f"round({c}, {6 if c == 'cardinality' else 4}) AS {c}" for c in _DOUBLES]]
PROFILE_SQL = ", ".join(['"column"', *PROFILE_FIELDS[1:]])


@query("b20_profile_table", f"{ORDERS_PROF} SELECT {PROFILE_SQL} FROM prof")
def _(spark, sf):
    return ta.profile_table(orders(spark, sf)).selectExpr(*PROFILE_FIELDS)


@query("b20_profile_survey", f"{SURVEY_PROF} SELECT {PROFILE_SQL} FROM prof")
def _(spark, sf):
    return ta.profile_table(survey(spark, sf)).selectExpr(*PROFILE_FIELDS)


@query(
    "b20_profile_table_with_heads",
    f"{o.profile(ORDERS_SQL, ORDER_COLS, heads='order_key')} SELECT {PROFILE_SQL} FROM prof",
)
def _(spark, sf):
    return ta.profile_table(orders(spark, sf), order_by=["order_key"]).selectExpr(*PROFILE_FIELDS)


@query(
    "b20_profile_typed",
    f"{o.profile('SELECT * FROM lineitem', LINE_COLS)} SELECT {PROFILE_SQL} FROM prof",
)
def _(spark, sf):
    return ta.profile_table(table(spark, sf, "lineitem")).selectExpr(*PROFILE_FIELDS)


_SEG_COLS = {c: LINE_COLS[c] for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linestatus")}


@query(
    "b20_profile_by_segment",
    o.profile("SELECT * FROM lineitem", _SEG_COLS, segment="l_returnflag", id_heuristic=False)
    + f" SELECT seg AS l_returnflag, {PROFILE_SQL} FROM prof",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", *_SEG_COLS)
    profile = ta.profile_table(df, segment_by=["l_returnflag"], id_heuristic=False)
    return profile.selectExpr("l_returnflag", *PROFILE_FIELDS)


_DOC_COLS = {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"}


@query(
    "b20_profile_documents",
    f"{o.profile('SELECT * FROM documents', _DOC_COLS)} SELECT {PROFILE_SQL} FROM prof",
)
def _(spark, sf):
    return ta.profile_table(table(spark, sf, "documents")).selectExpr(*PROFILE_FIELDS)


# ---------------------------------------------------------------- C  scores


@query("c1_column_quality", f"{ORDERS_SCORED} SELECT \"column\", round(quality_score, 4) AS quality_score FROM scored")
def _(spark, sf):
    profile = ta.profile_table(orders(spark, sf))
    return ta.column_quality(profile).selectExpr("column", "round(quality_score, 4) AS quality_score")


def scored_query(name, fields, sql, source="orders", base=None):
    base = base or {"orders": ORDERS_SCORED, "survey": SURVEY_SCORED}[source]

    @query(name, f"{base} SELECT {sql} FROM scored")
    def _(spark, sf):
        return scored(spark, sf, source).selectExpr(*fields)


scored_query("c2_quality_level", ["column", "quality_level"], "\"column\", quality_level", "survey")
scored_query("c3_column_issues", ["column", "array_join(issues, ' | ') AS issues"], "\"column\", issues")
scored_query(
    "c4_column_recommendations",
    ["column", "array_join(recommendations, ' | ') AS recommendations"],
    "\"column\", recommendations",
)


@query(
    "c5_duplicate_rows",
    f"WITH src AS ({ORDERS_SQL}) {o.duplicates(list(ORDER_COLS))}"
    " SELECT CAST(total_rows AS BIGINT) AS total_rows, CAST(duplicate_rows AS BIGINT) AS duplicate_rows,"
    " round(duplicate_pct, 4) AS duplicate_pct FROM dup",
)
def _(spark, sf):
    return rounded(ta.duplicate_rows(orders(spark, sf)))


_TABLE_FIELDS = ["overall", "nulls", "duplicates", "outliers", "type_mismatch", "low_cardinality", "deep_issues"]
_TABLE_SQL = ", ".join(f"round({c}, 4) AS {c}" for c in _TABLE_FIELDS) + f", {o.level('overall')} AS level"


@query("c6_overall_score", f"{ORDERS_SCORED} SELECT {_TABLE_SQL} FROM tab")
def _(spark, sf):
    df = orders(spark, sf)
    score = ta.table_score(ta.column_quality(ta.profile_table(df)), ta.duplicate_rows(df))
    return rounded(score)


_SEG_EVENTS = {"event_id": "whole", "ts": "other", "user_id": "whole", "value": "real", "props": "text"}


@query(
    "c6_overall_score_by_segment",
    o.profile("SELECT * FROM events", _SEG_EVENTS, segment="event_type")
    + o.SCORED + o.duplicates(["event_type", *_SEG_EVENTS], "event_type") + o.TABLE
    + f" SELECT seg AS event_type, {_TABLE_SQL} FROM tab",
)
def _(spark, sf):
    df = table(spark, sf, "events")
    profile = ta.profile_table(df, segment_by=["event_type"])
    duplicates = ta.duplicate_rows(df, ["event_type"])
    return rounded(ta.table_score(ta.column_quality(profile), duplicates, ["event_type"]))


@query("c7_column_scores", f"{SURVEY_SCORED} SELECT \"column\", round(quality_score, 4) AS score FROM scored")
def _(spark, sf):
    scores = ta.column_scores(scored(spark, sf, "survey"))
    return scores.selectExpr("explode(column_scores) AS (column, score)").selectExpr(
        "column", "round(score, 4) AS score"
    )


# ---------------------------------------------------------------- D  contracts

_RETAIL = ["store_id", "date", "sku", "sales"]


def _not_null(c, kind="text"):
    return (f"not_null_{c}", f"Required: {c} not null/empty", "critical", "not_null",
            o.count_where(o.empty(c, kind)), "SELECT count(*) FROM src",
            f" null/empty value(s) in {c}", f"{c} complete")


def _no_duplicates(columns):
    return ("no_duplicate_rows", "No duplicate rows", "warning", "no_duplicate_rows",
            o.repeats(columns, members=False), "SELECT count(*) FROM src",
            " duplicate row(s)", "All rows unique")


def _empties(columns):
    return " + ".join(f"(CASE WHEN {o.empty(c, k)} THEN 1 ELSE 0 END)" for c, k in columns.items())


RETAIL_RULES = [
    _no_duplicates(list(ORDER_COLS)),
    *[_not_null(c) for c in _RETAIL],
    ("unique_transaction", "Unique (store_id, date, sku)", "critical", "unique",
     o.repeats(_RETAIL[:3], members=True), "SELECT count(*) FROM src",
     " row(s) violate uniqueness", "Composite key unique"),
    ("sales_non_negative", "sales ≥ 0", "critical", "min_value",
     o.count_where(f"{o.number('sales')} < 0"), o.count_where(f"{o.number('sales')} IS NOT NULL"),
     " value(s) below 0", "All sales ≥ 0"),
]
SURVEY_RULES = [
    _no_duplicates(list(SURVEY_COLS)),
    _not_null("respondent_id"),
    ("unique_respondent", "Unique respondent (respondent_id)", "warning", "unique",
     o.repeats(["respondent_id"], members=True), "SELECT count(*) FROM src",
     " row(s) violate uniqueness", "Composite key unique"),
    ("high_item_missingness", "Rows with more than 2 empty items", "warning", "max_empty_cells_per_row",
     o.count_where(f"{_empties(SURVEY_COLS)} > 2"), "SELECT count(*) FROM src",
     " row(s) with more than 2 empty items", "No rows exceed 2 empty items"),
]
_CLIENT_COLS = {"customer_id": "text", "email": "text", "balance": "real", "segment": "text"}
_VALID = o.matches(o.trim("email"), fv.EMAIL_PATTERN)
FINANCIAL_RULES = [
    _no_duplicates(list(_CLIENT_COLS)),
    _not_null("customer_id"),
    _not_null("email"),
    ("email_format", "Valid email format (email)", "warning", "regex",
     o.count_where(f"{o.trim('email')} <> '' AND NOT {_VALID}"), o.count_where(f"{o.trim('email')} <> ''"),
     " invalid format(s)", "Format valid"),
]
_LABEL_COLS = {"doc_id": "whole", "label": "whole", "toxic": "whole"}
_LABEL_PRESENT = ("label_present", "Label column present (label)", "critical", "not_null",
                  o.count_where("label IS NULL"), "SELECT count(*) FROM src",
                  " null/empty value(s) in label", "label complete")
ML_RULES = [_no_duplicates(list(_LABEL_COLS)), _not_null("label", "whole"), _LABEL_PRESENT]

CONTRACTS = {  # view, sector, columns, required, oracle source, date, email, label, rules
    "retail": ("orders", ORDER_COLS, _RETAIL, ORDERS_SQL, "date", "", "", RETAIL_RULES),
    "survey": ("survey", SURVEY_COLS, ["respondent_id"], SURVEY_SQL, "", "", "", SURVEY_RULES),
    "financial": ("clients", _CLIENT_COLS, ["customer_id", "email"], CLIENTS_SQL, "", "email", "", FINANCIAL_RULES),
    "ml_training": ("labels", _LABEL_COLS, ["label"], LABELS_SQL, "", "", "label", ML_RULES),
}


def dims(spark, sf, sector):
    view = CONTRACTS[sector][0]
    df = SOURCES[view](spark, sf)
    return ta.dimension_scores(
        df, scored(spark, sf, view), ta.duplicate_rows(df), sector, as_of=AS_OF
    )


def contract_rules(spark, sf, sector):
    df = SOURCES[CONTRACTS[sector][0]](spark, sf)
    required, _ = ta.resolve_columns(df.columns, sector)
    return df, ta.build_rules(df.columns, sector, required)


def dims_sql(sector):
    _, columns, required, source, date, email, label, _ = CONTRACTS[sector]
    return o.profile(source, columns) + o.duplicates(list(columns)) + o.dimensions(
        {c: columns[c] for c in required}, date=date, as_of=AS_OF, email=email, label=label
    )


def rules_sql(sector):
    return f"WITH src AS ({CONTRACTS[sector][3]}) {o.rules(CONTRACTS[sector][7])}"


_ROLES = [
    (sector, role, c)
    for sector, p in fv.SECTOR_PROFILES.items()
    for role, hints in p["hints"].items()
    if (c := next((h for h in hints if h in ORDER_COLS), None))
]


@query(
    "d1_profile_registry",
    f"{dims_sql('retail')} {o.contributions('retail')}"
    " SELECT 'retail' AS profile_id, dimension, weight, score FROM contrib",
)
def _(spark, sf):
    registry = ta.profile_registry(spark).where("profile_id = 'retail'")
    scores = dims(spark, sf, "retail").unpivot([], None, "dimension", "score")
    return scores.join(F.broadcast(registry), "dimension").select("profile_id", "dimension", "weight", "score")


@query(
    "d2_resolve_columns",
    f"{ORDERS_PROF} SELECT sector, \"column\", round(null_pct, 4) AS null_pct FROM prof JOIN (VALUES "
    + ", ".join(f"('{s}', '{c}')" for s, _, c in _ROLES)
    + ") AS r(sector, c) ON prof.\"column\" = r.c",
)
def _(spark, sf):
    columns = orders(spark, sf).columns
    found = [(s, c) for s in fv.SECTOR_PROFILES for c in ta.resolve_columns(columns, s)[0]]
    resolved = spark.createDataFrame(found, "sector string, column string")
    return scored(spark, sf).join(F.broadcast(resolved), "column").selectExpr(
        "sector", "column", "round(null_pct, 4) AS null_pct"
    )


@query(
    "d3_empty_mask",
    "SELECT respondent_id, " + ", ".join(f"{o.empty(c, k)} AS {c}_empty" for c, k in SURVEY_COLS.items())
    + f" FROM ({SURVEY_SQL})",
)
def _(spark, sf):
    df = survey(spark, sf)
    return df.selectExpr("respondent_id", *[
        f"{cells.is_empty(f.name, f.dataType)} AS {f.name}_empty" for f in df.schema
    ])


@query(
    "d4_empty_cells_per_row",
    f"SELECT *, {_empties(SURVEY_COLS)} AS empty_cells FROM ({SURVEY_SQL})",
)
def _(spark, sf):
    return ta.empty_cells_per_row(survey(spark, sf))


def dimension_query(name, dimension, sector):
    column = f'"{dimension}"'

    @query(name, f"{dims_sql(sector)} SELECT {column} AS {column} FROM dim")
    def _(spark, sf):
        return dims(spark, sf, sector).select(dimension)


for _name, _dimension, _sector in [
    ("d5_dim_completeness", "completeness", "retail"),
    ("d6_dim_uniqueness", "uniqueness", "retail"),
    ("d7_dim_outliers", "outliers", "retail"),
    ("d8_dim_type_consistency", "type_consistency", "survey"),
    ("d9_dim_cardinality", "cardinality", "survey"),
    ("d10_dim_deep_checks", "deep_checks", "retail"),
    ("d11_dim_validity", "validity", "retail"),
    ("d12_dim_timeliness", "timeliness", "retail"),
    ("d13_dim_precision", "precision", "retail"),
    ("d14_dim_compliance", "compliance", "financial"),
    ("d15_dim_label_quality", "label_quality", "ml_training"),
]:
    dimension_query(_name, _dimension, _sector)


def weighted_query(name, sector):
    @query(
        name,
        f"{dims_sql(sector)} {o.contributions(sector)} SELECT dimension, score, weight,"
        " weighted_contribution, (SELECT round(sum(score * weight), 2) FROM contrib) AS overall FROM contrib",
    )
    def _(spark, sf):
        scores = dims(spark, sf, sector)
        parts = ta.dimension_contributions(scores, sector).drop("ordinal")
        return parts.withColumn("overall", ta.weighted_score(scores, sector).select("overall").scalar())


weighted_query("d16_weighted_score", "retail")
weighted_query("d16_weighted_score_financial", "financial")


def rule_query(name, sector, rule_ids=None):
    chosen = ", ".join(o.lit(r) for r in rule_ids) if rule_ids else ""
    where = f" WHERE rule_id IN ({chosen})" if rule_ids else ""

    @query(
        name,
        f"{rules_sql(sector)} SELECT rule_id, name, severity, rule_type, passed, violation_count,"
        f" violation_pct, total_checked, message FROM rule{where}",
    )
    def _(spark, sf):
        df, rules = contract_rules(spark, sf, sector)
        return ta.evaluate_rules(
            df, [r for r in rules if not rule_ids or r.id in rule_ids]
        ).drop("ordinal")


rule_query("d17_build_rules_retail", "retail")
rule_query("d17_build_rules_survey", "survey")
rule_query("d17_build_rules_financial", "financial")
rule_query("d17_build_rules_ml_training", "ml_training")
rule_query("d18_rule_no_duplicate_rows", "retail", ["no_duplicate_rows"])
rule_query("d19_rule_not_null", "retail", [f"not_null_{c}" for c in _RETAIL])
rule_query("d20_rule_unique", "survey", ["unique_respondent"])
rule_query("d21_rule_min_value", "retail", ["sales_non_negative"])
rule_query("d22_rule_regex", "financial", ["email_format"])
rule_query("d23_rule_max_empty_per_row", "survey", ["high_item_missingness"])


def _samples_sql(source, columns, rules, order):
    listed = ", ".join(columns)
    first = ", ".join(f"{c} NULLS FIRST" for c in order)
    parts = []
    for rule_id, condition, keys in rules:
        bad = condition or (
            f"count(*) OVER (PARTITION BY {', '.join(keys)}) > 1"
        )
        parts.append(
            f"SELECT '{rule_id}' AS rule_id, row_number() OVER (ORDER BY {first}) AS rank, {listed}"
            f" FROM (SELECT * FROM src {'WHERE' if condition else 'QUALIFY'} {bad}) QUALIFY rank <= 5"
        )
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


RETAIL_SAMPLES = _samples_sql(
    ORDERS_SQL, ORDER_COLS,
    [("no_duplicate_rows", "", list(ORDER_COLS)),
     *[(f"not_null_{c}", o.empty(c), []) for c in _RETAIL],
     ("unique_transaction", "", _RETAIL[:3]),
     ("sales_non_negative", f"{o.number('sales')} < 0", [])],
    ["order_key"],
)


@query("d24_sample_failures", RETAIL_SAMPLES)
def _(spark, sf):
    df, rules = contract_rules(spark, sf, "retail")
    return ta.sample_failures(df, rules, ["order_key"])


def assess_sql(sector):
    return (
        f"{dims_sql(sector)} {o.contributions(sector)} {o.rules(CONTRACTS[sector][7])}"
        f", verdict AS (SELECT '{sector}' AS profile_id, (SELECT round(sum(score * weight), 2) FROM contrib) AS overall,"
        " count(*) FILTER (WHERE NOT passed AND severity = 'critical') = 0 AS contract_passed,"
        " count(*) FILTER (WHERE passed) AS rules_passed, count(*) AS rules_total FROM rule)"
    )


def assessment(spark, sf, sector):
    df, rules = contract_rules(spark, sf, sector)
    return ta.assess_contract(df, ta.evaluate_rules(df, rules), dims(spark, sf, sector), sector)


def assess_query(name, sector):
    required = ", ".join(CONTRACTS[sector][2])

    @query(
        name,
        f"{assess_sql(sector)} SELECT *, {o.level('overall')} AS level, '{required}' AS required FROM verdict",
    )
    def _(spark, sf):
        return assessment(spark, sf, sector).selectExpr(
            "profile_id", "overall", "level", "contract_passed", "rules_passed", "rules_total",
            "array_join(required_columns, ', ') AS required",
        )


assess_query("d25_assess_contract", "retail")
assess_query("d25_assess_contract_survey", "survey")
assess_query("d25_assess_contract_ml_training", "ml_training")

# ---------------------------------------------------------------- E  drift

BASE_SQL, NOW_SQL = views.in_duckdb(views.DRIFT_BASELINE), views.in_duckdb(views.DRIFT_CURRENT)


def _ks_sql(columns, base, now):
    parts = [
        f"""SELECT '{c}' AS "column", max(n1) AS n_baseline, max(n2) AS n_current, max(abs(f1 - f2)) AS d FROM (
          SELECT sum(a) OVER w * 1.0 / sum(a) OVER () AS f1, sum(b) OVER w * 1.0 / sum(b) OVER () AS f2,
                 sum(a) OVER () AS n1, sum(b) OVER () AS n2
          FROM (SELECT x, sum(a) AS a, sum(b) AS b FROM (
                  SELECT {x} AS x, 1 AS a, 0 AS b FROM ({base}) UNION ALL
                  SELECT {x} AS x, 0 AS a, 1 AS b FROM ({now})) WHERE x IS NOT NULL GROUP BY x)
          WINDOW w AS (ORDER BY x))"""
        for c, x in columns.items()
    ]
    return " UNION ALL ".join(parts)


_KS = {"event_id": "CAST(event_id AS DOUBLE)", "value": "value"}
_P = (
    "SELECT *, d * sqrt(n_baseline * 1.0 * n_current / (n_baseline + n_current)) AS reach FROM ks"
)
_SERIES = (
    "least(greatest((SELECT 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * reach * reach))"
    " FROM range(1, 101) AS t(k)), 0), 1)"
)
KS_P = (
    f"WITH ks AS ({_ks_sql(_KS, BASE_SQL, NOW_SQL)}), reached AS ({_P}),"
    f" p AS (SELECT *, CASE WHEN reach < 0.2 THEN 1 ELSE {_SERIES} END AS p_value FROM reached)"
)


@query("e1_columns_added_removed",
       f"SELECT * FROM (SELECT 'extra' AS \"column\", 'added' AS change, (SELECT count(*) FROM ({NOW_SQL})) AS rows"
       f" UNION ALL SELECT 'event_type', 'removed', (SELECT count(*) FROM ({NOW_SQL})))")
def _(spark, sf):
    base, now = drift_pair(spark, sf)
    return ta.columns_added_removed(base, now).withColumn("rows", now.selectExpr("count(1)").scalar())


@query("e2_type_changed",
       "SELECT 'o_custkey' AS \"column\", 'bigint' AS old_type, 'string' AS new_type, count(*) AS rows FROM orders")
def _(spark, sf):
    base = table(spark, sf, "orders")
    now = base.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return ta.type_changed(base, now).withColumn("rows", now.selectExpr("count(1)").scalar())


@query("e3_ks_statistic",
       f"{KS_P} SELECT \"column\", CAST(n_baseline AS BIGINT) AS n_baseline,"
       " CAST(n_current AS BIGINT) AS n_current, round(d, 6) AS statistic FROM p")
def _(spark, sf):
    return rounded(ta.ks_statistic(*drift_pair(spark, sf)), 6)


_SPLIT = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_partkey": "CAST(l_partkey AS DOUBLE)"}
_EARLY, _LATE = "SELECT * FROM lineitem WHERE l_linenumber <= 3", "SELECT * FROM lineitem WHERE l_linenumber > 3"


@query("e3_ks_statistic_lineitem",
       f"WITH ks AS ({_ks_sql(_SPLIT, _EARLY, _LATE)}) SELECT \"column\", CAST(n_baseline AS BIGINT) AS n_baseline,"
       " CAST(n_current AS BIGINT) AS n_current, round(d, 6) AS statistic FROM ks")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    early, late = lines.where("l_linenumber <= 3"), lines.where("l_linenumber > 3")
    return rounded(ta.ks_statistic(early, late, list(_SPLIT)), 6)


@query("e4_ks_shifted",
       f"{KS_P} SELECT \"column\", round(d, 6) AS statistic, round(p_value, 6) AS p_value FROM p WHERE p_value < 0.05")
def _(spark, sf):
    return rounded(ta.distribution_shifted(*drift_pair(spark, sf)).drop("n_baseline", "n_current"), 6)


@query("e5_drift_summary",
       f"{KS_P}, s AS (SELECT count(*) AS shifted FROM p WHERE p_value < 0.05)"
       " SELECT CAST(1 AS BIGINT) AS breaking, 1 + shifted AS warnings,"
       " '1 breaking changes, ' || (1 + shifted) || ' warnings' AS summary FROM s")
def _(spark, sf):
    return ta.drift_summary(ta.schema_drift(*drift_pair(spark, sf)))


@query("e6_drift_scope",
       f"{KS_P} SELECT \"column\", 'distribution_shifted' AS change, round(p_value, 6) AS p_value FROM p"
       " WHERE p_value < 0.05 UNION ALL SELECT 'extra', 'added', NULL UNION ALL SELECT 'event_type', 'removed', NULL"
       " UNION ALL SELECT unnest(['event_id', 'value', 'extra']), 'profiled rows',"
       " (SELECT least(count(*), 1000) FROM events WHERE event_id % 2 = 1)")
def _(spark, sf):
    """The profile looks at a sample, drift at the whole table."""
    base, now = drift_pair(spark, sf)
    profile = ta.profile_table(ta.row_sample(now, 1000, ["event_id"]))
    seen = profile.selectExpr("column", "'profiled rows' AS change", "double(total_count) AS p_value")
    return rounded(ta.schema_drift(base, now).select("column", "change", "p_value").unionByName(seen), 6)


# ---------------------------------------------------------------- F  fixes


@query("f1_fix_drop_nulls", f"SELECT * FROM ({ORDERS_SQL}) WHERE store_id IS NOT NULL")
def _(spark, sf):
    return ta.fix_drop_nulls(orders(spark, sf), "store_id")


@query("f2_fix_impute_median",
       f"WITH src AS ({SURVEY_SQL}) SELECT * REPLACE (coalesce(q1, (SELECT CAST(quantile_cont({o.number('q1')}, 0.5)"
       " AS VARCHAR) FROM src)) AS q1) FROM src")
def _(spark, sf):
    return ta.fix_impute_median(survey(spark, sf), "q1")


@query("f2_fix_impute_median_typed",
       f"WITH src AS ({SURVEY_SQL}) SELECT * REPLACE (round(coalesce(score, (SELECT quantile_cont(score, 0.5)"
       " FROM src)), 6) AS score) FROM src")
def _(spark, sf):
    return rounded(ta.fix_impute_median(survey(spark, sf), "score"), 6)


@query("f3_fix_impute_mode",
       f"WITH src AS ({ORDERS_SQL}) SELECT * REPLACE (coalesce(store_id, (SELECT store_id FROM src WHERE store_id IS"
       " NOT NULL GROUP BY store_id ORDER BY count(*) DESC, store_id LIMIT 1)) AS store_id) FROM src")
def _(spark, sf):
    return ta.fix_impute_mode(orders(spark, sf), "store_id")


@query("f4_fix_strip_whitespace", f"SELECT * REPLACE ({o.trim('sku')} AS sku) FROM ({ORDERS_SQL})")
def _(spark, sf):
    return ta.fix_strip_whitespace(orders(spark, sf), "sku")


@query("f5_fix_dedupe", f"SELECT DISTINCT * FROM ({ORDERS_SQL})")
def _(spark, sf):
    return ta.fix_dedupe(orders(spark, sf))


@query("f5_fix_dedupe_digests_first", "SELECT DISTINCT text, lang, source, n_chars FROM documents")
def _(spark, sf):
    return ta.fix_dedupe(table(spark, sf, "documents").drop("doc_id"), digests_first=True)


_FIXES = {"date": "strip_whitespace", "store_id": "drop_nulls", "email": "impute_mode", "order_key": "dedupe"}


@query("f6_apply_fixes",
       f"WITH one AS (SELECT DISTINCT * FROM ({ORDERS_SQL})), two AS (SELECT * REPLACE ({o.trim('date')} AS date)"
       " FROM one WHERE store_id IS NOT NULL) SELECT * REPLACE (coalesce(email, (SELECT email FROM two WHERE email IS"
       " NOT NULL GROUP BY email ORDER BY count(*) DESC, email LIMIT 1)) AS email) FROM two")
def _(spark, sf):
    return ta.apply_fixes(orders(spark, sf), _FIXES)


@query("f7_suggest_fixes",
       f"{ORDERS_PROF} SELECT \"column\", fix FROM (SELECT \"column\", CASE WHEN null_pct > 50 THEN 'drop_nulls'"
       " WHEN null_pct > 0 AND dtype = 'numeric' THEN 'impute_median' WHEN null_pct > 0 THEN 'impute_mode' END AS fix"
       " FROM prof UNION ALL SELECT \"column\", CASE WHEN whitespace_count > 0 THEN 'strip_whitespace' END FROM prof)"
       " WHERE fix IS NOT NULL")
def _(spark, sf):
    return ta.suggest_fixes(scored(spark, sf)).drop("ordinal")


# ---------------------------------------------------------------- G  analytics

_NUMS = {c: f"CAST({c} AS DOUBLE)" for c, k in LINE_COLS.items() if k in ("whole", "real")}


def _corr_sql(columns, source):
    parts = [
        f"SELECT '{x}' AS x_col, '{y}' AS y_col, {i} AS i, {j} AS j,"
        f" (SELECT CASE WHEN stddev_samp(a) > 0 AND stddev_samp(b) > 0 THEN corr(a, b) ELSE 0 END FROM"
        f" (SELECT {ex} AS a, {ey} AS b FROM ({source})) WHERE a IS NOT NULL AND b IS NOT NULL) AS r"
        for i, (x, ex) in enumerate(columns.items())
        for j, (y, ey) in enumerate(columns.items())
    ]
    return f"WITH m AS ({' UNION ALL '.join(parts)})"


CORR = _corr_sql(_NUMS, "SELECT * FROM lineitem")
_SURVEY_NUMS = {"q1": o.number("q1"), "q2": o.number("q2"), "score": "score"}


@query("g1_correlation_matrix", f"{CORR} SELECT x_col, y_col, round(r, 6) AS r FROM m")
def _(spark, sf):
    matrix = ta.correlation_matrix(table(spark, sf, "lineitem"))
    # text columns of this table hold no number, so they take no part
    return rounded(matrix.select("x_col", "y_col", "r"), 6)


@query("g1_correlation_matrix_survey", f"{_corr_sql(_SURVEY_NUMS, SURVEY_SQL)} SELECT x_col, y_col, round(r, 6) AS r FROM m")
def _(spark, sf):
    return rounded(ta.correlation_matrix(survey(spark, sf)).select("x_col", "y_col", "r"), 6)


@query("g2_best_correlation_pair",
       f"{CORR} SELECT x_col, y_col, round(r, 6) AS r FROM m WHERE i < j ORDER BY abs(r) DESC, i, j LIMIT 1")
def _(spark, sf):
    return rounded(ta.best_correlation_pair(ta.correlation_matrix(table(spark, sf, "lineitem"))), 6)


_SHAPES_SQL = "SELECT o_totalprice, o_totalprice * 2 AS twice, -o_totalprice AS minus, o_custkey, 1 AS one FROM orders"
_SHAPES = {c: f"CAST({c} AS DOUBLE)" for c in ("o_totalprice", "twice", "minus", "o_custkey", "one")}


@query("g3_strong_pairs",
       f"{_corr_sql(_SHAPES, _SHAPES_SQL)} SELECT x_col, y_col, round(r, 6) AS r FROM m WHERE i < j AND abs(r) >= 0.5")
def _(spark, sf):
    shapes = table(spark, sf, "orders").selectExpr(
        "o_totalprice", "o_totalprice * 2 AS twice", "-o_totalprice AS minus", "o_custkey", "1 AS one"
    )
    return rounded(ta.strong_pairs(ta.correlation_matrix(shapes)), 6)


@query("g4_scatter_sample",
       f"SELECT {o.number('q2')} AS x, score AS y FROM (SELECT *, row_number() OVER (ORDER BY md5(respondent_id || '42'))"
       f" AS n FROM ({SURVEY_SQL}) WHERE {o.number('q2')} IS NOT NULL AND score IS NOT NULL) WHERE n <= 800")
def _(spark, sf):
    return ta.scatter_sample(survey(spark, sf), "q2", "score", ["respondent_id"])


@query("g5_box_plots",
       f"{SURVEY_PROF} SELECT \"column\", round(min_val, 4) AS min, round(q1, 4) AS q1, round(median, 4) AS median,"
       " round(q3, 4) AS q3, round(max_val, 4) AS max, CAST(outlier_count AS BIGINT) AS outliers FROM (SELECT * FROM prof"
       " WHERE dtype = 'numeric' ORDER BY outlier_pct + null_pct DESC, ordinal LIMIT 8) WHERE parsed_count >= 5")
def _(spark, sf):
    return rounded(ta.box_plots(scored(spark, sf, "survey")))


@query("g6_histogram",
       f"""{ORDERS_PROF}, spans AS (SELECT "column" AS col,
             CASE WHEN min_val = max_val THEN min_val - 0.5 ELSE min_val END AS low,
             CASE WHEN min_val = max_val THEN max_val + 0.5 ELSE max_val END AS high
           FROM prof WHERE dtype = 'numeric'),
           edges AS (SELECT col, bin, low + bin * ((high - low) / 30) AS lower, low + (bin + 1) * ((high - low) / 30)
             AS upper FROM spans CROSS JOIN (SELECT unnest(range(30)) AS bin))
           SELECT e.col AS "column", CAST(bin AS INT) AS bin, round(lower, 4) AS lower, count(num) AS count
           FROM edges e LEFT JOIN u ON u.col = e.col AND num >= lower AND (num < upper OR bin = 29)
           GROUP BY e.col, bin, lower""")
def _(spark, sf):
    return rounded(ta.histogram(orders(spark, sf), scored(spark, sf)))


@query("g7_row_completeness_hist",
       f"SELECT {_empties(SURVEY_COLS)} AS nulls_in_row, count(*) AS row_count FROM ({SURVEY_SQL}) GROUP BY 1")
def _(spark, sf):
    return ta.row_completeness(survey(spark, sf))


@query("g8_null_by_column",
       f"{SURVEY_PROF} SELECT \"column\", round(null_pct, 2) AS null_pct FROM prof ORDER BY prof.null_pct DESC, ordinal LIMIT 15")
def _(spark, sf):
    return ta.null_by_column(scored(spark, sf, "survey"))


scored_query("g9_null_matrix", ["column", "round(null_pct, 4) AS null_pct", "dtype", "round(quality_score, 4) AS quality"],
             "\"column\", round(null_pct, 4) AS null_pct, dtype, round(quality_score, 4) AS quality")


@query("g10_quality_ranking", f"{ORDERS_SCORED} SELECT \"column\", round(quality_score, 1) AS score FROM scored")
def _(spark, sf):
    return ta.quality_ranking(scored(spark, sf))


_ISSUES = {
    "nulls": "null_pct > 0", "outliers": "outlier_pct > 0", "mixed_types": "mixed_type_pct > 5",
    "email": "invalid_email_count > 0", "encoding": "encoding_issues > 0",
    "whitespace": "whitespace_count > 0", "date_format": "date_format_count >= 2",
}


def _issue_sql(tests):
    return ", ".join(f"count(*) FILTER (WHERE {t}) AS {n}" for n, t in tests.items())


@query("g11_issue_summary", f"{ORDERS_PROF} SELECT {_issue_sql(_ISSUES)} FROM prof")
def _(spark, sf):
    return ta.issue_summary(scored(spark, sf))


@query("g12_issue_mix",
       f"{ORDERS_PROF} SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{n.replace('_', ' ').title()}' AS name, count(*) AS count FROM prof WHERE {t}"
           for n, t in _ISSUES.items()) + ") WHERE count > 0")
def _(spark, sf):
    return ta.issue_mix(scored(spark, sf))


@query("g13_dtype_mix",
       f"{ORDERS_PROF} SELECT CASE dtype WHEN 'numeric' THEN 'Numeric' ELSE 'Categorical' END AS name,"
       " count(*) AS value FROM prof GROUP BY 1")
def _(spark, sf):
    return ta.dtype_mix(scored(spark, sf))


@query("g14_penalty_breakdown",
       f"{ORDERS_SCORED} SELECT name, round(penalty, 2) AS penalty FROM (" + " UNION ALL ".join(
           f"SELECT '{p.replace('_', ' ').title()}' AS name, {p} AS penalty FROM tab" for p in _TABLE_FIELDS[1:])
       + ") WHERE penalty > 0.05")
def _(spark, sf):
    return ta.penalty_breakdown(scores(spark, sf))


@query("g15_health_radar",
       f"{ORDERS_SCORED}, m AS (SELECT avg(null_pct) AS missing, avg(outlier_pct) FILTER (WHERE dtype = 'numeric') AS"
       " outlying FROM prof) SELECT metric, round(greatest(0, 100 - loss), 4) AS score FROM ("
       "SELECT 'Completeness' AS metric, missing AS loss FROM m UNION ALL SELECT 'Outliers', coalesce(outlying, 0) FROM m"
       " UNION ALL SELECT 'Uniqueness', duplicates * 5 FROM tab UNION ALL SELECT 'Types', type_mismatch * 6 FROM tab"
       " UNION ALL SELECT 'Cardinality', low_cardinality * 8 FROM tab"
       " UNION ALL SELECT 'Deep checks', deep_issues * 8 FROM tab)")
def _(spark, sf):
    return rounded(ta.health_radar(scored(spark, sf), scores(spark, sf)))


@query("g16_stacked_null",
       f"{SURVEY_PROF} SELECT substr(\"column\", 1, 20) AS \"column\", round(100 - null_pct, 1) AS valid,"
       " round(null_pct, 1) AS \"null\" FROM (SELECT * FROM prof ORDER BY null_pct DESC, ordinal LIMIT 10) WHERE null_pct > 0")
def _(spark, sf):
    return ta.stacked_null(scored(spark, sf, "survey"))


@query("g17_top_categories",
       ORDERS_PROF + o.TOP + " SELECT \"column\" || ': ' || substr(value, 1, 16) AS label, n AS count FROM top"
       " WHERE place <= 3 ORDER BY n DESC, ordinal, place LIMIT 12")
def _(spark, sf):
    return ta.top_categories(scored(spark, sf))


@query("g18_column_health",
       f"{ORDERS_SCORED}, a AS (SELECT avg(null_pct) AS avg_null, count(*) FILTER (WHERE quality_score < 70) AS"
       " needs_attention, count(*) FILTER (WHERE quality_score >= 90) AS excellent FROM scored)"
       " SELECT \"column\", round(quality_score, 4) AS quality_score, quality_level, round(avg_null, 4) AS avg_null,"
       " needs_attention, excellent FROM scored CROSS JOIN a WHERE lower(\"column\") LIKE '%null%' OR dtype LIKE '%null%'"
       " OR lower(issues) LIKE '%null%'")
def _(spark, sf):
    return rounded(ta.column_health(scored(spark, sf), " Null ").select(
        "column", "quality_score", "quality_level", "avg_null", "needs_attention", "excellent"
    ))


@query("g19_effective_score",
       f"{assess_sql('retail')} SELECT overall, {o.level('overall')} AS level FROM verdict")
def _(spark, sf):
    return ta.effective_score(scores(spark, sf), assessment(spark, sf, "retail"))


# ---------------------------------------------------------------- H  review

_INTEREST = (
    "interest AS (SELECT * FROM scored WHERE issues <> '' ORDER BY null_pct DESC, mixed_type_pct DESC, ordinal LIMIT 12)"
)


@query("h1_columns_of_interest",
       f"{ORDERS_SCORED}, {_INTEREST} SELECT \"column\", dtype, round(null_pct, 2) AS null_pct,"
       " CAST(unique_count AS BIGINT) AS unique_count, round(mixed_type_pct, 2) AS mixed_type_pct, issues FROM interest")
def _(spark, sf):
    return ta.columns_of_interest(scored(spark, sf)).selectExpr(
        "column", "dtype", "null_pct", "unique_count", "mixed_type_pct", "array_join(issues, ' | ') AS issues"
    )


_SURVEY_ORDER = ["respondent_id", "q1", "q2", "q3", "score"]


@query("h2_evidence_samples", _samples_sql(
    SURVEY_SQL, SURVEY_COLS,
    [("no_duplicate_rows", "", list(SURVEY_COLS)), ("not_null_respondent_id", o.empty("respondent_id"), []),
     ("unique_respondent", "", ["respondent_id"]), ("high_item_missingness", f"{_empties(SURVEY_COLS)} > 2", [])],
    _SURVEY_ORDER))
def _(spark, sf):
    df, rules = contract_rules(spark, sf, "survey")
    return ta.evidence_samples(df, rules, _SURVEY_ORDER)


@query("h3_evidence_completeness",
       f"SELECT {_empties(SURVEY_COLS)} AS nulls_in_row, count(*) AS row_count FROM ({SURVEY_SQL}) GROUP BY 1 ORDER BY 1 LIMIT 5")
def _(spark, sf):
    return ta.evidence_completeness(survey(spark, sf))


@query("h4_evidence_issue_counts",
       f"{SURVEY_PROF} SELECT {_issue_sql({**_ISSUES, 'outliers': 'outlier_pct > 5'})} FROM prof")
def _(spark, sf):
    return ta.evidence_issue_counts(scored(spark, sf, "survey"))


_EVENTS_OF = "count(*) FILTER (WHERE NOT passed) + (SELECT count(*) FROM interest WHERE round(mixed_type_pct, 2) > 10)"
_TRIAGE = f"""{SURVEY_SCORED} {o.rules(SURVEY_RULES)}, {_INTEREST}
  SELECT 'confirmed' AS verdict, 'confirm_' || rule_id AS issue_id, rule_id, NULL AS "column", severity, name AS title,
    'Deterministic contract flagged ' || violation_count || ' violation(s) (' || violation_pct || '%): ' || message
      || '. Review samples before treating as actionable.' AS explanation,
    'rule:' || rule_id || ' | violations:' || violation_count || ' | sample_failures[0..'
      || (least(CASE WHEN rule_id IN ('no_duplicate_rows', 'unique_respondent') THEN greatest(violation_count, 2)
                ELSE violation_count END, 5) - 1) || ']' AS evidence_refs,
    CASE WHEN rule_id = 'no_duplicate_rows' AND violation_pct < 2 THEN 'fix'
         WHEN rule_id = 'high_item_missingness' THEN 'document' ELSE 'manual_review' END AS action,
    CAST(0.85 AS DOUBLE) AS confidence
  FROM rule WHERE NOT passed
  UNION ALL
  SELECT 'confirmed', 'mixed_' || "column", NULL, "column", 'warning', 'Mixed encoding in ' || "column",
    'Column has ' || round(mixed_type_pct, 2) || '% non-numeric values in a numeric-leaning column — common in survey'
      || ' Likert exports with text labels.',
    'ColumnProfile.mixed_type_pct=' || round(mixed_type_pct, 2) || ' | top_values:['
      || CASE WHEN dtype = 'categorical' THEN coalesce(best, '') ELSE '' END || ']',
    'manual_review', CAST(0.85 AS DOUBLE)
  FROM interest LEFT JOIN (SELECT col, string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) AS best FROM (
      SELECT col, v, count(*) AS n, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, v) AS place
      FROM u WHERE v IS NOT NULL GROUP BY col, v) WHERE place <= 3 GROUP BY col) ON col = "column"
  WHERE round(mixed_type_pct, 2) > 10"""


def survey_triage(spark, sf):
    df, rules = contract_rules(spark, sf, "survey")
    found, samples = ta.evaluate_rules(df, rules), ta.evidence_samples(df, rules, _SURVEY_ORDER)
    return df, found, ta.triage_issues(found, ta.columns_of_interest(scored(spark, sf, "survey")), samples=samples)


@query("h5_triage_issues", _TRIAGE)
def _(spark, sf):
    issues = survey_triage(spark, sf)[2]
    return issues.withColumn("evidence_refs", F.expr("array_join(evidence_refs, ' | ')"))


@query("h5_triage_summary", f"""{SURVEY_SCORED} {o.rules(SURVEY_RULES)}, {_INTEREST},
  counted AS (SELECT count(*) FILTER (WHERE passed) AS rules_passed, count(*) FILTER (WHERE NOT passed) AS rules_failed,
      {_EVENTS_OF} AS confirmed, (SELECT count(*) FROM src) AS n FROM rule)
  SELECT n AS rows_analyzed, n AS total_rows, false AS sampled, rules_passed, rules_failed, confirmed,
    'Reviewed ' || n || ' rows (' || n || ' total). ' || confirmed || ' issue(s) to review.' AS summary FROM counted""")
def _(spark, sf):
    df, found, issues = survey_triage(spark, sf)
    return ta.triage_summary(ta.evidence_envelope(df, found), issues)


_RECS = "string_split(recommendations, ' | ')"
_REPORT = f"""{ORDERS_SCORED} {o.dimensions({c: 'text' for c in _RETAIL}, date='date', as_of=AS_OF)}
  {o.contributions('retail')} {o.rules(RETAIL_RULES)},
  verdict AS (SELECT (SELECT round(sum(score * weight), 2) FROM contrib) AS overall,
    count(*) FILTER (WHERE NOT passed AND severity = 'critical') = 0 AS ok,
    count(*) FILTER (WHERE passed) AS rules_passed, count(*) AS rules_total FROM rule)
  SELECT 'profile' AS section, 0 AS ordinal, 'Profile: Retail / Transactional' AS text FROM verdict
  UNION ALL SELECT 'profile', 1, 'Profile Score: ' || {o.one('overall')} || '/100 — ' || {o.level('overall')} FROM verdict
  UNION ALL SELECT 'profile', 2, 'Data contract: ' || CASE WHEN ok THEN 'passed' ELSE 'failed' END || ' (' ||
    rules_passed || '/' || rules_total || ' rules)' FROM verdict
  UNION ALL SELECT 'dimensions', ordinal, CASE dimension WHEN 'type_consistency' THEN 'Type Consistency'
    ELSE upper(dimension[1]) || dimension[2:] END || ': ' || {o.one('score')} || ' (weight ' ||
    format('{{:.0f}}', round(weight * 100, 0)) || '%)' FROM contrib
  UNION ALL SELECT 'contract_failures', ordinal, name || ' (' || severity || '): ' || message FROM rule WHERE NOT passed
  UNION ALL SELECT 'score', 0, 'Overall Score: ' || {o.one('overall')} || '/100 — ' || {o.level('overall')} FROM tab
  {' '.join(f"UNION ALL SELECT 'breakdown', {i}, '{p.replace('_', ' ').title()}: -' || {o.one(p)} || ' points' FROM tab"
            for i, p in enumerate(_TABLE_FIELDS[1:]))}
  UNION ALL SELECT 'columns', ordinal, concat_ws(' | ', "column", dtype, {o.one('null_pct')} || '%',
    format('{{:,d}}', unique_count), quality_level, CASE WHEN issues = '' THEN '—' ELSE replace(issues, ' | ', '; ') END)
    FROM scored
  UNION ALL SELECT 'recommendations', ordinal * 100 + place - 1, {_RECS}[place] FROM
    (SELECT *, unnest(range(1, len({_RECS}) + 1)) AS place FROM scored WHERE recommendations <> '')"""


@query("h6_report_rows", _REPORT)
def _(spark, sf):
    """The profile, the duplicates, the rules and the dimensions are each computed once."""
    df, rules = contract_rules(spark, sf, "retail")
    rows, columns, copies = ta.settled(ta.evaluate_rules(df, rules), scored(spark, sf), ta.duplicate_rows(df))
    (dimensions,) = ta.settled(ta.dimension_scores(df, columns, copies, "retail", as_of=AS_OF))
    return ta.report_rows(
        columns, ta.table_score(columns, copies),
        assessment=ta.assess_contract(df, rows, dimensions, "retail"),
        contributions=ta.dimension_contributions(dimensions, "retail"),
        rule_rows=rows,
    )
