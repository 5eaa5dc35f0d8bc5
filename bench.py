"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice to warm up and the third run is timed, planning included; the result
is computed in full and dropped.  The small input files hold one row group each, which Spark reads in one task, so
the rows are spread over the cores first; a table on a cluster comes in many files.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tabassay as ta  # noqa: E402
from checks import views  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tabassay-bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def spread(df):
        return df.repartition(CPUS)

    def read(name):
        return spread(spark.read.parquet(f"{SF_DIR}/{name}.parquet"))

    def view(text):
        return spread(views.in_spark(spark, SF_DIR, text))

    def score(df, **options):
        return ta.table_score(ta.column_quality(ta.profile_table(df, **options)), ta.duplicate_rows(df))

    def contract():
        df = view(views.MESSY_ORDERS)
        required, _ = ta.resolve_columns(df.columns, "retail")
        return ta.evaluate_rules(df, ta.build_rules(df.columns, "retail", required))

    def drift():
        lines = read("lineitem")
        early, late = lines.where("l_linenumber <= 3"), lines.where("l_linenumber > 3")
        return ta.distribution_shifted(early, late, NUMERIC + ["l_partkey"])

    def fixes():
        return ta.apply_fixes(view(views.MESSY_ORDERS), {
            "date": "strip_whitespace", "store_id": "impute_median", "email": "impute_mode", "note": "dedupe",
        })

    queries = {
        "profile_numeric": lambda: ta.profile_table(read("lineitem").select(NUMERIC), id_heuristic=False),
        "score_lineitem": lambda: score(read("lineitem")),
        "score_by_segment": lambda: ta.column_quality(ta.profile_table(
            read("lineitem").select("l_returnflag", *NUMERIC), segment_by=["l_returnflag"])),
        "duplicates": lambda: ta.duplicate_rows(read("lineitem")),
        "profile_messy_orders": lambda: ta.column_quality(ta.profile_table(view(views.MESSY_ORDERS))),
        "profile_documents": lambda: ta.profile_table(read("documents")),
        "contract_retail": contract,
        "drift": drift,
        "fixes": fixes,
        "correlation": lambda: ta.correlation_matrix(read("lineitem")),
        "row_completeness": lambda: ta.row_completeness(view(views.MESSY_SURVEY)),
        "row_sample": lambda: ta.row_sample(read("lineitem"), 10_000, ["l_orderkey", "l_linenumber"]),
    }
    only = sys.argv[1:]
    seconds = {}
    for name, build in queries.items():
        if only and name not in only:
            continue
        for _ in range(3):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
