"""Sketches of columns: small sets exactly, merging, odd input, one pass."""

import re

import tabassay as ta

ROWS = "seg string, n double, t string, m map<string,int>"


def test_small_columns_are_exact_and_missing_cells_do_not_count(spark):
    rows = [("a", float(i % 5), str(i), {"k": i % 2}) for i in range(40)] + [("a", float("nan"), None, None), ("b", -0.0, " 7 ", {}), ("b", 0.0, "x", None)]
    found = {r["column"]: r for r in ta.approximate_profile(spark.createDataFrame(rows, ROWS)).collect()}
    assert [(c, found[c]["total_count"], found[c]["null_count"], found[c]["unique_count"]) for c in ("seg", "n", "t", "m")] == [
        ("seg", 43, 0, 2), ("n", 43, 1, 5), ("t", 43, 1, 42), ("m", 43, 2, 3)]
    assert (found["n"]["q1"], found["n"]["median"], found["n"]["q3"], found["n"]["max_val"]) == (1.0, 2.0, 3.0, 4.0)
    assert found["t"]["parsed_count"] == 41 and found["seg"]["median"] is None and found["seg"]["mean"] is None


def test_merged_segments_are_as_the_whole(spark):
    df = spark.range(30_000).selectExpr("CAST(id % 7 AS STRING) AS seg", "CAST(hash(id) % 5000 AS DOUBLE) AS n", "CAST(id % 900 AS STRING) AS t")
    kept = ta.column_sketches(df, segment_by=["seg"])
    assert kept.count() == 14
    parts = [kept.where("seg < '3'"), kept.where("seg >= '3'")]
    merged = {r["column"]: r for r in ta.read_sketches(ta.merge_sketches(*parts)).collect()}
    exact = {c: df.select(c).distinct().count() for c in ("n", "t")}
    for c in exact:
        assert merged[c]["total_count"] == 30_000 and abs(merged[c]["unique_count"] - exact[c]) <= 0.05 * exact[c]
    low, high = df.selectExpr(f"avg(CAST(n < {merged['n']['median']} AS INT))", f"avg(CAST(n <= {merged['n']['median']} AS INT))").first()
    assert low <= 0.51 and high >= 0.49


def test_an_empty_table_has_no_sketches_and_one_pass_is_enough(spark):
    assert ta.approximate_profile(spark.createDataFrame([], ROWS)).collect() == []
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = ta.approximate_profile(lines, segment_by=["l_returnflag"])._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan", final)) == 1 and len(re.findall("Exchange", final)) == 1
    assert not re.search("Python|Expand|CartesianProduct", final)
