"""What the plans of the main operators must look like."""

import re
import time

import pytest

import tabassay as ta
from checks import views

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF_DIR}/lineitem.parquet")


def executed(df):
    """The plan after it ran, so that reused shuffles show."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_profile_shuffles_the_values_once(lines):
    plan = executed(ta.profile_table(lines))
    assert len(re.findall(r"FileScan", plan)) == 1
    assert "ReusedExchange" in plan or "ReusedExchangeExec" in plan
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInArrow", plan)
    assert "WindowGroupLimit" in plan


def test_a_report_reads_the_profile_once(spark, lines):
    few = lines.select("l_quantity", "l_returnflag")
    columns = ta.column_quality(ta.profile_table(few))
    score = ta.table_score(columns, ta.duplicate_rows(few))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert 0 < scans(ta.report_rows(columns, spark.createDataFrame(score.collect(), score.schema))) <= scans(columns)


def test_texts_are_parsed_once_for_all_readers_of_the_numbers(spark):
    plan = executed(ta.profile_table(views.in_spark(spark, SF_DIR, views.MESSY_SURVEY)))
    assert len(re.findall(r"Generate explode\(array\(CASE WHEN \(n#", plan)) == 1


def test_settled_tables_are_read_no_more(spark):
    rows = [(1, None, [{"v": "x", "n": 2}]), (None, "é", None), (1, None, [])]
    odd = spark.createDataFrame(rows, "`a b` int, c string, d array<struct<v: string, n: bigint>>")
    counted = spark.read.parquet(f"{SF_DIR}/region.parquet").selectExpr("count(1) AS n", "timestamp'2020-01-02' AS day")
    first, none, second = ta.settled(odd, odd.where("false"), counted)
    assert sorted(map(str, first.collect())) == sorted(map(str, odd.collect())) and first.dtypes == odd.dtypes
    assert none.collect() == [] and none.dtypes == odd.dtypes
    assert second.collect() == counted.collect()
    assert "FileScan" not in second._jdf.queryExecution().executedPlan().toString()


def test_a_segmented_profile_shuffles_the_values_once(lines):
    few = lines.select("l_returnflag", "l_quantity", "l_linestatus")
    plan = executed(ta.profile_table(few, segment_by=["l_returnflag"]))
    assert len(re.findall(r"FileScan", plan)) == 1


def test_a_profile_reads_only_its_columns(lines):
    plan = ta.profile_table(lines, ["l_quantity"])._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == {"l_quantity:double"}


def test_row_wise_rules_share_one_scan(spark):
    df = views.in_spark(spark, SF_DIR, views.MESSY_SURVEY)
    rules = [r for r in ta.build_rules(df.columns, "survey", df.columns) if r.kind not in
             ("unique", "no_duplicate_rows")]
    plan = ta.evaluate_rules(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1


def test_duplicates_shuffle_digests_not_rows(lines):
    plan = ta.duplicate_rows(lines)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest1" in plan


def test_correlation_shuffles_pairs_and_answers_for_many_columns(spark, lines):
    plan = ta.correlation_matrix(lines)._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|Expand", plan)
    wide = spark.range(50).selectExpr(*[f"id * {i} + pmod(id * id, {i + 2}) AS c{i}" for i in range(200)])
    begin = time.monotonic()
    assert ta.correlation_matrix(wide).count() == 200 * 200
    assert time.monotonic() - begin < 60


def test_many_imputes_are_planned_in_seconds(spark):
    rows = spark.range(20).selectExpr(*[f"IF(id = {i}, NULL, id * {i} + 1) AS c{i}" for i in range(20)])
    fixes = {f"c{i}": ("impute_median", "impute_mode", "drop_nulls")[i % 3 if i == 11 else i % 2] for i in range(20)}
    begin = time.monotonic()
    ta.apply_fixes(rows, fixes)._jdf.queryExecution().executedPlan()
    assert time.monotonic() - begin < 10


def test_samples_of_row_rules_share_one_scan(spark):
    df = views.in_spark(spark, SF_DIR, views.MESSY_SURVEY)
    rules = ta.build_rules(df.columns, "survey", df.columns)
    of_rows = [r for r in rules if r.kind not in ("unique", "no_duplicate_rows")]
    assert len(of_rows) > 3
    scans = [len(re.findall("FileScan", ta.sample_failures(df, r, ["respondent_id"])._jdf.queryExecution()
                            .executedPlan().toString())) for r in (of_rows, rules)]
    assert scans == [1, 3]
    assert ta.sample_failures(df, [], ["respondent_id"]).count() == 0


@pytest.mark.parametrize("build", [
    lambda df: ta.row_completeness(df),
    lambda df: ta.ks_statistic(df, df),
    lambda df: ta.row_sample(df, 10),
    lambda df: ta.apply_fixes(df, {"l_quantity": "impute_median", "l_returnflag": "impute_mode"}),
    lambda df: ta.sample_failures(df, ta.build_rules(df.columns, "generic", ["l_tax"]), ["l_orderkey"]),
])
def test_no_python_and_no_cross_join(lines, build):
    plan = build(lines)._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInArrow|MapInPandas", plan)


def shuffled(spark):
    """Bytes of shuffle written by the application so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_profile_shuffles_no_long_text(spark):
    """Keys of long texts are digests; texts are fetched only for the values that are shown."""
    rows = spark.range(400).selectExpr("repeat(concat(lpad(id, 4, '0'), ' is a long line of text. '), 4000) AS text", "id % 3 AS few")
    rows = rows.unionAll(spark.range(60).selectExpr("repeat('the same long line, many times. ', 4000) AS text", "id % 3 AS few"))
    before = shuffled(spark)
    plan = executed(ta.profile_table(rows))
    assert not re.search(r"hashpartitioning\(pos#\d+, w#\d+\S*, r#\d+, t#\d+, \d+\)", plan) and "d#" in plan
    # the texts have 45 MB; run twice, five of them are fetched, each by each task that has it
    assert 0 < shuffled(spark) - before < 8_000_000
    top = ta.profile_table(rows).where("column = 'text'").first()["top_values"]
    assert [t["n"] for t in top] == [60, 1, 1, 1, 1]
    assert [t["value"][:40] for t in top] == ["the same long line, many times. the same"] + [
        f"{i:04d} is a long line of text. {i:04d} is a lo"[:40] for i in range(4)]
    assert all(len(t["value"]) > 90_000 for t in top)


def test_without_long_texts_the_source_is_read_once(spark, lines):
    plan = executed(ta.profile_table(lines, ["l_shipmode", "l_quantity"]))
    assert len(re.findall(r"FileScan", plan)) == 1
