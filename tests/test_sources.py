"""Readers over small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tabassay import (
    dedupe_headers, drop_unnamed_empty, flatten_json, load_table, normalize_cells, scan_delimited,
    scan_json_records, scan_parquet, sniff_delimiter,
)

ROWS = [("1", "2024-06-01", "A", "100"), ("2", "2024-06-02", "B", "200"),
        ("3", "2024-06-03", "C", "150"), ("4", None, "D", "-5")]
NAMES = ["store_id", "date", "sku", "sales"]


def cells(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("suffix, sep", [("csv", ","), ("tsv", "\t"), ("txt", "|"), ("csv", ";")])
def test_delimited(spark, tmp_path, suffix, sep):
    path = tmp_path / f"retail.{suffix}"
    path.write_text("\n".join(sep.join(v or "" for v in row) for row in [NAMES, *ROWS]) + "\n")
    for _ in range(2):
        df = load_table(spark, str(path))
        assert df.columns == NAMES and cells(df) == ROWS


def test_delimited_quotes_tokens_and_headers(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('A, A,B,B,,\n" x ","a ""q"" b, c",NULL,N/A,,7\n1,nan,None,NaN,,\n')
    df = scan_delimited(spark, str(path), sep=",")
    assert df.columns == ["A", "A__1", "B", "B.1", "Unnamed: 5"]
    assert cells(df) == [("1", None, None, None, None), ("x", 'a "q" b, c', None, None, "7")]


def test_delimited_encoding(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("name\ncafé\n".encode("latin-1"))
    assert cells(scan_delimited(spark, str(path), sep=",", encoding="ISO-8859-1")) == [("café",)]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('a,b\n"x\ny",1\n')
    assert cells(scan_delimited(spark, str(path), sep=",", multi_line=True)) == [("x\ny", "1")]


def test_a_surplus_cell_is_an_error_and_a_missing_one_is_not(spark, tmp_path):
    (tmp_path / "short.csv").write_text("x,y\n1,2\n3\n")
    assert cells(scan_delimited(spark, str(tmp_path / "short.csv")))[0] == ("1", "2")
    (tmp_path / "long.csv").write_text("x,y\n1,2\n3,4,99\n")
    with pytest.raises(Exception, match="more cells"):
        scan_delimited(spark, str(tmp_path / "long.csv")).collect()


def test_folder_of_several_delimiters_and_header_orders(spark, tmp_path):
    for name, text in {"a.csv": "x,y\n1,2\n", "b.csv": "x;y\n5;6\n", "c d.csv": "y,x\n8,7\n"}.items():
        (tmp_path / name).write_text(text)
    assert cells(scan_delimited(spark, str(tmp_path)).select("x", "y")) == [("1", "2"), ("5", "6"), ("7", "8")]


@pytest.mark.parametrize("start", [",".join(f"column_number_{i}" for i in range(300)), 'x,"broken\nname"'])
def test_headers_that_differ_late_are_told_apart(spark, tmp_path, start):
    cells_ = ",".join("0" * (start.count(",") + 1))
    (tmp_path / "a.csv").write_text(f"{start},p,q\n{cells_},1,2\n")
    (tmp_path / "b.csv").write_text(f"{start},q,p\n{cells_},4,3\n")
    (tmp_path / "c.csv").write_text(f"{start},p\n{cells_},5\n")
    df = scan_delimited(spark, str(tmp_path))
    assert sorted(map(tuple, df.select("p", "q").collect()), key=str) == [("1", "2"), ("3", "4"), ("5", None)]


@pytest.mark.parametrize("other", ["y,x", "x", "x,z", '"x\n",y'])
def test_another_header_is_an_error_with_a_given_separator(spark, tmp_path, other):
    for name, text in {"a.csv": "x,y\n1,2\n", "b.csv": '"x","y"\n3,4\n'}.items():
        (tmp_path / name).write_text(text)
    assert cells(scan_delimited(spark, str(tmp_path), sep=",")) == [("1", "2"), ("3", "4")]
    (tmp_path / "c.csv").write_text(f"{other}\n5,6\n")
    with pytest.raises(ValueError, match="header of"):
        scan_delimited(spark, str(tmp_path), sep=",")


def test_names_that_differ_in_case(spark, tmp_path):
    (tmp_path / "case.csv").write_text("ID,id,Id__1\n1,2,3\n")
    df = scan_delimited(spark, str(tmp_path / "case.csv"))
    assert df.columns == ["ID", "id__1", "Id__1__1"] and cells(df) == [("1", "2", "3")]


def test_sniff(spark, tmp_path):
    texts = {"tie.txt": "a,b;c\n", "none.txt": "abc\n", "bar.txt": "a|b|c\n1|2|3\n",
             "late.txt": "a;b\n" * 600 + "|" * 9000 + "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r["delimiter"] for r in sniff_delimiter(spark, str(tmp_path)).collect()}
    assert got == {"tie.txt": ",", "none.txt": ",", "bar.txt": "|", "late.txt": ";"}


@pytest.mark.parametrize("shape", ["array", "records", "data"])
def test_json(spark, tmp_path, shape):
    rows = [dict(zip(NAMES, (v or "" for v in row))) for row in ROWS]
    payload = rows if shape == "array" else {shape: rows, "other": 1}
    path = tmp_path / "retail.json"
    path.write_text(json.dumps(payload, indent=2))
    df = load_table(spark, str(path))
    assert cells(df.select(*NAMES)) == ROWS


def test_json_nested_lists_and_single_object(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"id": 1, "who": {"name": " Ann ", "home": {"city": "Oslo"}}, "tags": ["a", "", None, "NA", 2]}))
    df = scan_json_records(spark, str(path))
    row = df.first().asDict()
    assert row == {"id": "1", "tags": "a, 2", "who.home.city": "Oslo", "who.name": "Ann"}


def test_json_documents_of_a_folder_are_judged_one_by_one(spark, tmp_path):
    """An array whose objects have a list called items stays whole beside wrapped rows and single objects."""
    documents = {
        "array": [{"id": 1, "items": [{"x": 1}]}, {"id": 2, "items": []}, {"id": 3, "items": None}],
        "wrapped": {"data": [{"id": 4}, {"id": 5, "name": "e"}], "count": 2},
        "rows": {"rows": [{"id": 6}]}, "empty": {"data": []}, "one": {"id": 7, "name": "g"},
    }
    for name, payload in documents.items():
        (tmp_path / f"a {name}.json").write_text("\n " + json.dumps(payload, indent=1))
    df = scan_json_records(spark, str(tmp_path))
    assert sorted(df.columns) == ["id", "items", "name"]
    assert cells(df.selectExpr("id", "items", "coalesce(name, '')")) == [
        ("1", '{"x":"1"}', ""), ("2", None, ""), ("3", None, ""), ("4", None, ""), ("5", None, "e"),
        ("6", None, ""), ("7", None, "g")]


def test_json_faults(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception):
        scan_json_records(spark, str(tmp_path / "bad.json")).collect()


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, 2.5, " x ", ["p", None, "q"])], "i int, d double, s string, l array<string>").write.parquet(path)
    assert cells(load_table(spark, path)) == [("1", "2.5", "x", "p, q")]
    assert cells(scan_parquet(spark, path)) == [("1", "2.5", "x", "p, q")]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A", " A", "B"])
    assert dedupe_headers(df).columns == ["A", "A__1", "B"]


def test_unnamed(spark):
    df = spark.createDataFrame([("x", None, "y")], "a string, `Unnamed: 1` string, `Unnamed: 2` string")
    assert drop_unnamed_empty(df).columns == ["a", "Unnamed: 2"]


def test_flatten_keeps_lists(spark):
    df = spark.sql("SELECT named_struct('b', named_struct('c', 1), 'd', array(1, 2)) AS a")
    flat = flatten_json(df)
    assert flat.columns == ["a.b.c", "a.d"]
    assert cells(normalize_cells(flat)) == [("1", "1, 2")]


def test_rejected(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported"):
        load_table(spark, str(tmp_path / "x.xlsx"))
    path = tmp_path / "header.csv"
    path.write_text("name\n")
    with pytest.raises(ValueError, match="no rows"):
        load_table(spark, str(path))


@pytest.fixture
def small_blocks(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    kept = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def written(rows, sep, end="\n"):
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in (sep, '"', "\n", "\r")) else v
    return "".join(sep.join(map(quoted, row)) + end for row in rows)


@pytest.mark.parametrize("sep, end", [(",", "\n"), ("|", "\n"), ("\t", "\r\n"), (";", "\n")])
def test_a_split_file_is_read_like_a_whole_one(spark, tmp_path, small_blocks, sep, end):
    """Breaks, quotes and separators fall on the edges of blocks of 97 bytes; one record spans many blocks."""
    dice = random.Random(sep)
    pieces = ["x", "wörd ", "\n", "\n\n", '"', '""', sep, "12", " ", "'", "\\", '"' + sep, "long " * 9, "\r\n"]
    rows = [[str(i), *("".join(dice.choices(pieces, k=dice.randrange(6))) for _ in range(2))] for i in range(300)]
    rows[17][1] = ("a line\n" * 90) + '"'
    rows[18:18] = [["only", "", ""]]
    for name, part in {"a.csv": rows[:150], "b c.csv": rows[150:]}.items():
        (tmp_path / name).write_bytes(written([["id", 'first\n"name"', "second"], *part], sep, end).encode())
    whole, split = (scan_delimited(spark, str(tmp_path), sep=sep, split=s) for s in (False, True))
    assert whole.columns == split.columns and whole.count() == 301
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    assert split.rdd.getNumPartitions() > 20 > whole.rdd.getNumPartitions()
    assert sorted(map(str, scan_delimited(spark, str(tmp_path), split=True).collect())) == sorted(map(str, whole.collect()))


def test_split_files_without_rows_blank_lines_and_faults(spark, tmp_path, small_blocks):
    path = tmp_path / "a.csv"
    path.write_text('\n\nx,y\n\n1,2\n\n"3\n\n",\n5\n')
    assert [tuple(r) for r in scan_delimited(spark, str(path), split=True).orderBy("x").collect()] == [("1", "2"), ("3", None), ("5", None)]
    path.write_text("x,y\n")
    assert scan_delimited(spark, str(path), split=True).count() == 0
    for text, fault in {'x,y\n1,"2\n': "never closed", 'x,y\n1,5" 6"\n': "not quoted", "x,y\n1,2,3\n": "more cells"}.items():
        path.write_text(text)
        with pytest.raises(Exception, match=fault):
            scan_delimited(spark, str(path), split=True).collect()
    with pytest.raises(ValueError, match="UTF-8"):
        scan_delimited(spark, str(path), encoding="ISO-8859-1", split=True)
    with pytest.raises(ValueError):
        path.write_text("")
        scan_delimited(spark, str(path), split=True)


def test_a_split_file_without_quotes(spark, tmp_path, small_blocks):
    path = tmp_path / "a.csv"
    path.write_text("x,y\n" + "".join(f"{i},{i}\n" for i in range(2000)))
    df = scan_delimited(spark, str(path), split=True)
    assert df.count() == 2000 and df.agg(F.sum("x")).first()[0] == 1999000


def shuffled_records(plan):
    """Rows that the shuffles of an executed plan have written."""
    inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan"}
    if plan.nodeName() in inner:
        return shuffled_records(getattr(plan, inner[plan.nodeName()])())
    name, metrics, children = "shuffleRecordsWritten", plan.metrics(), plan.children()
    own = metrics.apply(name).value() if metrics.contains(name) else 0
    return own + sum(shuffled_records(children.apply(i)) for i in range(children.size()))


def test_only_first_lines_are_shuffled_to_find_delimiters(spark, tmp_path):
    """Many files of one task and one of several; the separator of later lines is another."""
    want = {}
    for i, sep in enumerate([",", "\t", ";", "|", ";", ","]):
        lines = [sep.join(["ab", "cd", "ef"])] * 2100 + ["x,y;z|" * 9] * (60_000 if i == 3 else 900)
        (tmp_path / f"{i}.csv").write_text("\n".join(lines))
        want[f"{i}.csv"] = sep
    (tmp_path / "7.csv").write_text("\n" * 2047 + ";" + "\n" * 3000 + "|" * 9)
    found = sniff_delimiter(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["delimiter"] for r in found.collect()} == want | {"7.csv": ";"}
    assert 0 < shuffled_records(found._jdf.queryExecution().executedPlan()) < 7 * 2048 + 300
