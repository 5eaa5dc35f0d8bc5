import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tabassay-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RETAIL = "store_id string, date string, sku string, sales string"
SURVEY = "respondent_id string, q1 string, q2 string, q3 string"


@pytest.fixture(scope="session")
def retail(spark):
    rows = [("1", "2024-06-01", "A", "100"), ("2", "2024-06-02", "B", "200"),
            ("3", "2024-06-03", "C", "150"), ("4", None, "D", "-5")]
    return spark.createDataFrame(rows, RETAIL)


@pytest.fixture(scope="session")
def survey(spark):
    rows = [("R1", "5", "5", "5"), ("R1", "5", "5", "5"), ("R2", "3", None, "4"),
            ("R3", None, None, None), ("R4", "1", "2", "3")]
    return spark.createDataFrame(rows, SURVEY)
