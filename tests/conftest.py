import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import fixtures  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bookings(spark):
    return fixtures.bookings(spark)


@pytest.fixture(scope="session")
def retail(spark):
    return fixtures.retail(spark)


@pytest.fixture(scope="session")
def edtech(spark):
    return fixtures.edtech(spark)


@pytest.fixture(scope="session")
def survey(spark):
    return fixtures.survey(spark)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
