import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def other_zone(spark):
    """A session far from UTC, with daylight saving."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def tickets(spark):
    """Build snapshot rows of a domain from keyword fields; the rest is NULL."""
    from datetime import date, datetime

    from tickettide.schema import DOMAINS

    def build(name, *rows, run_id=1, day=date(2024, 1, 10), pulled_at=datetime(2024, 1, 10, 6)):
        domain = DOMAINS[name]
        lead = {"run_id": run_id, "snapshot_date": day, "pulled_at": pulled_at}
        data = [tuple((lead | row).get(c) for c in domain.snapshot_columns) for row in rows]
        return spark.createDataFrame(data, domain.snapshot_schema)

    return build


@pytest.fixture
def landed(spark):
    """Build landed tickets of a domain, fields as keywords."""
    from tickettide.schema import DOMAINS

    def build(name, *rows):
        domain = DOMAINS[name]
        return spark.createDataFrame(
            [tuple(row.get(f) for f in domain.fields) for row in rows], domain.ticket_schema
        )

    return build
