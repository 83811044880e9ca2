"""Every registered query against its SQL, and the shape of the registry."""

import pytest

import __spark_entry__ as driver
from checks.oracles import STATEMENTS
from checks.registry import registered
from compare import compare, connect

FOLDER = driver.SMOKE_FOLDER


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registered()))
def test_spark_and_sql_agree(spark, duck, name):
    assert compare(spark, duck, name, FOLDER) is None


def test_every_query_has_its_sql():
    assert set(registered()) == set(STATEMENTS)
    assert set(registered()) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns == [
        "snapshot_date", "priority", "resolved_count", "avg_resolution_hours", "breached_count"]


@pytest.mark.parametrize("name", ["lenient_date", "incident_sla_daily", "incident_latest", "stream_hourly_trend"])
def test_results_do_not_depend_on_the_session_zone(other_zone, duck, name):
    assert compare(other_zone, duck, name, FOLDER) is None
