"""The first rows of tables and groups against a sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from tickettide.operators import pull
from tickettide.operators.selection import Level, first_rows, reached


def in_order(value, descending):
    """Sorts as the operator does: null before every value, after it if descending."""
    raw = (value is not None, value.encode() if value is not None else b"")
    return (not raw[0], tuple(255 - b for b in raw[1]) + (256,)) if descending else raw


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["1", "1", "1", "2", "", None, "é"]), str(rng.randrange(4)), i // 3)
            for i in range(400)]
    return rows, spark.createDataFrame(rows, "g string, t string, id string, v int").repartition(7)


@pytest.mark.parametrize("most", [1, 7, 100, 399, 400, 1000])
@pytest.mark.parametrize("descending", [False, True])
def test_first_rows_of_all(table, most, descending):
    rows, frame = table
    order = [Level("t", descending), Level("id")]
    got = [tuple(r) for r in first_rows(frame, most, order).collect()]
    want = sorted(rows, key=lambda r: (in_order(r[1], descending), r[2].encode()))[:most]
    assert sorted((repr(r[1]), r[2]) for r in got) == sorted((repr(r[1]), r[2]) for r in want)
    left = list(rows)
    for r in got:
        left.remove(r)
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in first_rows(frame.repartition(3), most, order).collect())


@pytest.mark.parametrize("most", [1, 5, 60, 200])
def test_first_rows_of_groups(table, most):
    rows, frame = table
    got = [tuple(r) for r in first_rows(frame, most, [Level("t"), Level("id")], ["g"]).collect()]
    for g in ("a", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (in_order(r[1], False), r[2].encode()))[:most]
        assert sorted((repr(r[1]), r[2]) for r in got if r[0] == g) == sorted((repr(r[1]), r[2]) for r in want)
    left = list(rows)
    for r in got:
        left.remove(r)


def test_copies_of_one_row(spark):
    frame = spark.createDataFrame([("x", "1")] * 50 + [("y", "1")] * 3, "g string, t string").repartition(6)
    assert [tuple(r) for r in first_rows(frame, 20, [Level("g")]).collect()] == [("x", "1")] * 20
    assert sorted(tuple(r) for r in first_rows(frame, 2, [Level("t")], ["g"]).collect()) == [("x", "1")] * 2 + [("y", "1")] * 2
    assert first_rows(frame, 0, [Level("g")]).count() == first_rows(frame.limit(0), 5, [Level("g")]).count() == 0


def test_where_a_count_is_reached(spark):
    counts = spark.createDataFrame([("a", i, 10) for i in range(100)] + [("b", 5, 3)], "g string, v int, _n long").repartition(9)
    rows = {r.g: tuple(r)[1:] for r in reached(counts, ["g"], Level("v"), 995).collect()}
    assert rows == {"a": (99, 5, 10)}
    wanted = spark.createDataFrame([("a", 10), ("b", 1)], "g string, _want long")
    assert {r.g: tuple(r)[1:] for r in reached(counts, ["g"], Level("v", True), wanted).collect()} == {"a": (99, 10, 10), "b": (5, 1, 3)}


def test_one_time_on_all_rows_is_cut_by_many_tasks(spark, landed, tmp_path):
    """A bulk update: the cap is taken by ticket, no task sees more than it reads."""
    rows = landed("incident", *({"sys_id": f"{i:05d}", "number": f"N{i}", "sys_updated_on": "2024-01-01 00:00:00"} for i in range(3000)))
    rows.repartition(6).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        got = pull.oldest_updates(spark.read.parquet(str(tmp_path / "t")), 2000, ordered=False)
        assert sorted(r.sys_id for r in got.collect()) == [f"{i:05d}" for i in range(2000)]
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(sizes) >= 4 and max(sizes) < 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("cap", [100, 1500])
def test_a_capped_backfill_sorts_and_ranks_nothing(spark, cap):
    from tickettide import adapters as a
    from tickettide.schema import DOMAINS

    log = a.change_log(a.Tables(spark, "/root/testdata/sf0.001").events)
    got = pull.backfill(log, DOMAINS["incident"], "2024-01-01", "2024-01-30", 7, cap)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan
