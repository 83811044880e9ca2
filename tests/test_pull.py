import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickettide.operators import pull, upsert
from tickettide.schema import DOMAINS

INCIDENT = DOMAINS["incident"]


def ids(frame):
    return [r.sys_id for r in frame.select("sys_id").collect()]


@pytest.fixture
def changes(landed):
    """A change log with a hot ticket that holds a third of all rows."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [
        {
            "sys_id": "hot" if i % 3 == 0 else f"t{rng.randrange(25)}",
            "number": f"N{i:04d}",
            "state": rng.choice(["a", "b", None, ""]),
            "sys_updated_on": str(start + timedelta(seconds=rng.randrange(40 * 86400))),
        }
        for i in range(600)
    ]
    return rows, landed("incident", *rows).repartition(6)


def test_the_cap_keeps_the_oldest_updates(landed):
    rows = landed("incident", *({"sys_id": str(i), "sys_updated_on": f"2024-01-0{i} 00:00:00"} for i in range(5, 0, -1)))
    assert ids(pull.oldest_updates(rows, 3)) == ["1", "2", "3"]
    assert ids(pull.oldest_updates(rows, 3, newest_first=True)) == ["5", "4", "3"]
    assert ids(pull.oldest_updates(rows, 0)) == []
    assert len(ids(pull.oldest_updates(rows, 99))) == len(ids(pull.oldest_updates(rows, None))) == 5


@pytest.mark.parametrize("cap", [1, 2, 3, 199, 200, 201, 5000])
@pytest.mark.parametrize("newest", [False, True])
def test_the_cap_equals_a_plain_ordered_limit(changes, landed, cap, newest):
    rows, frame = changes
    odd = [{"sys_id": f"n{i}", "number": "N", "sys_updated_on": v} for i, v in enumerate((None, "", "zz", "é"))]
    both = frame.unionByName(landed("incident", *odd))
    got = pull.oldest_updates(both, cap, newest_first=newest, tie_break=("sys_id", "number"))
    everything = sorted(rows + odd, key=lambda r: (r["sys_id"], r["number"]))
    everything.sort(key=lambda r: (r["sys_updated_on"] is not None, (r["sys_updated_on"] or "").encode()), reverse=newest)
    assert [(r.sys_id, r.number) for r in got.collect()] == [
        (r["sys_id"], r["number"]) for r in everything[:cap]]


def test_the_cap_filters_the_scan(spark, changes, tmp_path):
    _, frame = changes
    frame.write.parquet(str(tmp_path / "t"))
    capped = pull.oldest_updates(spark.read.parquet(str(tmp_path / "t")), 10)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Window" not in plan and plan.count("FileScan") == 1
    assert "LessThanOrEqual(sys_updated_on" in plan.split("PushedFilters", 1)[1]


def test_lookback_starts_at_the_start_of_a_day(landed):
    rows = landed("incident", *({"sys_id": s, "sys_updated_on": s} for s in (
        "2024-01-08 23:59:59", "2024-01-09", "2024-01-09 00:00:00", "2024-01-09T00:00:00Z", "2024-01-10 12:00:00")),
        {"sys_id": "none"}, {"sys_id": "blank", "sys_updated_on": ""})
    as_of = datetime(2024, 1, 10, 15)
    expected = ["2024-01-09", "2024-01-09 00:00:00", "2024-01-09T00:00:00Z", "2024-01-10 12:00:00"]
    for days in (1, 0, -5):
        assert sorted(ids(pull.pull_domain(rows, INCIDENT, as_of, days))) == expected
    assert len(ids(pull.pull_domain(rows, INCIDENT, as_of, 2))) == 5


def test_a_pull_takes_the_optional_domains_only_on_request(landed):
    tables = {n: landed(n, {"sys_id": "1", "sys_updated_on": "2024-01-10 00:00:00"}) for n in DOMAINS}
    assert list(pull.pull_snapshot(tables, "2024-01-10").frames) == ["incident", "request_item"]
    full = pull.pull_snapshot(tables, "2024-01-10", 0, include_change_requests=True, include_problems=True)
    assert list(full.frames) == list(DOMAINS) and full.since_days == 1
    for name, frame in full.frames.items():
        assert frame.columns == list(DOMAINS[name].fields)


def test_table_query(landed):
    rows = landed("problem", *({"sys_id": str(i), "state": "ab"[i % 2], "priority": str(i % 3)} for i in range(9)))
    page = pull.query_table(rows, filters={"state": "a"}, query="priority < '2'", order_by="sys_id",
                            fields=["sys_id"], limit=2, offset=1)
    assert page.columns == ["sys_id"] and ids(page) == ["4", "6"]
    assert tuple(pull.page_info(page, 2, 1).first()) == (2, 3, True)
    assert tuple(pull.page_info(pull.query_table(rows, limit=20, offset=-3), 20, -3).first()) == (9, 6, False)
    assert ids(pull.query_table(rows, query=F.col("sys_id") == "7", limit=None)) == ["7"]


def brute_backfill(rows, first, last, lookback, cap=None):
    """Day by day: the last change of every ticket so far, if recent enough."""
    out, day = set(), first
    while day <= last:
        latest = {}
        for r in sorted(rows, key=lambda r: (r["sys_updated_on"], r["number"])):
            if r["sys_updated_on"][:10] <= str(day):
                latest[r["sys_id"]] = r
        seen = [r for r in latest.values() if r["sys_updated_on"][:10] >= str(day - timedelta(days=lookback))]
        seen.sort(key=lambda r: (r["sys_updated_on"], r["sys_id"]))
        out |= {(day, r["sys_id"], r["number"]) for r in seen[:cap]}
        day += timedelta(days=1)
    return out


@pytest.mark.parametrize("lookback, cap", [(1, None), (5, None), (100, None), (5, 4), (5, 1)])
def test_backfill_equals_daily_pulls(changes, lookback, cap):
    rows, frame = changes
    first, last = date(2024, 1, 5), date(2024, 2, 3)
    got = pull.backfill(frame, INCIDENT, first, last, lookback, cap)
    assert {(r.snapshot_date, r.sys_id, r.number) for r in got.collect()} == brute_backfill(
        rows, first, last, lookback, cap)
    assert got.count() == got.select("snapshot_date", "sys_id").distinct().count()


def test_backfill_reads_only_the_days_it_needs(spark, changes, landed, tmp_path):
    _, frame = changes
    odd = landed("incident", {"sys_id": "z", "number": "Z", "sys_updated_on": "2024-01-21T01:00:00+02:00"},
                 {"sys_id": "y", "number": "Y", "sys_updated_on": "2024-01-19 "})
    frame.unionByName(odd).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    got = pull.backfill(log, INCIDENT, "2024-01-20", "2024-01-20", 2)
    assert got.filter("sys_id = 'z'").count() == 1
    pushed = got._jdf.queryExecution().executedPlan().toString().split("PushedFilters", 1)[1]
    assert "GreaterThanOrEqual(sys_updated_on,2024-01-17)" in pushed
    assert "LessThanOrEqual(sys_up" in pushed  # Spark cuts the text off here


def test_a_hot_ticket_is_cut_down_before_the_shuffle(changes):
    _, frame = changes
    stamped = pull.stamp(frame, 1, "2024-03-01 00:00:00")
    plan = upsert.last_write_wins(stamped, INCIDENT)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning", 1)[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_last_write_wins(tickets):
    first = tickets("incident", {"sys_id": "1", "state": "a", "sys_updated_on": "2024-01-01"},
                    {"sys_id": "1", "state": "b", "sys_updated_on": "2024-01-02"},
                    {"sys_id": None, "state": "x"}, {"sys_id": "", "state": "y"})
    again = tickets("incident", {"sys_id": "1", "state": "c", "sys_updated_on": "2023-01-01"}, run_id=2)
    other_day = tickets("incident", {"sys_id": "1", "state": "d"}, day=date(2024, 1, 11))
    rows = first.unionByName(again).unionByName(other_day)
    got = upsert.last_write_wins(rows, INCIDENT)
    assert sorted((str(r.snapshot_date)[8:], r.sys_id, r.state) for r in got.collect()) == [
        ("10", "", "y"), ("10", "1", "c"), ("11", "1", "d")]
    twice = upsert.last_write_wins(rows.unionByName(rows), INCIDENT)
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_latest_write_in_one_step(spark):
    from checks.registry import fields_of
    from tickettide import adapters as a

    runs = fields_of(a.request_items(a.Tables(spark, "/root/testdata/sf0.001")))
    domain = DOMAINS["request_item"]
    one = upsert.latest_write_per_ticket(runs, domain)
    two = upsert.latest_per_ticket(upsert.last_write_wins(runs, domain))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and one.count() > 1000


def test_now_is_the_default(landed):
    today = datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    rows = landed("incident", {"sys_id": "1", "sys_updated_on": today}, {"sys_id": "2", "sys_updated_on": "2001-01-01"})
    assert ids(pull.pull_domain(rows, INCIDENT)) == ["1"]


def test_texts_are_made_after_the_shuffle(spark, tickets):
    """With texts given as expressions the winners are the same, ties included, and no text travels."""
    from pyspark.sql import functions as F

    rows = tickets("incident", {"sys_id": "1", "state": "a", "sys_updated_on": "2024-01-02"},
                   {"sys_id": "1", "state": "b", "sys_updated_on": "2024-01-01"},
                   {"sys_id": "2", "state": None, "category": "z"}, {"sys_id": "2", "state": "", "category": "y"},
                   {"sys_id": None, "state": "x"}, {"sys_id": "", "state": "y"}).drop("raw_payload")
    rows = rows.unionByName(rows.filter("state = 'b'").withColumn("run_id", F.lit(2).cast("bigint")))
    texts = {f: F.concat(F.lit(f"made {f} "), F.coalesce("state", F.lit("none"))) for f in ("number", "short_description", "caller_id")}
    later = upsert.last_write_wins(rows.drop(*texts), INCIDENT, texts)
    before = upsert.last_write_wins(rows.withColumns(texts), INCIDENT)
    above, below = later._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning", 1)
    assert later.columns == before.columns
    assert sorted(map(str, later.collect())) == sorted(map(str, before.collect())) and later.count() == 3
    assert "made number" in above and "made" not in below and "Exchange" not in below
    assert "WindowGroupLimit" in below and above.count("Sort [") == below.count("Sort [") == 1
