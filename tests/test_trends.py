from datetime import date, datetime

import pytest

from tickettide.operators import trends
from tickettide.plans import reports
from tickettide.plans.views import register_views
from tickettide.schema import DOMAINS


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture
def blank_labels(tickets):
    return tickets(
        "incident",
        {"sys_id": "1", "category": None, "state": "New"},
        {"sys_id": "2", "category": "", "state": "New", "closed_at": ""},
        {"sys_id": "3", "category": "A", "state": None, "closed_at": "2024-01-09 00:00:00"},
        {"sys_id": "4", "category": "A", "state": ""},
        {"sys_id": "5", "category": "A", "state": ""},
    )


def test_null_and_empty_stay_two_groups_with_one_label(blank_labels):
    got = rows_of(
        trends.incident_trends_daily(blank_labels),
        "category", "state", "ticket_count", "open_count", "closed_count",
    )
    assert got == [
        ("A", "Unknown", 1, 0, 1),
        ("A", "Unknown", 2, 2, 0),
        ("Uncategorised", "New", 1, 1, 0),
        ("Uncategorised", "New", 1, 1, 0),
    ]


def test_blanks_can_be_merged(blank_labels):
    got = rows_of(
        trends.incident_trends_daily(blank_labels, merge_blank=True),
        "category", "state", "ticket_count", "open_count", "closed_count",
    )
    assert got == [("A", "Unknown", 3, 2, 1), ("Uncategorised", "New", 2, 2, 0)]


def test_request_and_change_types_group_by_label(tickets):
    items = tickets(
        "request_item",
        {"sys_id": "1", "state": "x"}, {"sys_id": "2", "cat_item": "", "state": "x"},
        {"sys_id": "3", "cat_item": "Laptop", "state": None},
    )
    assert rows_of(
        trends.request_type_trends_daily(items), "request_type", "state", "request_count"
    ) == [("Laptop", "Unknown", 1), ("Unspecified Item", "x", 2)]
    states = ["Closed", "COMPLETE", "completed", "Cancelled", "canceled", "New", "", None, " closed"]
    changes = tickets("change_request", *({"sys_id": str(i), "state": s} for i, s in enumerate(states)))
    got = trends.change_request_trends_daily(changes)
    assert {r.change_type for r in got.collect()} == {"Unspecified Type"}
    assert sum(r.open_count for r in got.collect()) == 4
    assert reports.change_daily_totals(changes).first().open_changes == 4


def sla(tickets, *rows, **options):
    frame = trends.incident_sla_daily(tickets("incident", *rows), **options)
    return {r.priority: (r.resolved_count, r.avg_resolution_hours, r.breached_count) for r in frame.collect()}


def incident(n, priority, end, **more):
    return {"sys_id": str(n), "priority": priority, "opened_at": "2024-01-09 08:00:00",
            "resolved_at": end} | more


def test_exactly_on_the_limit_is_no_breach(tickets):
    got = sla(tickets, incident(1, "1", "2024-01-09 12:00:00"), incident(2, "1", "2024-01-09 12:00:01"),
              incident(3, "2", "2024-01-09 16:00:00"))
    assert got == {"1": (2, 4.0, 1), "2": (1, 8.0, 0)}


def test_empty_resolving_time_counts_without_duration(tickets):
    got = sla(tickets, incident(1, "1", "", closed_at="2024-02-01 00:00:00"),
              incident(2, "1", "2024-01-09 10:00:00"), incident(3, "3", ""))
    assert got == {"1": (2, 2.0, 0), "3": (1, None, 0)}


def test_rows_without_times_are_left_out(tickets):
    assert sla(tickets, {"sys_id": "1", "priority": "1"},
               {"sys_id": "2", "priority": "1", "opened_at": "2024-01-01 00:00:00"}) == {}


def test_odd_priorities_take_the_default_limit(tickets):
    five_days = "2024-01-14 08:00:00"
    got = sla(tickets, incident(1, "1 - Critical", five_days), incident(2, "", "2024-01-14 08:00:01"),
              incident(3, None, five_days))
    assert got == {"1 - Critical": (1, 120.0, 0), "Unknown": (2, 120.0, 1)}


def test_open_tickets_count_as_resolved_unless_strict(tickets):
    still_open = {"sys_id": "1", "priority": "1", "opened_at": "2024-01-09 08:00:00",
                  "sys_updated_on": "2024-01-09 14:00:00"}
    assert sla(tickets, still_open) == {"1": (1, 6.0, 1)}
    assert sla(tickets, still_open, strict=True) == {}


def test_limits_from_a_table(spark, tickets):
    limits = spark.createDataFrame([("1", 100)], "priority string, limit_hours int")
    rows = tickets("incident", incident(1, "1", "2024-01-12 08:00:00"), incident(2, "9", "2024-01-19 08:00:00"))
    got = trends.incident_sla_by_table(rows, limits)
    assert rows_of(got, "priority", "breached_count") == [("1", 0), ("9", 1)]
    twice = trends.incident_sla_by_table(rows, limits.unionAll(limits))
    assert rows_of(twice, "priority", "resolved_count") == [("1", 1), ("9", 1)]
    odd = limits.unionAll(spark.createDataFrame([("1", 7)], limits.schema))
    with pytest.raises(Exception, match="two limits for priority 1"):
        trends.incident_sla_by_table(rows, odd).collect()


def test_sums_fit_many_long_durations(spark, tickets):
    one = tickets("incident", incident(1, "1", "2999-01-09 08:00:00"))
    many = one.crossJoin(spark.range(100_000)).drop("id")
    row = trends.incident_sla_daily(many).first()
    assert (row.resolved_count, row.breached_count) == (100_000, 100_000)
    assert row.avg_resolution_hours == pytest.approx(8546568, abs=24 * 400)


def test_latest_state(tickets):
    rows = tickets("incident", {"sys_id": "1", "state": "old", "opened_at": "2024-01-01 00:00:00"})
    rows = rows.unionByName(tickets(
        "incident", {"sys_id": "1", "state": "new", "opened_at": None, "sys_created_on": "2024-01-02",
                     "closed_at": ""},
        run_id=2, day=date(2024, 1, 11), pulled_at=datetime(2024, 1, 11, 6)))
    row = reports.incident_latest(rows, datetime(2024, 1, 12, 12)).collect()
    assert len(row) == 1
    assert (row[0].state, row[0].is_open, row[0].age_days) == ("new", 1, 10.5)
    assert row[0].last_pulled_at == datetime(2024, 1, 11, 6)


def test_top_lists_break_ties_by_name(tickets):
    rows = tickets("incident", *({"sys_id": str(i), "category": f"c{i % 20:02d}"} for i in range(40)),
                   {"sys_id": "x", "category": "zz"}, *({"sys_id": f"y{i}"} for i in range(3)))
    got = [(r.category, r.tickets) for r in reports.top_categories(rows).collect()]
    assert got == [("Uncategorised", 3)] + [(f"c{i:02d}", 2) for i in range(14)]


def test_invariants(spark):
    from checks.registry import registered, request_items_now
    from tickettide import adapters as a

    tables = a.Tables(spark, "/root/testdata/sf0.001")
    items = request_items_now(tables)
    daily = trends.request_type_trends_daily(items)
    sums = daily.selectExpr(
        "sum(request_count) AS n", "sum(open_count + closed_count) AS parts").first()
    assert sums.n == sums.parts == items.count()
    assert registered()["incident_sla_daily"](spark, tables.folder).filter(
        "breached_count > resolved_count").isEmpty()
    shares = reports.request_share_weekly(items).groupBy("period_start").sum("share")
    assert all(abs(r[1] - 1) < 0.001 for r in shares.collect())
    latest = reports.request_item_latest(items)
    assert latest.count() == latest.select("sys_id").distinct().count()


def test_existing_sql_runs_on_the_views(spark, tickets, blank_labels):
    from tickettide.schema import RUN_LOG_SCHEMA

    snapshots = {name: tickets(name, {"sys_id": "1", "state": "New"}) for name in DOMAINS}
    snapshots["incident"] = blank_labels
    runs = spark.createDataFrame([], RUN_LOG_SCHEMA)
    names = register_views(snapshots, runs, as_of="2024-01-10 00:00:00")
    assert len(names) == 13
    for name in names:
        spark.sql(f"SELECT * FROM {name} LIMIT 100").collect()
    total = spark.sql(
        "SELECT snapshot_date, SUM(ticket_count) AS n, SUM(open_count) AS still_open "
        "FROM v_incident_trends_daily GROUP BY snapshot_date ORDER BY snapshot_date").collect()
    mine = reports.incident_daily_totals(blank_labels).collect()
    assert [tuple(r) for r in total] == [tuple(r) for r in mine] == [(date(2024, 1, 10), 5, 4)]
    top = spark.sql("SELECT category, SUM(ticket_count) AS tickets FROM v_incident_trends_daily "
                    "GROUP BY category ORDER BY tickets DESC LIMIT 15").collect()
    assert [tuple(r) for r in top] == [tuple(r) for r in reports.top_categories(blank_labels).collect()]
