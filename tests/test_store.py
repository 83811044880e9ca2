from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tickettide.operators.pull import Snapshot, stamp
from tickettide.plans.store import SnapshotStore, run_log_rows
from tickettide.plans.sync import sync, sync_report
from tickettide.plans.views import register_store
from tickettide.schema import DOMAINS, RUN_LOG_SCHEMA

DAY = datetime(2024, 1, 10, 6)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def content(store, name="incident"):
    return sorted(
        (str(r.snapshot_date)[8:], r.sys_id, r.state, r.run_id) for r in store.current(name).collect()
    )


def test_an_empty_store_can_be_read(store):
    assert store.run_log().collect() == [] and store.next_run_id() == 1
    assert content(store) == []
    store.settle("incident")
    assert content(store) == []
    assert len(register_store(store)) == 13


def test_sync_stores_and_logs(store, landed):
    updated = "2024-01-09 00:00:00"
    tables = {n: landed(n, {"sys_id": "1", "sys_updated_on": updated}, {"sys_id": "1", "sys_updated_on": updated},
                        {"sys_id": "old", "sys_updated_on": "2001-01-01"}) for n in DOMAINS}
    run = sync(store, tables, DAY, include_problems=True)
    assert [tuple(r) for r in run.collect()] == [(
        1, date(2024, 1, 10), DAY, 30, 2, 2, 0, 2, "success",
        "Pulled 2 incidents and 2 request items; 0 change requests; 2 problems")]
    assert sync_report(run).first()[0] == (
        "Sync succeeded: snapshot_date=2024-01-10 incidents=2 requests=2 changes=0 problems=2")
    assert content(store) == [("10", "1", None, 1)]
    assert content(store, "change_request") == []
    payload = store.current("problem").first().raw_payload
    assert payload.startswith('{"sys_id":"1","number":null,') and "sys_updated_on" in payload


def test_a_pull_without_rows_is_logged(store, landed):
    sync(store, {n: landed(n) for n in DOMAINS}, DAY)
    second = sync(store, {n: landed(n) for n in DOMAINS}, DAY)
    assert [(r.id, r.incident_count) for r in store.run_log().orderBy("id").collect()] == [(1, 0), (2, 0)]
    assert second.first().id == 2
    register_store(store)
    newest = store.spark.sql("SELECT * FROM v_snapshot_run_summary LIMIT 200")
    assert [r.id for r in newest.collect()] == [2, 1]


def snapshot(landed, *rows, as_of=DAY, notes=None):
    return Snapshot({"incident": landed("incident", *rows)}, as_of, 30, notes)


def test_later_runs_replace_and_dates_accumulate(store, landed):
    store.store(snapshot(landed, {"sys_id": "1", "state": "a"}, {"sys_id": "2", "state": "a"}))
    store.store(snapshot(landed, {"sys_id": "1", "state": "b"}, notes="again"))
    store.store(snapshot(landed, {"sys_id": "1", "state": "c"}, as_of=datetime(2024, 1, 11, 6)))
    expected = [("10", "1", "b", 2), ("10", "2", "a", 1), ("11", "1", "c", 3)]
    assert content(store) == expected
    assert sorted((r.sys_id, r.state) for r in store.latest("incident").collect()) == [("1", "c"), ("2", "a")]
    store.settle("incident")
    assert content(store) == expected
    store.store(snapshot(landed, {"sys_id": "2", "state": "d"}, {"sys_id": "3", "state": "d"}))
    expected = [("10", "1", "b", 2), ("10", "2", "d", 4), ("10", "3", "d", 4), ("11", "1", "c", 3)]
    assert content(store) == expected
    store.settle("incident")
    store.settle("incident")
    assert content(store) == expected
    assert sorted((r.sys_id, r.state) for r in store.latest("incident").collect()) == [
        ("1", "c"), ("2", "d"), ("3", "d")]
    assert [r.notes for r in store.run_log().orderBy("id").collect()][1] == "again"


def test_settled_dates_are_read_without_a_shuffle_by_ticket(store, landed):
    store.store(snapshot(landed, {"sys_id": "1"}))
    store.settle("incident")
    pruned = store.run_rows("incident", after=1)
    assert pruned.inputFiles() and pruned.count() == 0
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "run_id" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]


def test_a_large_day_is_written_by_several_tasks(spark, store, landed, tmp_path):
    def files(folder):
        return len([f for f in store.spark.read.parquet(f"{store.root}/runs/incident").inputFiles() if folder in f])

    rows = landed("incident", {"short_description": "x" * 40}).crossJoin(spark.range(20_000)).withColumn(
        "sys_id", F.sha2(F.col("id").cast("string"), 256)).drop("id")
    small = rows.limit(10)
    # Sizes at which the little data of a test counts as large.
    sizes = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    }
    for setting, size in sizes.items():
        spark.conf.set(setting, size)
    try:
        both = stamp(rows, 1, DAY).unionByName(stamp(small, 2, datetime(2024, 1, 11)))
        store.write_runs({"incident": both}, since_days=1)
        store.store(Snapshot({"incident": rows}, datetime(2024, 1, 12)), run_id=3)
    finally:
        for setting in sizes:
            spark.conf.unset(setting)
    assert files("run_id=1/") > 2 and files("run_id=3/") > 2
    assert store.current("incident").count() == 40_010


def test_writing_a_run_again_changes_nothing(store, landed):
    rows = snapshot(landed, {"sys_id": "1", "state": "a"}, {"sys_id": "2", "state": "b"})
    store.store(rows, run_id=7)
    before = content(store), store.run_log().collect()
    store.store(rows, run_id=7)
    assert (content(store), store.run_log().collect()) == before


def test_an_unfinished_run_is_not_seen(store, landed):
    store.store(snapshot(landed, {"sys_id": "1", "state": "a"}))
    broken = stamp(landed("incident", {"sys_id": "1", "state": "half"}), 2, DAY)
    store._write_tickets({"incident": broken}, "broken")
    assert content(store) == [("10", "1", "a", 1)]
    store.store(snapshot(landed, {"sys_id": "1", "state": "whole"}), run_id=2)
    assert content(store) == [("10", "1", "whole", 2)]


@pytest.mark.parametrize("case", ["another day", "domain left out", "domain empty"])
def test_nothing_of_a_failed_attempt_is_seen(store, landed, case):
    """The retry of a run decides alone what the run holds."""
    failed = {n: stamp(landed(n, {"sys_id": "1", "state": "failed"}), 1, DAY) for n in ("incident", "problem")}
    store._write_tickets(failed, "failed")
    again = {"incident": landed("incident", {"sys_id": "2", "state": "whole"})}
    if case == "domain empty":
        again["problem"] = landed("problem")
    as_of = datetime(2024, 1, 11, 6) if case == "another day" else DAY
    store.store(Snapshot(again, as_of), run_id=1)
    assert content(store) == [(str(as_of.day), "2", "whole", 1)]
    assert content(store, "problem") == []
    assert store.run_log().first().problem_count == 0


def test_the_json_copy_is_not_shuffled(spark, store, landed):
    from tickettide.operators.upsert import last_write_wins
    from tickettide.plans.store import with_payload

    rows = stamp(landed("incident", {"sys_id": "1"}), 1, DAY)
    plan = with_payload(last_write_wins(rows, DOMAINS["incident"]), DOMAINS["incident"])._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "raw_payload" in above and "raw_payload" not in below


def test_several_runs_in_one_write(store, landed):
    rows = landed("incident", {"sys_id": "1"}, {"sys_id": "2"})
    both = stamp(rows, 1, DAY).unionByName(stamp(rows, 2, datetime(2024, 1, 11)))
    store.write_runs({"incident": both}, since_days=1)
    assert [r.incident_count for r in store.run_log().orderBy("id").collect()] == [2, 2]
    assert len(content(store)) == 4
    log = run_log_rows({"incident": both}, 1)
    assert log.schema.fieldNames() == RUN_LOG_SCHEMA.fieldNames()


def folders(path, start):
    return sorted(p.name for p in path.iterdir() if p.name.startswith(start)) if path.exists() else []


def test_settling_merges_the_logs(store, landed, tmp_path):
    def runs(*numbers):
        for n in numbers:
            store.run_of_batch("s", n, DAY)
            store.store(snapshot(landed, {"sys_id": str(n), "state": "a"}), run_id=n)

    runs(1, 2, 3)
    store.settle("incident")
    runs(4, 5)
    before = store.run_log()
    store.settle("incident")
    root = tmp_path / "store"
    # Entries that the first checkpoint held are gone, those of the second stay until the third.
    assert folders(root / "run_log", "id=") == ["id=4", "id=5"]
    assert folders(root / "stream_runs" / "stream=s", "batch=") == ["batch=4", "batch=5"]
    assert folders(root / "run_log_checkpoint", "upto=") == ["upto=3", "upto=5"]
    assert len([p for p in (root / "run_log_checkpoint" / "upto=5").iterdir() if p.suffix == ".parquet"]) == 1
    assert [r.id for r in before.orderBy("id").collect()] == [1, 2, 3, 4, 5]
    runs(6)
    store.settle("incident")
    assert folders(root / "run_log", "id=") == ["id=6"] and folders(root / "run_log_checkpoint", "upto=") == ["upto=5", "upto=6"]
    assert [(r.id, r.incident_count) for r in store.run_log().orderBy("id").collect()] == [(n, 1) for n in range(1, 7)]
    assert store.run_of_batch("s", 2, datetime(2030, 1, 1)) == (2, DAY) and store.next_run_id() == 7
    assert {r[1] for r in content(store)} == {str(n) for n in range(1, 7)}


def test_a_checkpoint_cut_short_is_not_seen(store, landed, tmp_path):
    for n in (1, 2):
        store.store(snapshot(landed, {"sys_id": str(n)}))
    store.settle("incident")
    (tmp_path / "store" / "run_log_checkpoint" / "upto=9").mkdir()
    assert [r.id for r in store.run_log().orderBy("id").collect()] == [1, 2] and store.next_run_id() == 3


def numbered(landed, prefix, count, **fields):
    return landed("incident", *({"sys_id": f"{prefix}{i}", "number": f"INC{i:06d}", **fields} for i in range(count)))


def test_latest_over_settled_rows_needs_no_exchange(spark, store, landed):
    for day in (10, 11):
        store.store(Snapshot({"incident": numbered(landed, "t", 300, state=f"d{day}")}, datetime(2024, 1, day, 6)))
    want = sorted(map(tuple, store.latest("incident").collect()))
    store.settle("incident")
    settled = store.latest("incident")
    plan = settled.filter("number = 'INC000123'")._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, settled.collect())) == want
    assert "Exchange" not in plan and "EqualTo(number,INC000123)" in plan.split("PushedFilters", 1)[1]
    # Files hold ranges of the number, so the filter leaves out all row groups but one.
    spans = settled.groupBy(F.input_file_name()).agg(F.min("number").alias("a"), F.max("number").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_newer_runs_replace_settled_latest_rows(store, landed):
    def run(day, *rows):
        store.store(snapshot(landed, *({"sys_id": i, "number": i, "state": s} for i, s in rows), as_of=datetime(2024, 1, day, 6)))

    def both():
        fast = sorted((r.sys_id, r.state, r.run_id) for r in store.latest("incident").collect())
        plain = {}
        for r in store.current("incident").collect():
            plain[r.sys_id] = max(plain.get(r.sys_id, (r.snapshot_date, 0, "")), (r.snapshot_date, r.run_id, r.state))
        assert fast == sorted((k, s, n) for k, (_, n, s) in plain.items())
        return fast

    run(10, ("a", "1"), ("b", "1"), ("c", "1"))
    run(12, ("c", "2"))
    store.settle("incident")
    assert both() == [("a", "1", 1), ("b", "1", 1), ("c", "2", 2)]
    # A run of an older day reopens it: its row of c is older than the settled one, that of d is new.
    run(11, ("b", "3"), ("c", "3"), ("d", "3"))
    run(12, ("c", "4"))
    run(10, ("a", "5"), ("e", "5"))
    assert both() == [("a", "5", 5), ("b", "3", 3), ("c", "4", 4), ("d", "3", 3), ("e", "5", 5)]
    store.settle("incident")
    assert both() == [("a", "5", 5), ("b", "3", 3), ("c", "4", 4), ("d", "3", 3), ("e", "5", 5)]


def test_maintained_reports_read_settled_dates_as_kept(store, landed, tmp_path):
    import shutil

    from tickettide.plans.maintained import DAILY, MaintainedReports

    some = {r: DAILY[r] for r in ("incident_trends_daily", "incident_sla_daily", "problem_trends_daily")}
    kept = MaintainedReports(store, some)

    def run(day, **domains):
        frames = {n: landed(n, *rows) for n, rows in domains.items()}
        store.store(Snapshot(frames, datetime(2024, 1, day, 6)))

    def equal():
        for report, (name, compute) in some.items():
            want = sorted(map(repr, compute(store.current(name)).collect()))
            assert sorted(map(repr, kept.read(report).collect())) == want, report

    run(10, incident=[{"sys_id": "1", "category": "", "opened_at": "2024-01-10 00:00:00", "resolved_at": "2024-01-10 05:00:00", "priority": "1"},
                      {"sys_id": "2", "state": "x"}], problem=[{"sys_id": "1"}])
    run(11, incident=[{"sys_id": "1", "category": "net"}])
    for name in ("incident", "problem"):
        kept.settle(name)
    equal()
    # Settled without its reports: those dates are computed until the next settling.
    run(12, incident=[{"sys_id": "3"}], problem=[{"sys_id": "9", "state": "z"}])
    store.settle("incident")
    run(11, incident=[{"sys_id": "1", "category": "disk"}, {"sys_id": "4"}])
    equal()
    # Rows of kept dates are not looked at: without them the reports are the same.
    before = sorted(map(repr, kept.read("incident_trends_daily").collect()))
    for folder in (tmp_path / "store" / "settled" / "incident").glob("generation=*/snapshot_date=2024-01-10"):
        shutil.rmtree(folder)
    assert sorted(map(repr, kept.read("incident_trends_daily").collect())) == before


def test_dates_of_a_single_run_pass_straight_through(store, tickets):
    one, two = date(2024, 1, 10), date(2024, 1, 11)
    for run, day, state in ((1, one, "New"), (2, two, "New"), (3, two, "Closed")):
        store.write_runs({"incident": tickets("incident", {"sys_id": "a", "state": state}, run_id=run, day=day)}, since_days=30)
    assert "Union" in store.current("incident")._jdf.queryExecution().optimizedPlan().toString()
    assert content(store) == [("10", "a", "New", 1), ("11", "a", "Closed", 3)]
    store.settle("incident")
    for run, day in ((4, one), (5, date(2024, 1, 12))):
        store.write_runs({"incident": tickets("incident", {"sys_id": "a", "state": "Seen"}, run_id=run, day=day)}, since_days=30)
    assert content(store) == [("10", "a", "Seen", 4), ("11", "a", "Closed", 3), ("12", "a", "Seen", 5)]


def test_a_stable_run_without_repeats_is_written_as_it_comes(store, landed, monkeypatch):
    from tickettide.plans import store as module

    shuffled = []
    kept = module.last_write_wins
    monkeypatch.setattr(module, "last_write_wins", lambda rows, domain: shuffled.append(domain.name) or kept(rows, domain))
    frames = {
        "incident": landed("incident", {"sys_id": "1", "state": "a"}, {"sys_id": None, "state": "b"}),
        "request_item": landed("request_item", {"sys_id": None, "state": "x"}, {"sys_id": "", "state": "y"}),
        "problem": landed("problem"),
    }
    run = store.store(Snapshot(frames, DAY, 30), stable=True).first()
    assert shuffled == ["request_item"]
    assert (run.incident_count, run.request_item_count, run.problem_count) == (2, 2, 0)
    assert content(store) == [("10", "", "b", 1), ("10", "1", "a", 1)]
    assert content(store, "request_item") == [("10", "", "y", 1)]
    assert store.current("incident").filter("sys_id = '1'").first().raw_payload.startswith('{"sys_id":"1"')
    sync(store, frames | {"change_request": landed("change_request")}, DAY)
    assert shuffled[1:] == ["incident", "request_item"]


def test_the_json_copy_of_a_synced_ticket_is_not_shuffled(spark):
    from checks.registry import landed_domains
    from tickettide.adapters import Tables

    frames = landed_domains(Tables(spark, "/root/testdata/sf0.001"))
    assert {name: tuple(rows.columns) for name, rows in frames.items()} == {name: domain.fields for name, domain in DOMAINS.items()}
