from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickettide import adapters as a
from tickettide.operators.pull import Snapshot
from tickettide.plans.store import SnapshotStore
from tickettide.schema import DOMAINS
from tickettide.sources.landed import stream_extract
from tickettide.streaming import jobs


@pytest.fixture
def landing(spark, landed, tmp_path):
    def land(name, *rows, domain="incident"):
        landed(domain, *rows).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    land.path = str(tmp_path / "in" / "*")
    return land


def test_each_batch_is_one_run_and_a_restart_adds_nothing(spark, landing, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def run():
        tickets = stream_extract(spark, landing.path, DOMAINS["incident"], maxFilesPerTrigger=1)
        jobs.stream_sync(tickets, "incident", store, str(tmp_path / "cp"),
                         clock=lambda: datetime(2024, 1, 10, 6)).awaitTermination()
        return sorted((r.run_id, r.sys_id, r.state) for r in store.current("incident").collect())

    landing("a", {"sys_id": "1", "state": "a", "sys_updated_on": "1"}, {"sys_id": "1", "state": "b", "sys_updated_on": "2"},
            {"sys_id": "2", "state": "a"})
    assert run() == [(1, "1", "b"), (1, "2", "a")]
    assert run() == [(1, "1", "b"), (1, "2", "a")]
    landing("b", {"sys_id": "2", "state": "c"})
    assert run() == [(1, "1", "b"), (2, "2", "c")]
    assert [(r.id, r.incident_count) for r in store.run_log().orderBy("id").collect()] == [(1, 3), (2, 1)]


def test_a_batch_run_again_replaces_itself(spark, landed, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    from tickettide.operators.pull import stamp

    for _ in range(2):
        store.write_runs({"incident": stamp(landed("incident", {"sys_id": "1"}), 5, "2024-01-10")}, 1)
    assert store.run_log().count() == store.current("incident").count() == 1


FILES = "filename string, received_at string, received timestamp_ntz, sender string"


def test_files_come_through_once(spark, tmp_path):
    def land(name, *rows):
        data = [(f, at, datetime.fromisoformat(at), "s") for f, at in rows]
        spark.createDataFrame(data, FILES).repartition(3).write.parquet(str(tmp_path / "in" / name))

    def run():
        files = spark.readStream.schema(FILES).parquet(str(tmp_path / "in" / "*"))
        jobs.stream_ingest_once(files, str(tmp_path / "keys"), str(tmp_path / "cp")).awaitTermination()
        return sorted(tuple(r) for r in jobs.ingested_keys(spark, str(tmp_path / "keys")).collect())

    hot = ("hot.xlsx", "2024-01-01 10:00:00")
    land("a", *[hot] * 50, ("b.xlsx", "2024-01-01 10:00:00"), ("b.xlsx", "2024-01-01 11:00:00"))
    first = sorted([hot, ("b.xlsx", "2024-01-01 10:00:00"), ("b.xlsx", "2024-01-01 11:00:00")])
    assert run() == first
    land("b", hot, ("c.xlsx", "2024-01-01 10:30:00"), ("late.xlsx", "2001-01-01 00:00:00"))
    both = sorted([*first, ("c.xlsx", "2024-01-01 10:30:00"), ("late.xlsx", "2001-01-01 00:00:00")])
    assert run() == both
    # A new checkpoint sees all files again and adds none.
    files = spark.readStream.schema(FILES).parquet(str(tmp_path / "in" / "*"))
    jobs.stream_ingest_once(files, str(tmp_path / "keys"), str(tmp_path / "other")).awaitTermination()
    assert run() == both


def test_hourly_trend(spark, tmp_path):
    """Append drops rows behind the watermark, update adds them up."""
    schema = "pulled_at timestamp_ntz, category string, state string, closed_at string"

    def land(name, *moments):
        rows = [(datetime.fromisoformat(m), "", "s", None) for m in moments]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run(mode):
        tickets = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        jobs.stream_hourly_trend(tickets, str(tmp_path / mode), str(tmp_path / f"cp-{mode}"), mode).awaitTermination()
        path = str(tmp_path / mode)
        rows = spark.read.parquet(path) if mode == "append" else jobs.hourly_totals(spark, path)
        return sorted((str(r.hour_start), r.category, r.ticket_count, r.open_count) for r in rows.collect())

    land("a", "2024-01-01 10:05:00", "2024-01-01 10:55:00", "2024-01-04 00:00:00")
    assert run("append") == [("2024-01-01 10:00:00", "Uncategorised", 2, 2)]
    assert run("update") == [("2024-01-01 10:00:00", "Uncategorised", 2, 2),
                             ("2024-01-04 00:00:00", "Uncategorised", 1, 1)]
    land("b", "2024-01-01 10:30:00", "2024-01-04 00:30:00", "2024-01-09 00:00:00")
    assert run("append") == [("2024-01-01 10:00:00", "Uncategorised", 2, 2),
                             ("2024-01-04 00:00:00", "Uncategorised", 2, 2)]
    assert run("update") == [("2024-01-01 10:00:00", "Uncategorised", 3, 3),
                             ("2024-01-04 00:00:00", "Uncategorised", 2, 2),
                             ("2024-01-09 00:00:00", "Uncategorised", 1, 1)]
    with pytest.raises(ValueError, match="complete"):
        run("complete")


def test_a_stream_never_takes_the_id_of_another_run(spark, landing, landed, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for state in ("a", "b"):
        store.store(Snapshot({"incident": landed("incident", {"sys_id": "1", "state": state})}, datetime(2024, 1, 10, 6)))
    store.settle("incident")
    landing("a", {"sys_id": "1", "state": "c"}, {"sys_id": "2", "state": "c"})
    for checkpoint in ("cp", "new"):
        tickets = stream_extract(spark, landing.path, DOMAINS["incident"])
        jobs.stream_sync(tickets, "incident", store, str(tmp_path / checkpoint),
                         clock=lambda: datetime(2024, 1, 10, 7)).awaitTermination()
    assert [r.id for r in store.run_log().orderBy("id").collect()] == [1, 2, 3, 4]
    assert sorted((r.sys_id, r.state, r.run_id) for r in store.current("incident").collect()) == [("1", "c", 4), ("2", "c", 4)]
    first = store.run_of_batch("s", 0, datetime(2024, 1, 1))
    assert store.run_of_batch("s", 0, datetime(2024, 1, 2)) == first == (5, datetime(2024, 1, 1))
    with pytest.raises(ValueError, match="settled"):
        store.store(Snapshot({"incident": landed("incident", {"sys_id": "1"})}, datetime(2024, 1, 10, 6)), run_id=2)


def test_streamed_trend_equals_the_batch(spark):
    from checks.registry import registered

    folder = "/root/testdata/sf0.001"
    streamed = registered()["stream_hourly_trend"](spark, folder)
    log = a.change_log(a.Tables(spark, folder).events).withColumn("pulled_at", F.col("ts"))
    batch = jobs.hourly_trend(log)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def keys_frame(spark, *rows):
    return spark.createDataFrame(list(rows), "filename string, received_at string")


def index_with_three_days(spark, tmp_path):
    from tickettide.streaming.key_index import KeyIndex

    index = KeyIndex(spark, str(tmp_path / "index"), bits=1 << 15)
    for batch, day in enumerate(("2023-01-01", "2024-03-04", "2024-03-05")):
        index.add(keys_frame(spark, *[(f"f{i}.xlsx", f"{day} 0{i}:00:00") for i in range(5)]), "s", batch)
    return index


def test_a_batch_of_one_day_reads_no_other_day(spark, tmp_path):
    from tickettide.streaming.key_index import day_of

    index = index_with_three_days(spark, tmp_path)

    def plan_of(*rows):
        keys = keys_frame(spark, *rows).withColumn("day", day_of(F.col("received_at")))
        fresh = index.fresh(keys, "s", 9)
        return [r.filename for r in fresh.collect()], fresh.inputFiles()

    names, files = plan_of(("f1.xlsx", "2024-03-05 01:00:00"), ("new.xlsx", "2024-03-05 01:00:00"))
    assert names == ["new.xlsx"] and files and all("day=2024-03-05" in f for f in files)
    # A late file that has come before is found, in its own day alone.
    names, files = plan_of(("f2.xlsx", "2023-01-01 02:00:00"))
    assert names == [] and files and all("day=2023-01-01" in f for f in files)
    # Where the filters know none of the keys, no key is read.
    assert plan_of(("other.xlsx", "2024-03-05 07:00:00"), ("old.xlsx", "2023-01-01 07:00:00"))[1] == []


def test_an_index_takes_odd_keys_and_batches_again(spark, tmp_path):
    index = index_with_three_days(spark, tmp_path)
    odd = keys_frame(spark, (None, None), (None, "2024-03-05"), ("f1.xlsx", None), ("f1.xlsx", "no date"), ("f1.xlsx", ""), ("f1.xlsx", ""))
    for batch in (3, 3, 4):
        index.add(odd, "s", batch)
    index.add(keys_frame(spark, *[(f"f{i}.xlsx", f"2024-03-05 0{i}:00:00") for i in range(5)]), "s", 2)
    got = [tuple(r) for r in index.keys().collect()]
    assert len(got) == len(set(got)) == 20


def partial_counts(spark, tmp_path):
    from tickettide.streaming.partials import PartialCounts

    schema = spark.createDataFrame([], "k string, n long").schema
    return PartialCounts(spark, str(tmp_path / "counts"), schema, ["k"])


def test_generations_add_up_and_leave_nothing_behind(spark, tmp_path):
    counts, want = partial_counts(spark, tmp_path), {}
    for batch in range(9):
        rows = [("a", batch), (f"k{batch % 3}", 1)]
        counts.write_batch(spark.createDataFrame(rows, "k string, n long"), "s", batch)
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        if batch % 2:
            counts.compact()
            assert counts.pending() == 0
        assert {r.k: r.n for r in counts.sums().collect()} == want
    parts = {p.name for p in (tmp_path / "counts" / "parts" / "stream=s").iterdir()}
    assert parts == {"batch=6", "batch=7", "batch=8"}
    assert {p.name for p in (tmp_path / "counts" / "totals").iterdir() if p.name.startswith("gen")} == {"generation=3", "generation=4"}
    plan = counts.sums()._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[2]
    files = counts.sums().inputFiles()
    assert plan.count("FileScan") == 2 and any("generation=4" in f for f in files) and not any("generation=3" in f for f in files)
    assert "batch" in filters.split("]")[0] and "> 7" in filters.split("]")[0]


def test_a_crash_before_the_switch_changes_nothing(spark, tmp_path):
    counts = partial_counts(spark, tmp_path)
    for stream in ("s", "t"):
        counts.write_batch(spark.createDataFrame([("a", 1)], "k string, n long"), stream, 0)
    counts.compact()
    counts.write_batch(spark.createDataFrame([("a", 5)], "k string, n long"), "s", 1)
    counts._merge(*counts.generation())
    assert counts.generation()[0] == 1 and [tuple(r) for r in counts.sums().collect()] == [("a", 7)]
    # A batch that was merged and is run again adds nothing; one that is not yet merged replaces itself.
    counts.write_batch(spark.createDataFrame([("a", 1)], "k string, n long"), "t", 0)
    counts.write_batch(spark.createDataFrame([("a", 6)], "k string, n long"), "s", 1)
    assert [tuple(r) for r in counts.sums().collect()] == [("a", 8)]
    counts.compact()
    assert counts.generation()[0] == 2 and [tuple(r) for r in counts.sums().collect()] == [("a", 8)]


def test_all_domains_become_one_run(spark, landed, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def run(now):
        sources = {n: stream_extract(spark, str(tmp_path / n / "*"), DOMAINS[n]) for n in DOMAINS}
        jobs.stream_sync_domains(sources, store, str(tmp_path / "cp"), clock=lambda: now).awaitTermination()
        return [(r.id, r.incident_count, r.request_item_count, r.change_request_count, r.problem_count) for r in store.run_log().orderBy("id").collect()]

    def land(part, **rows):
        for name in DOMAINS:
            landed(name, *rows.get(name, [])).coalesce(1).write.parquet(str(tmp_path / name / part))

    land("a", incident=[{"sys_id": "1", "state": "a"}, {"sys_id": "1", "state": "a"}], problem=[{"sys_id": "1", "known_error": "true"}])
    assert run(datetime(2024, 1, 10, 6)) == [(1, 2, 0, 0, 1)]
    assert run(datetime(2024, 1, 10, 7)) == [(1, 2, 0, 0, 1)]
    land("b", incident=[{"sys_id": "2"}], change_request=[{"sys_id": "9", "risk": "high"}], request_item=[{"sys_id": "3", "cat_item": "x"}])
    assert run(datetime(2024, 1, 10, 8)) == [(1, 2, 0, 0, 1), (2, 1, 1, 1, 0)]
    assert [(r.sys_id, r.risk, r.run_id) for r in store.current("change_request").collect()] == [("9", "high", 2)]
    assert [(r.sys_id, r.known_error, r.run_id) for r in store.current("problem").collect()] == [("1", "true", 1)]


@pytest.fixture
def business(spark, tmp_path):
    """A folder of the tables that tickets are made of: repeated lines, parts and orders, missing keys, no documents."""
    day = datetime(2024, 1, 3)
    tables = {
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(1, "Customer 1", 3, "AUTO")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, 1, "F", 1.0, day, "1-URGENT") for k in (1, 2, 2, 4)]),
        "part": ("p_partkey long, p_name string, p_type string", [(7, "anvil", "IRON"), (8, "bolt", "TIN"), (8, "bolt b", "TIN")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
                     [(k, p, s, n, 1.0, 2.0, "N", "F", at) for k, p, s, n, at in (
                         (1, 7, 1, 1, day), (1, 8, 1, 1, day), (1, 7, 2, 1, day), (2, 8, 3, 1, day), (2, None, 3, 2, None), (3, 7, 4, 1, day),
                         (1, 7, 5, None, day), (2, 8, 5, None, day), (4, 8, 7, None, day), (None, 7, 6, 1, day), (None, 8, 6, None, day))]),
        "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, props string", [(k, day, k, "error", "{}") for k in range(1, 5)]),
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", []),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "tables" / f"{name}.parquet"))
    return str(tmp_path / "tables")


def test_lines_joined_by_order_are_not_shuffled_again(spark, business):
    from checks.registry import request_items_now
    from tickettide.operators.upsert import last_write_wins

    tables = a.Tables(spark, business)
    items = a.request_item_tickets(tables)
    by_ticket = last_write_wins(items.rows, DOMAINS["request_item"], items.texts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = request_items_now(tables)
        plan = now._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sorted(map(tuple, now.collect()), key=str) == sorted(map(tuple, by_ticket.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Lines without a number are one ticket a day, whatever their order; only they are dealt out by ticket.
    union = next(i for i, line in enumerate(plan) if line.lstrip(" +-").startswith("Union"))
    depth = len(plan[union]) - len(plan[union].lstrip(" +-"))
    split = next(i for i in range(union + 1, len(plan)) if plan[i].startswith(" " * depth + "+- "))
    exchanges = [line for line in plan[union:split] if "Exchange " in line]
    assert len(exchanges) == 4 and not any("sys_id" in line for line in exchanges)
    assert [r.sys_id for r in now.orderBy("sys_id").collect()] == ["", "", "1-1", "2-1", "2-2", "3-1"]


def test_batches_of_all_domains_leave_no_copies(spark, business):
    from pathlib import Path

    from checks.registry import registered
    from tickettide.plans.workspace import shared_folder

    shared = Path(shared_folder(spark).removeprefix("file:"))
    known = set(shared.glob("tickettide/*"))
    log = registered()["stream_sync_domains"](spark, business)
    assert [(r.id, r.incident_count, r.request_item_count, r.change_request_count, r.problem_count) for r in log.orderBy("id").collect()] == [
        (1, 9, 3, 2, 0), (2, 3, 3, 2, 0)]
    (folder,) = set(shared.glob("tickettide/*")) - known
    assert folder.name.startswith("stream-domains-") and not (folder / "store" / "arrivals").exists()
    assert {f.relative_to(folder).parts[0] for f in folder.rglob("*.parquet")} == {"store"}


def test_little_disk_keeps_no_shuffle_files_and_restores_settings(spark, tmp_path):
    from tickettide.plans.workspace import little_disk

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f.getName() for f in (files.getAllFiles().apply(i) for i in range(files.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    rows = spark.range(1000).withColumn("part", F.col("id") % 3)
    settings = {s: spark.conf.get(s, None) for s in ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    before = names()
    with little_disk(spark):
        rows.groupBy("part").count().write.parquet(str(tmp_path / "counts"))
        rows.write.partitionBy("part").parquet(str(tmp_path / "parts"))
    assert names() <= before
    assert {s: spark.conf.get(s, None) for s in settings} == settings
    assert spark.read.parquet(str(tmp_path / "parts")).groupBy("part").count().count() == 3
