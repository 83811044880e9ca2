"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.xlsx import encode_workbook
from tickettide import adapters as a
from tickettide.adapters import Tables
from tickettide.functions import text as tx
from tickettide.functions import tickets as t
from tickettide.functions import times as tm
from tickettide.operators import align, ingest_log, mail, profile, pull, trends, upsert
from tickettide.operators.selection import written
from tickettide.plans import ingest, reports
from tickettide.plans.loading import load_table, read_table
from tickettide.plans.maintained import DAILY, MaintainedReports
from tickettide.plans.store import SnapshotStore, run_log_rows
from tickettide.plans.sync import sync, sync_report
from tickettide.plans.workspace import little_disk, move, new_folder, path_exists, remove
from tickettide.schema import DOMAINS
from tickettide.sources.landed import records_from_replies, stream_extract
from tickettide.sources.workbooks import (
    column_types,
    decode_workbooks,
    read_workbooks,
    typed_rows,
)
from tickettide.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

ORDERS_AS_OF = datetime(2001, 8, 5, 9, 30)
EVENTS_AS_OF = datetime(2024, 1, 31, 9, 30)
RETRIED_AS_OF = datetime(2024, 2, 1, 9, 30)
MAIL_AS_OF = datetime(2024, 3, 1)
MAIL_SUBJECT = "The "
BACKFILL_DAYS = ("2024-01-01", "2024-01-30")
WORKBOOK_ROWS = 200
WORKBOOK_TYPES = {"cust_key": "bigint", "name": "string", "balance": "double", "segment": "string"}
PAGE_ROWS = 500

_QUERIES: dict[str, Query] = {}


def _query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def fields_of(rows: DataFrame) -> DataFrame:
    """A snapshot without its JSON copy, which has its own query."""
    return rows.drop("raw_payload")


def reviewed(rows: DataFrame, condition: str) -> DataFrame:
    """A snapshot and, for some tickets, a later run on the same day in another state."""
    again = rows.filter(condition).withColumns({
        "run_id": F.col("run_id") + 1_000_000,
        "pulled_at": F.col("pulled_at") + F.make_dt_interval(F.lit(0), F.lit(6)),
        "state": F.lit("Reviewed"),
    })
    return rows.unionByName(again)


def request_items_now(tables: Tables) -> DataFrame:
    items = a.request_item_tickets(tables)
    return upsert.last_write_wins(items.rows, DOMAINS["request_item"], items.texts, within=["l_orderkey"])


# --- pulling ---------------------------------------------------------------

PAGE = {
    "filters": {"type": "error"},
    "query": "priority >= '3'",
    "order_by": ["sys_updated_on", "sys_id"],
    "fields": ["sys_id", "number", "sys_updated_on", "priority", "type"],
    "limit": 100,
    "offset": 50,
}


@_query
def table_query(tables):
    return pull.query_table(a.change_requests(tables), **PAGE)


@_query
def table_query_page(tables):
    page = pull.query_table(a.change_requests(tables), **PAGE)
    return pull.page_info(page, PAGE["limit"], PAGE["offset"])


@_query
def capped_fetch(tables):
    return pull.oldest_updates(fields_of(a.incidents(tables)), 5000)


@_query
def capped_fetch_newest(tables):
    return pull.oldest_updates(fields_of(a.incidents(tables)), 5000, newest_first=True)


def _pull(rows: DataFrame, name: str, as_of: datetime) -> DataFrame:
    domain = DOMAINS[name]
    pulled = pull.pull_domain(rows, domain, as_of, 30)
    return pull.stamp(fields_of(pulled), 1, as_of)


@_query
def pull_incident(tables):
    return _pull(a.incidents(tables), "incident", ORDERS_AS_OF)


@_query
def pull_request_item(tables):
    return _pull(request_items_now(tables), "request_item", ORDERS_AS_OF)


@_query
def pull_change_request(tables):
    return _pull(a.change_requests(tables), "change_request", EVENTS_AS_OF)


@_query
def pull_problem(tables):
    return _pull(a.problems(tables), "problem", EVENTS_AS_OF)


@_query
def snapshot_backfill(tables):
    log = a.change_log(tables.events)
    return pull.backfill(log, DOMAINS["incident"], *BACKFILL_DAYS, since_days=7)


@_query
def snapshot_backfill_capped(tables):
    log = a.change_log(tables.events)
    return pull.backfill(
        log, DOMAINS["incident"], *BACKFILL_DAYS, since_days=7, max_records=100
    ).select("snapshot_date", "sys_id", "sys_updated_on", "state")


@_query
def snapshot_backfill_large_cap(tables):
    """Events dealt out to 7,000 tickets: more of them a day than the cap, itself beyond what a group limit takes."""
    log = a.change_log(tables.events).withColumn(
        "sys_id", F.expr("CAST(CAST(substr(number, 4) AS BIGINT) % 7000 AS STRING)"))
    return pull.backfill(
        log, DOMAINS["incident"], *BACKFILL_DAYS, since_days=7, max_records=1500
    ).select("snapshot_date", "sys_id", "sys_updated_on", "state")


@_query
def capped_fetch_bulk_update(tables):
    """All orders updated in one second, a quarter of them wanted: the cap falls among equal times."""
    rows = a.incidents(tables).drop("raw_payload").filter("snapshot_date = CAST(opened_at AS DATE)")
    return pull.oldest_updates(
        rows.withColumn("sys_updated_on", F.lit("2001-01-01 00:00:00")), 4000
    ).select("sys_id", "number", "sys_updated_on", "state")


@_query
def payload_explode(tables):
    """Events packed into reply pages of 500 records, then unpacked."""
    record = F.struct(
        F.col("event_id").cast("string").alias("sys_id"),
        F.format_string("INC%07d", "event_id").alias("number"),
        F.struct(
            F.upper("event_type").alias("display_value"), F.col("event_type").alias("value")
        ).alias("state"),
        F.when(F.col("user_id") % 5 != 0, F.col("props")).alias("short_description"),
    )
    pages = (
        tables.events.withColumn("page", F.floor(F.col("event_id") / PAGE_ROWS))
        .groupBy("page")
        .agg(F.to_json(F.struct(F.collect_list(record).alias("result"))).alias("reply"))
    )
    records = records_from_replies(pages, "reply", DOMAINS["incident"])
    return records.select("sys_id", "number", "state", "short_description", "category")


@_query
def received_records(tables):
    """Records of reply pages stored as they came: `extra` is no column of a ticket."""
    record = F.struct(
        F.col("event_id").cast("string").alias("sys_id"),
        F.lit("2024-01-31 00:00:00").alias("sys_updated_on"),
        F.struct(F.upper("event_type").alias("display_value"), F.col("event_type").alias("value")).alias("state"),
        F.col("user_id").alias("extra"),
    )
    pages = (
        tables.events.withColumn("page", F.floor(F.col("event_id") / PAGE_ROWS))
        .groupBy("page")
        .agg(F.to_json(F.struct(F.collect_list(record).alias("result"))).alias("reply"))
    )
    store = SnapshotStore(tables.spark, new_folder(tables.spark, "received"))
    landed = records_from_replies(pages, "reply", DOMAINS["incident"])
    sync(store, {"incident": landed, "request_item": landed.limit(0).select(F.lit("").alias("sys_updated_on"), *(
        F.lit(None).cast("string").alias(f) for f in DOMAINS["request_item"].fields if f != "sys_updated_on"))}, EVENTS_AS_OF)
    return store.current("incident").select("sys_id", "state", "raw_payload")


# --- storing ---------------------------------------------------------------


@_query
def upsert_incident(tables):
    tickets = a.incident_tickets(tables).early("state", "priority")
    rows = reviewed(tickets.rows, "priority IN ('1', '2')")
    return fields_of(upsert.last_write_wins(rows, DOMAINS["incident"], tickets.texts))


@_query
def upsert_request_item(tables):
    return fields_of(request_items_now(tables))


@_query
def upsert_change_request(tables):
    rows = reviewed(a.change_requests(tables), "risk = '2'")
    return fields_of(upsert.last_write_wins(rows, DOMAINS["change_request"]))


@_query
def upsert_problem(tables):
    rows = reviewed(a.problems(tables), "known_error = 'true'")
    return fields_of(upsert.last_write_wins(rows, DOMAINS["problem"]))


def all_domains(tables: Tables) -> dict[str, DataFrame]:
    return {
        "incident": a.incidents(tables),
        "request_item": a.request_items(tables),
        "change_request": a.change_requests(tables),
        "problem": a.problems(tables),
    }


def domains_now(tables: Tables) -> dict[str, DataFrame]:
    """The fields of all domains' tickets, each request item as it is now."""
    tickets = all_domains(tables) | {"request_item": request_items_now(tables)}
    return {name: rows.select(*DOMAINS[name].fields) for name, rows in tickets.items()}


def landed_domains(tables: Tables) -> dict[str, DataFrame]:
    """The same, with the request items landed as files."""
    tickets = domains_now(tables)
    return tickets | {"request_item": written(tickets["request_item"], "request-items")}


@_query
def run_log(tables):
    return run_log_rows(all_domains(tables), since_days=30)


@_query
def store_current(tables):
    """Two runs a day written to a store; the first is settled before the second comes."""
    store = SnapshotStore(tables.spark, new_folder(tables.spark, "store"))
    first = a.change_requests(tables)
    later = reviewed(first, "risk = '2'").filter("run_id > 1000000")
    store.write_runs({"change_request": first}, since_days=30)
    store.settle("change_request")
    store.write_runs({"change_request": later}, since_days=30)
    return fields_of(store.current("change_request"))


@_query
def maintained_change_trends(tables):
    """As `store_current`, but the trend is kept when the first runs are settled and read beside the newer ones."""
    store = SnapshotStore(tables.spark, new_folder(tables.spark, "store"))
    first = a.change_requests(tables)
    kept = MaintainedReports(store, {"change_request_trends_daily": DAILY["change_request_trends_daily"]})
    store.write_runs({"change_request": first}, since_days=30)
    kept.settle("change_request")
    later = reviewed(first, "risk = '2'").filter("run_id > 1000000 AND snapshot_date > '2024-01-20'")
    store.write_runs({"change_request": later}, since_days=30)
    return kept.read("change_request_trends_daily")


@_query
def store_latest(tables):
    """The newest row of each change, most of them settled, some seen again on the next day."""
    store = SnapshotStore(tables.spark, new_folder(tables.spark, "store"))
    first = a.change_requests(tables)
    store.write_runs({"change_request": first}, since_days=30)
    store.settle("change_request")
    later = reviewed(first, "risk = '2'").filter("run_id > 1000000").withColumn("snapshot_date", F.date_add("snapshot_date", 1))
    store.write_runs({"change_request": later}, since_days=30)
    return fields_of(store.latest("change_request"))


@_query
def store_retry(tables):
    """A run fails after its tickets are written; its retry on the next day leaves out one
    domain and some tickets, and nothing of the failed attempt is seen."""
    store = SnapshotStore(tables.spark, new_folder(tables.spark, "store"))
    changes, problems = a.change_requests(tables), a.problems(tables)
    tickets = {"change_request": changes.select(*DOMAINS["change_request"].fields),
               "problem": problems.select(*DOMAINS["problem"].fields)}
    failed = {name: pull.stamp(rows, 1, EVENTS_AS_OF) for name, rows in tickets.items()}
    store._write_tickets(failed, "failed")
    store.store(pull.Snapshot({"change_request": tickets["change_request"].filter("risk = '2'")}, RETRIED_AS_OF), run_id=1)
    seen = [store.current(name).select("run_id", "snapshot_date", "pulled_at", "sys_id", F.lit(name).alias("domain"))
            for name in ("change_request", "problem")]
    return seen[0].unionAll(seen[1])


@_query
def fail_if_exists(tables):
    """Suppliers loaded once; the second load is refused and the table stays as it was."""
    path = new_folder(tables.spark, "load")
    load_table(tables.supplier, path, "fail")
    try:
        load_table(tables.part, path, "fail")
    except FileExistsError:
        return read_table(tables.spark, path)
    raise AssertionError("the second load was not refused")


@_query
def sync_job(tables):
    """Pull, store and log one run over the tickets of all domains."""
    store = SnapshotStore(tables.spark, new_folder(tables.spark, "sync"))
    sources = landed_domains(tables)
    return sync(
        store,
        sources,
        EVENTS_AS_OF,
        since_days=11_000,
        include_change_requests=True,
        include_problems=True,
        stable=True,
    )


@_query
def sync_job_report(tables):
    return sync_report(sync_job(tables))


@_query
def append_aligned(tables):
    incoming = tables.customer.selectExpr(
        "c_mktsegment AS segment", "c_name AS s_name", "c_custkey AS s_suppkey"
    )
    target = tables.supplier
    return target.unionByName(align.align_to(incoming, target.schema))


@_query
def replace_load(tables):
    """Suppliers loaded twice, then replaced by parts."""
    path = new_folder(tables.spark, "load")
    load_table(tables.supplier, path)
    load_table(tables.supplier, path, "append")
    load_table(tables.part, path, "replace")
    return read_table(tables.spark, path)


@_query
def append_load(tables):
    """Suppliers loaded, then customers appended in their columns."""
    path = new_folder(tables.spark, "load")
    load_table(tables.supplier, path)
    load_table(
        tables.customer.selectExpr(
            "c_mktsegment AS segment", "c_name AS s_name", "c_custkey AS s_suppkey"
        ),
        path,
    )
    return read_table(tables.spark, path)


@_query
def already_ingested(tables):
    return ingest_log.already_ingested(a.incoming_files(tables), a.ingest_log(tables))


@_query
def not_yet_ingested(tables):
    return ingest_log.not_yet_ingested(a.incoming_files(tables), a.ingest_log(tables))


@_query
def record_ingest(tables):
    return ingest_log.record_ingest(a.incoming_files(tables), a.ingest_log(tables), MAIL_AS_OF)


@_query
def evolve_union(tables):
    log = a.run_log(tables)
    older = log.drop("change_request_count", "problem_count", "notes")
    return align.evolve_union(
        older, log, {"change_request_count": 0, "problem_count": 0}
    )


@_query
def raw_payload(tables):
    return a.problems(tables).select("sys_id", "snapshot_date", "raw_payload")


# --- column functions ------------------------------------------------------


@_query
def label_blanks(tables):
    return a.incidents(tables).select(
        "snapshot_date",
        "sys_id",
        tx.label_blank(F.col("category"), t.NO_CATEGORY).alias("category"),
        tx.label_blank(F.col("state"), t.NO_VALUE).alias("state"),
        tx.label_blank(F.col("priority"), t.NO_VALUE).alias("priority"),
    )


@_query
def open_flag(tables):
    return a.incidents(tables).select(
        "snapshot_date", "sys_id", t.open_flag(F.col("closed_at")).alias("is_open")
    )


@_query
def age_days(tables):
    opened = tm.parse_time(t.started_text())
    return a.incidents(tables).select(
        "snapshot_date", "sys_id", tm.age_days(opened, tm.as_time(ORDERS_AS_OF)).alias("age_days")
    )


@_query
def resolution_hours(tables):
    return a.incidents(tables).select(
        "snapshot_date",
        "sys_id",
        tm.hours(t.resolution_seconds()).alias("resolution_hours"),
        tm.hours(t.resolution_seconds(strict=True)).alias("strict_hours"),
    )


@_query
def sla_limit(tables):
    limit = t.sla_limit_hours(F.col("priority"))
    return a.incidents(tables).select(
        "snapshot_date",
        "sys_id",
        limit.alias("limit_hours"),
        t.breached(t.resolution_seconds(), limit).cast("int").alias("breached"),
    )


@_query
def terminal_state(tables):
    return a.change_requests(tables).select(
        "sys_id", "state", t.is_terminal(F.col("state")).cast("int").alias("is_terminal")
    )


@_query
def clean_columns(tables):
    return align.clean_columns(
        tables.part.toDF("  Part Key ", "Name", "Brand", "Part Type", "SIZE", "Retail Price $")
    )


def _file_names(tables: Tables) -> DataFrame:
    """Page addresses and made-up workbook names of parts."""
    parts = tables.part.selectExpr(
        "CAST(p_partkey AS BIGINT) AS id",
        """CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' (', p_brand, ').XLSX')
             WHEN 1 THEN concat('in\\\\', p_type, '.', p_size, '.xls')
             WHEN 2 THEN concat('.', p_name) ELSE concat('((', p_size, '))..csv') END AS filename""",
    )
    return parts.unionAll(tables.pages.selectExpr("-1 - page_id AS id", "url AS filename"))


@_query
def table_names(tables):
    return _file_names(tables).select("id", tx.table_name(F.col("filename")).alias("table_name"))


@_query
def file_ext(tables):
    return _file_names(tables).select("id", tx.file_extension(F.col("filename")).alias("extension"))


@_query
def lenient_date(tables):
    texts = tables.orders.selectExpr(
        "o_orderkey",
        """CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN CAST(year(o_orderdate) AS STRING)
             WHEN 3 THEN date_format(o_orderdate, 'MM/dd/yyyy')
             WHEN 4 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:20:30Z')
             WHEN 5 THEN CAST(o_orderdate AS STRING)
             WHEN 6 THEN '12:00' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text""",
    )
    moment = F.col("date_text")
    return texts.select(
        "o_orderkey",
        tm.parse_date(moment).alias("day"),
        tm.parse_time(moment).alias("moment"),
    )


@_query
def flatten_display(tables):
    field = F.expr(
        """CASE event_id % 4
             WHEN 0 THEN event_type
             WHEN 1 THEN to_json(named_struct('display_value', upper(event_type), 'value', event_type))
             WHEN 2 THEN to_json(named_struct('value', CAST(user_id AS STRING)))
             ELSE props END"""
    )
    values = tables.events.select("event_id", field.alias("state"), field.alias("display_state"))
    return values.select(
        "event_id",
        t.pick_value(F.col("state")).alias("state"),
        t.pick_value(F.col("display_state"), "display_value").alias("display_state"),
    )


# --- trends and reports ----------------------------------------------------


@_query
def incident_trends_daily(tables):
    return trends.incident_trends_daily(a.incidents(tables))


@_query
def incident_trends_merged(tables):
    return trends.incident_trends_daily(a.incidents(tables), merge_blank=True)


@_query
def request_type_trends_daily(tables):
    return trends.request_type_trends_daily(request_items_now(tables))


@_query
def change_request_trends_daily(tables):
    return trends.change_request_trends_daily(a.change_requests(tables))


@_query
def problem_trends_daily(tables):
    return trends.problem_trends_daily(a.problems(tables))


@_query
def incident_daily_totals(tables):
    return reports.incident_daily_totals(a.incidents(tables))


@_query
def incident_open_backlog(tables):
    return reports.incident_open_backlog(a.incidents(tables))


@_query
def state_mix_daily(tables):
    return reports.state_mix_daily(a.incidents(tables))


@_query
def request_daily_totals(tables):
    return reports.request_daily_totals(request_items_now(tables))


@_query
def request_type_daily(tables):
    return reports.request_type_daily(request_items_now(tables))


@_query
def change_daily_totals(tables):
    return reports.change_daily_totals(a.change_requests(tables))


@_query
def problem_daily_totals(tables):
    return reports.problem_daily_totals(a.problems(tables))


@_query
def incident_sla_daily(tables):
    return trends.incident_sla_daily(a.incidents(tables))


@_query
def incident_sla_strict(tables):
    return trends.incident_sla_daily(a.incidents(tables), strict=True)


@_query
def sla_by_table(tables):
    """Limits from a table: each order priority by its number."""
    limits = tables.orders.selectExpr("substr(o_orderpriority, 1, 1) AS priority").distinct()
    return trends.incident_sla_by_table(
        a.incidents(tables), limits.selectExpr("priority", "12 * CAST(priority AS INT) AS limit_hours")
    )


@_query
def sla_daily_totals(tables):
    return reports.sla_daily_totals(a.incidents(tables))


@_query
def sla_by_priority(tables):
    return reports.sla_by_priority(a.incidents(tables))


@_query
def request_share_weekly(tables):
    return reports.request_share_weekly(request_items_now(tables))


@_query
def request_share_monthly(tables):
    return reports.request_share_monthly(request_items_now(tables))


@_query
def incident_latest(tables):
    return reports.incident_latest(a.incidents(tables), ORDERS_AS_OF)


@_query
def request_item_latest(tables):
    latest = upsert.latest_write_per_ticket(a.request_items(tables), DOMAINS["request_item"])
    return reports.request_item_state(latest, ORDERS_AS_OF)


@_query
def top_categories(tables):
    return reports.top_categories(a.incidents(tables))


@_query
def top_request_types(tables):
    return reports.top_request_types(request_items_now(tables))


@_query
def run_summary(tables):
    return reports.run_summary(a.run_log(tables))


@_query
def object_profile(tables):
    names = (
        "region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations"
    ).split()
    return profile.object_profile({name: getattr(tables, name) for name in names})


@_query
def catalog_profile(tables):
    """Views and a saved table of the session, found in its catalog."""
    spark = tables.spark
    for name in ("region", "nation", "part"):
        getattr(tables, name).createOrReplaceTempView(f"listed_{name}")
    return profile.catalog_profile(spark, "listed_*")


@_query
def preview(tables):
    latest = reports.incident_latest(a.incidents(tables), ORDERS_AS_OF)
    return profile.preview(latest, order_by=("sys_id",))


# --- mails and files -------------------------------------------------------


def _staged(tables: Tables, folder: str = "") -> DataFrame:
    return mail.scan(a.messages(tables.conversations), folder, MAIL_AS_OF, 30, MAIL_SUBJECT)


@_query
def folder_messages(tables):
    mails = a.messages(tables.conversations)
    mail.require_folder(mails, "reports")
    return mail.folder_messages(mails, "reports").select("folder", "sender", "subject", "received")


@_query
def attachment_scan(tables):
    return mail.found_attachments(_staged(tables))


@_query
def scan_diagnostics(tables):
    return mail.scan_diagnostics(_staged(tables), "", MAIL_AS_OF, 30)


@_query
def scan_errors(tables):
    return mail.scan_errors(_staged(tables))


@_query
def folder_attachment_scan(tables):
    return mail.found_attachments(_staged(tables, "REPORTS"))


@_query
def folder_scan_diagnostics(tables):
    return mail.scan_diagnostics(_staged(tables, "REPORTS"), "REPORTS", MAIL_AS_OF, 30)


@_query
def folder_scan_errors(tables):
    return mail.scan_errors(_staged(tables, "REPORTS"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for books in batches:
        yield pd.DataFrame({
            "path": [f"customers-{n}.xlsx" for n in books["book"]],
            "content": [
                encode_workbook(["Cust Key", "Name", "Balance", "Segment"], rows)
                for rows in books["rows"]
            ],
        })


def _workbooks(tables: Tables) -> DataFrame:
    """Customers packed into workbooks of 200 rows: (path, content)."""
    return (
        tables.customer.groupBy(F.floor(F.col("c_custkey") / WORKBOOK_ROWS).alias("book"))
        .agg(
            F.collect_list(
                F.array(
                    F.col("c_custkey").cast("string"),
                    "c_name",
                    F.col("c_acctbal").cast("string"),
                    "c_mktsegment",
                )
            ).alias("rows")
        )
        .mapInPandas(_pack, "path string, content binary")
    )


def _workbook_rows(tables: Tables) -> DataFrame:
    """The workbooks of customers, read back."""
    return decode_workbooks(_workbooks(tables), clean=True)


@_query
def workbook_types(tables):
    return column_types(_workbook_rows(tables))


@_query
def workbook_load(tables):
    return typed_rows(
        _workbook_rows(tables),
        WORKBOOK_TYPES,
    ).drop("row_number")


def _save(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    for books in batches:
        for path, content in zip(books["path"], books["content"]):
            system, place = pyarrow.fs.FileSystem.from_uri(f"{folder}/{path}")
            system.create_dir(place.rpartition("/")[0], recursive=True)
            with system.open_output_stream(place) as file:
                file.write(content)
        yield books[["path"]]


@_query
def workbook_files(tables):
    """Workbooks written to the shared folder as files and read from there."""
    folder = new_folder(tables.spark, "workbooks")
    _workbooks(tables).mapInPandas(lambda batches: _save(batches, folder), "path string").write.format("noop").mode("overwrite").save()
    rows = typed_rows(read_workbooks(tables.spark, folder, clean=True), WORKBOOK_TYPES)
    return rows.drop("row_number").withColumn("path", tx.base_name(F.col("path")))


@_query
def ingest_chain(tables):
    """Mails' workbooks loaded twice: the second load brings the first one's files again,
    new ones, and one that is no workbook."""
    root = new_folder(tables.spark, "ingest")
    books = _workbooks(tables).select(
        F.col("path").alias("filename"), F.lit("2024-02-01 08:00:00").alias("received_at"), "content")
    number = F.regexp_extract("filename", r"(\d+)", 1).cast("int")
    first = books.filter(number % 2 == 0)
    ingest.ingest_workbooks(first.unionAll(first), root, "customers", WORKBOOK_TYPES, MAIL_AS_OF)
    broken = books.limit(1).select(F.lit("broken.xlsx").alias("filename"), "received_at", F.lit(b"no zip").alias("content"))
    failed = ingest.ingest_workbooks(books.unionAll(broken), root, "customers", WORKBOOK_TYPES, MAIL_AS_OF)
    rows = ingest.ingested_rows(tables.spark, root, "customers").select(
        F.lit("row").alias("kind"), F.col("cust_key").cast("string").alias("name"), F.lit(None).cast("bigint").alias("n"))
    log = ingest.ingest_log(tables.spark, root).select(F.lit("file"), "filename", "rows_loaded")
    return rows.unionAll(log).unionAll(failed.select(F.lit("failed"), "filename", F.lit(None).cast("bigint")))


# --- streams ---------------------------------------------------------------


def _landings(tables: Tables, name: str, late: str, start) -> str:
    """Run a stream over a table that lands in two parts; the second one restarts it.

    `late` says which rows land in the second part; `start` gets the stream, a
    folder and the checkpoint, and returns the started query.
    """
    rows, folder = getattr(tables, name), new_folder(tables.spark, f"stream-{name}")
    for part, chosen in (("first", f"NOT coalesce({late}, false)"), ("second", f"coalesce({late}, false)")):
        rows.filter(chosen).write.parquet(f"{folder}/landing/{part}")
        stream = tables.spark.readStream.schema(rows.schema).parquet(f"{folder}/landing/*")
        start(stream, folder, f"{folder}/checkpoint").awaitTermination()
    return folder


@_query
def stream_sync(tables):
    """Tickets with even ids land first and are settled; odd ones come as a second run."""
    stores = []

    def start(stream, folder, checkpoint):
        stores.append(SnapshotStore(tables.spark, f"{folder}/store"))
        stores[-1].settle("incident")
        changes = a.change_log(stream).drop("ts")
        return jobs.stream_sync(changes, "incident", stores[-1], checkpoint, clock=lambda: EVENTS_AS_OF)

    _landings(tables, "events", "user_id % 2 = 1", start)
    return fields_of(stores[-1].current("incident"))


@_query
def stream_ingest_once(tables):
    """The second landing repeats files of the first and brings older ones that are new."""
    folder = _landings(
        tables, "conversations", "turn % 2 = 1",
        lambda stream, folder, checkpoint: jobs.stream_ingest_once(a.attachment_keys(stream), f"{folder}/keys", checkpoint))
    return jobs.ingested_keys(tables.spark, f"{folder}/keys")


@_query
def stream_hourly_trend(tables):
    """The second landing has rows of every hour of the first."""
    folder = _landings(
        tables, "events", "event_id % 3 = 1",
        lambda stream, folder, checkpoint: jobs.stream_hourly_trend(
            a.change_log(stream).withColumn("pulled_at", F.col("ts")), f"{folder}/trend", checkpoint, mode="update"))
    return jobs.hourly_totals(tables.spark, f"{folder}/trend")


@_query
def stream_hourly_compacted(tables):
    """As `stream_hourly_trend`, each batch merged into a generation of its own."""
    folder = _landings(
        tables, "events", "event_id % 3 = 1",
        lambda stream, folder, checkpoint: jobs.stream_hourly_trend(
            a.change_log(stream).withColumn("pulled_at", F.col("ts")), f"{folder}/trend", checkpoint, mode="update", compact_every=1))
    return jobs.hourly_totals(tables.spark, f"{folder}/trend")


def _stream_all_domains(tables: Tables) -> SnapshotStore:
    """Tickets of all domains land in two parts, by ticket; each part is one batch and one run.

    Both parts are made in one go and lie outside of the landing folders until
    their time comes. What landed is removed once it is stored.
    """
    spark, folder = tables.spark, new_folder(tables.spark, "stream-domains")
    store = SnapshotStore(spark, f"{folder}/store")
    late = F.right("sys_id", F.lit(1)).isin(*"13579")
    part = F.when(late, "second").when(~late, "first")
    tickets = domains_now(tables)
    with little_disk(spark):
        for name, rows in tickets.items():
            to_land = rows.withColumn("part", part).filter("part IS NOT NULL")
            to_land.write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/coming/{name}")
    for part in ("first", "second"):
        sources = {}
        for name in tickets:
            coming = f"{folder}/coming/{name}/part={part}"
            if path_exists(spark, coming):
                move(spark, coming, f"{folder}/{name}/{part}")
            sources[name] = stream_extract(spark, f"{folder}/{name}/*", DOMAINS[name])
        jobs.stream_sync_domains(sources, store, f"{folder}/checkpoint", clock=lambda: EVENTS_AS_OF, since_days=30).awaitTermination()
        for name in tickets:
            remove(spark, f"{folder}/{name}/{part}")
    return store


@_query
def stream_sync_domains(tables):
    """The log of two batches over all four domains: a row each."""
    return _stream_all_domains(tables).run_log()


@_query
def stream_sync_domains_stored(tables):
    """What two batches over all four domains have stored."""
    store = _stream_all_domains(tables)
    stored = [store.current(name).groupBy("run_id", "snapshot_date", F.lit(name).alias("domain")).agg(
        F.count(F.lit(1)).alias("tickets"), F.max("sys_id").alias("last_ticket")) for name in DOMAINS]
    return functools.reduce(DataFrame.unionAll, stored)
