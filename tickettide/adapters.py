"""Generic business tables read as tickets, mails and logs.

The test tables hold no tickets, so these recipes give orders, line items,
events, documents and conversations the columns of the ticket domains. Each
keeps every row of its table. Blank, missing and repeated values are spread in
by remainder so that the rules about them are exercised.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickettide.functions.times import second_text
from tickettide.plans.store import with_payload
from tickettide.schema import DOMAINS, INGEST_LOG_SCHEMA, RUN_LOG_SCHEMA

SNAPSHOT_OFFSETS = (0, 1, 7)  # days after opening on which an order is seen


class Tables:
    """The Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream of files."""
        return (
            self.spark.readStream.schema(getattr(self, name).schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.folder)
        )


@dataclass
class Tickets:
    """Rows that tickets can be made of: stamp, id and update time as columns, the other fields as expressions.

    What these need is often much narrower than the texts they make.
    """

    name: str
    rows: DataFrame
    texts: dict[str, Column]

    def whole(self) -> DataFrame:
        """The tickets in a domain's stored columns."""
        domain = DOMAINS[self.name]
        return with_payload(self.rows.withColumns(self.texts), domain)

    def early(self, *fields: str) -> Tickets:
        """With some more fields as columns of the rows."""
        later = {name: text for name, text in self.texts.items() if name not in fields}
        return Tickets(self.name, self.rows.withColumns({f: self.texts[f] for f in fields}), later)


LEAD = ("run_id", "snapshot_date", "pulled_at", "sys_id", "sys_updated_on")


def _tickets(rows: DataFrame, name: str, **columns: str) -> Tickets:
    """A domain's fields by SQL expression; the rest is NULL."""
    fields = {
        f.name: F.expr(f"CAST({columns.get(f.name, 'NULL')} AS {f.dataType.simpleString()})")
        for f in DOMAINS[name].snapshot_schema
        if f.name != "raw_payload"
    }
    lead = {f: fields.pop(f) for f in LEAD}
    return Tickets(name, rows.withColumns(lead), fields)


def _snapshot(rows: DataFrame, name: str, **columns: str) -> DataFrame:
    """Rows in a domain's stored columns, by SQL expression; the rest is NULL."""
    return _tickets(rows, name, **columns).whole()


def _run_of(day: str, runs_per_day: int = 1, run: str = "0") -> str:
    return f"datediff({day}, DATE '1990-01-01') * {runs_per_day} + {run}"


def incidents(tables: Tables) -> DataFrame:
    """Orders seen on three days each; 45,000 rows at scale 0.01."""
    return incident_tickets(tables).whole()


def incident_tickets(tables: Tables) -> Tickets:
    """`incidents` before their texts are made."""
    seen = (
        tables.orders.join(
            tables.customer, F.col("o_custkey") == F.col("c_custkey"), "left"
        )
        .withColumn("h", F.expr("CAST((o_orderkey * 7919 + o_custkey) % 240 AS INT)"))
        .withColumn("k", F.explode(F.array(*map(F.lit, SNAPSHOT_OFFSETS))))
        .withColumn("day", F.date_add(F.col("o_orderdate").cast("date"), F.col("k")))
    )
    return _tickets(
        seen,
        "incident",
        run_id=_run_of("day"),
        snapshot_date="day",
        pulled_at="CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, 6)",
        sys_id="o_orderkey",
        number="concat('INC', lpad(o_orderkey, 10, '0'))",
        opened_at="CASE WHEN o_orderkey % 43 <> 0 THEN o_orderdate END",
        sys_created_on="CASE WHEN o_orderkey % 53 <> 0 THEN o_orderdate END",
        sys_updated_on="o_orderdate + make_dt_interval(k)",
        resolved_at="""CASE WHEN o_orderkey % 31 = 0 THEN ''
                            WHEN o_orderstatus = 'F' AND h DIV 2 <= 24 * k
                            THEN CAST(o_orderdate + make_dt_interval(0, h DIV 2) AS STRING) END""",
        closed_at="""CASE WHEN o_orderstatus <> 'O' AND h <= 24 * k
                          THEN CAST(o_orderdate + make_dt_interval(0, h) AS STRING)
                          WHEN o_orderkey % 7 = 0 THEN '' END""",
        state="CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderstatus END",
        priority="CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) END",
        severity="1 + o_orderkey % 3",
        impact="1 + o_custkey % 3",
        urgency="1 + (o_orderkey + o_custkey) % 3",
        category="""CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN ''
                         ELSE c_mktsegment END""",
        subcategory="o_orderpriority",
        assignment_group="concat('group ', c_nationkey)",
        assigned_to="concat('agent ', o_custkey % 100)",
        caller_id="c_name",
        short_description="concat(o_orderpriority, ' order of ', c_name)",
    )


def request_items(tables: Tables) -> DataFrame:
    """Line items in two runs a day; ids repeat within a run and across both."""
    return request_item_tickets(tables).whole()


def request_item_tickets(tables: Tables) -> Tickets:
    """`request_items` before their texts are made."""
    # Orders come last: their key is part of the id, so that lines lie by ticket then.
    lines = tables.lineitem.join(
        tables.part, F.col("l_partkey") == F.col("p_partkey"), "left"
    ).join(tables.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return _tickets(
        lines.withColumn("day", F.col("o_orderdate").cast("date")),
        "request_item",
        run_id=_run_of("day", 2, "l_suppkey % 2"),
        snapshot_date="day",
        pulled_at="CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(6 + 6 * (l_suppkey % 2) AS INT))",
        sys_id="concat(l_orderkey, '-', l_linenumber)",
        number="concat('RITM', lpad(l_partkey, 10, '0'))",
        request="l_orderkey",
        opened_at="l_shipdate",
        sys_created_on="o_orderdate",
        sys_updated_on="l_shipdate",
        closed_at="""CASE WHEN l_linestatus = 'F'
                          THEN CAST(l_shipdate + make_dt_interval(CAST(l_partkey % 30 AS INT)) AS STRING)
                     END""",
        state="CASE WHEN l_suppkey % 41 = 0 THEN '' ELSE l_returnflag END",
        priority="1 + l_partkey % 4",
        cat_item="""CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 37 = 0 THEN ''
                         ELSE p_type END""",
        short_description="concat(p_name, ' ', CAST(l_quantity AS BIGINT), ' ', "
        "CAST(round(l_extendedprice * 100) AS BIGINT))",
        assignment_group="concat('group ', l_suppkey % 10)",
        assigned_to="concat('agent ', l_suppkey)",
        requested_for="concat('customer ', o_custkey)",
    )


def change_requests(tables: Tables) -> DataFrame:
    """Events as changes, one snapshot each."""
    return _snapshot(
        tables.events.withColumn("day", F.col("ts").cast("date"))
        .withColumn("at", second_text(F.col("ts"))),
        "change_request",
        run_id=_run_of("day"),
        snapshot_date="day",
        pulled_at="CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, 6)",
        sys_id="event_id",
        number="concat('CHG', lpad(event_id, 10, '0'))",
        opened_at="at",
        sys_created_on="at",
        sys_updated_on="at",
        start_date="at",
        end_date="CAST(at AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(user_id % 48 AS INT))",
        state="""CASE event_id % 8 WHEN 0 THEN 'New' WHEN 1 THEN 'Scheduled' WHEN 2 THEN 'Closed'
                 WHEN 3 THEN 'COMPLETE' WHEN 4 THEN 'Cancelled' WHEN 5 THEN 'canceled'
                 WHEN 6 THEN '' END""",
        type="""CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ''
                     ELSE event_type END""",
        risk="1 + user_id % 4",
        priority="1 + event_id % 5",
        category="event_type",
        assignment_group="concat('group ', user_id % 10)",
        assigned_to="concat('agent ', user_id)",
        short_description="props",
    )


def problems(tables: Tables) -> DataFrame:
    """Documents as problems, over thirty days; the text is kept whole."""
    return _snapshot(
        tables.documents.withColumn(
            "day", F.expr("date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT))")
        ),
        "problem",
        run_id=_run_of("day"),
        snapshot_date="day",
        pulled_at="CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, 6)",
        sys_id="doc_id",
        number="concat('PRB', lpad(doc_id, 10, '0'))",
        opened_at="CAST(day AS TIMESTAMP_NTZ)",
        sys_created_on="CAST(day AS TIMESTAMP_NTZ)",
        sys_updated_on="CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(n_chars % 24 AS INT))",
        closed_at="""CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN ''
                          ELSE '2024-02-01 00:00:00' END""",
        state="lang",
        priority="1 + doc_id % 5",
        known_error="CASE WHEN doc_id % 4 = 0 THEN 'true' ELSE 'false' END",
        category="""CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ''
                         ELSE source END""",
        assignment_group="lang",
        assigned_to="concat('agent ', doc_id % 20)",
        short_description="text",
    )


def change_log(events: DataFrame) -> DataFrame:
    """Events as changes to tickets, one ticket per user; also usable on a stream."""
    at = second_text(F.col("ts"))
    columns = {
        "sys_id": "user_id",
        "number": "concat('EVT', lpad(event_id, 12, '0'))",
        "opened_at": "'2024-01-01 00:00:00'",
        "sys_updated_on": "at",
        "closed_at": """CASE WHEN event_type = 'purchase' THEN CAST(CAST(ts AS DATE) AS STRING)
                             WHEN event_type = 'error' THEN '' END""",
        "state": "event_type",
        "priority": "1 + event_id % 5",
        "category": "CASE WHEN event_id % 9 <> 0 THEN concat('group ', user_id % 7) END",
        "short_description": "props",
    }
    return events.withColumn("at", at).selectExpr(
        "ts",
        *(f"CAST({columns.get(f, 'NULL')} AS STRING) AS {f}" for f in DOMAINS["incident"].fields),
    )


def run_log(tables: Tables) -> DataFrame:
    """One run per day of events. Only the daily counts are numbered."""
    def of(*kinds: str) -> Column:
        return F.count_if(F.col("event_type").isin(*kinds))

    daily = tables.events.groupBy(F.col("ts").cast("date").alias("snapshot_date")).agg(
        of("error").alias("incident_count"),
        of("click").alias("request_item_count"),
        of("purchase").alias("change_request_count"),
        of("view").alias("problem_count"),
        F.count(F.lit(1)).alias("n"),
    )
    return daily.selectExpr(
        "CAST(row_number() OVER (ORDER BY snapshot_date) AS BIGINT) AS id",
        "snapshot_date",
        "CAST(snapshot_date AS TIMESTAMP_NTZ) + make_dt_interval(0, 6) AS pulled_at",
        "CAST(30 AS BIGINT) AS since_days",
        "incident_count",
        "request_item_count",
        "change_request_count",
        "problem_count",
        "'success' AS status",
        "concat('Pulled from ', n, ' events') AS notes",
    ).select(*RUN_LOG_SCHEMA.fieldNames())


def messages(conversations: DataFrame) -> DataFrame:
    """Conversation turns as mails with up to two attachments; also usable on a stream."""
    return conversations.selectExpr(
        "CASE conv_id % 3 WHEN 0 THEN 'Inbox' WHEN 1 THEN 'Reports' ELSE 'Archive' END AS folder",
        "text AS subject",
        "role AS sender",
        """CASE WHEN (conv_id + turn) % 19 <> 0 THEN TIMESTAMP_NTZ '2024-03-01 00:00:00'
             - make_dt_interval(0, CAST((conv_id * 37 + turn) % 1440 AS INT)) END AS received""",
        """CASE WHEN (conv_id + turn) % 23 = 0 THEN NULL ELSE filter(array(
             CASE conv_id % 5 WHEN 1 THEN 'report.xlsx' WHEN 2 THEN 'Old.XLS'
                              WHEN 3 THEN 'note.pdf' WHEN 4 THEN 'data.csv' END,
             CASE WHEN turn % 4 = 3 THEN concat('sheet ', conv_id, '.xlsx') END
           ), f -> f IS NOT NULL) END AS attachments""",
    )


def attachment_keys(conversations: DataFrame) -> DataFrame:
    """The files attached to mails, keyed by name and day of receipt, with repeats."""
    return (
        messages(conversations)
        .filter("received IS NOT NULL AND size(attachments) > 0")
        .selectExpr(
            "explode(attachments) AS filename",
            "CAST(CAST(received AS DATE) AS STRING) AS received_at",
            "received",
            "sender",
        )
    )


def incoming_files(tables: Tables) -> DataFrame:
    """Attached files as loads to record."""
    return attachment_keys(tables.conversations).selectExpr(
        "filename",
        "received_at",
        "sender AS target_table",
        "CAST(hour(received) AS BIGINT) AS rows_loaded",
    )


def ingest_log(tables: Tables) -> DataFrame:
    """A log of the files received on odd days of the month."""
    return (
        attachment_keys(tables.conversations)
        .filter("day(received) % 2 = 1")
        .groupBy("filename", "received_at")
        .agg(F.count(F.lit(1)).alias("rows_loaded"))
        .selectExpr(
            "filename", "received_at", "'loaded' AS target_table", "rows_loaded",
            "'2024-03-01 00:00:00' AS logged_at",
        )
        .select(*INGEST_LOG_SCHEMA.fieldNames())
    )
