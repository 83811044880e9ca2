"""Ticket domains and the schemas of the stored tables.

Ticket fields stay text, as the ticket system sends them: an empty string and
NULL both mean "no value" but behave differently in ``coalesce``, so the
snapshot keeps them apart and typed values are derived when a view is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Ticket fields, in stored column order.
INCIDENT_FIELDS = [
    "sys_id", "number", "opened_at", "sys_created_on", "sys_updated_on", "resolved_at",
    "closed_at", "state", "priority", "severity", "impact", "urgency", "category",
    "subcategory", "assignment_group", "assigned_to", "caller_id", "short_description",
]
REQUEST_ITEM_FIELDS = [
    "sys_id", "number", "request", "opened_at", "sys_created_on", "sys_updated_on", "closed_at",
    "state", "priority", "cat_item", "short_description", "assignment_group", "assigned_to",
    "requested_for",
]
CHANGE_REQUEST_FIELDS = [
    "sys_id", "number", "opened_at", "sys_created_on", "sys_updated_on", "start_date",
    "end_date", "state", "type", "risk", "priority", "category", "assignment_group",
    "assigned_to", "short_description",
]
PROBLEM_FIELDS = [
    "sys_id", "number", "opened_at", "sys_created_on", "sys_updated_on", "closed_at", "state",
    "priority", "known_error", "category", "assignment_group", "assigned_to",
    "short_description",
]


@dataclass(frozen=True)
class Domain:
    """One kind of ticket: its fields and how it is pulled."""

    name: str
    fields: tuple[str, ...]
    table: str        # name under which the snapshot is queried in SQL
    label: str        # plural used in the run message
    optional: bool    # pulled only on request

    @property
    def ticket_schema(self) -> T.StructType:
        """Schema of a landed ticket record."""
        return T.StructType([T.StructField(f, T.StringType()) for f in self.fields])

    @property
    def snapshot_schema(self) -> T.StructType:
        """Schema of the stored snapshot."""
        return T.StructType(
            STAMP_FIELDS
            + self.ticket_schema.fields
            + [T.StructField("raw_payload", T.StringType())]
        )

    @property
    def snapshot_columns(self) -> list[str]:
        return self.snapshot_schema.fieldNames()


# pulled_at is UTC wall-clock time without a zone, so that results do not
# depend on the session's time zone.
STAMP_FIELDS = [
    T.StructField("run_id", T.LongType()),
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("pulled_at", T.TimestampNTZType()),
]

# Table names and plural labels.
DOMAINS = {
    d.name: d
    for d in (
        Domain("incident", tuple(INCIDENT_FIELDS), "sn_incident_snapshot",
               "incidents", False),
        Domain("request_item", tuple(REQUEST_ITEM_FIELDS), "sn_request_item_snapshot",
               "request items", False),
        Domain("change_request", tuple(CHANGE_REQUEST_FIELDS), "sn_change_request_snapshot",
               "change requests", True),
        Domain("problem", tuple(PROBLEM_FIELDS), "sn_problem_snapshot",
               "problems", True),
    )
}
# Caps for callers who want pulls of a bounded size.
CAPPED_PULL = {"incident": 5000, "request_item": 5000, "change_request": 3000, "problem": 3000}
DEFAULT_LOOKBACK_DAYS = 30

RUN_LOG_TABLE = "sn_sync_runs"
RUN_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("pulled_at", T.TimestampNTZType()),
    T.StructField("since_days", T.LongType()),
    T.StructField("incident_count", T.LongType()),
    T.StructField("request_item_count", T.LongType()),
    T.StructField("change_request_count", T.LongType()),
    T.StructField("problem_count", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("notes", T.StringType()),
])

INGEST_LOG_KEYS = ["filename", "received_at"]
INGEST_LOG_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("received_at", T.StringType()),
    T.StructField("target_table", T.StringType()),
    T.StructField("rows_loaded", T.LongType()),
    T.StructField("logged_at", T.StringType()),
])
