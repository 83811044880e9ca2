"""The reporting queries: daily totals, backlogs, shares, top lists, run history.

All of them count straight from the snapshot rows. Going through the daily
trend first would give the same numbers with one more shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.functions import tickets as t
from tickettide.functions.text import label_blank
from tickettide.functions.times import age_days, as_time, parse_time
from tickettide.operators.trends import (
    incident_sla_daily,
    period_share,
    resolved_incidents,
)
from tickettide.operators.upsert import latest_per_ticket

TOP_LIST_ROWS = 15
RUN_HISTORY_ROWS = 200

# Columns of the two latest-state views.
INCIDENT_LATEST_COLUMNS = [
    "sys_id", "number", "state", "priority", "category", "subcategory", "assignment_group",
    "assigned_to", "opened_at", "sys_updated_on", "closed_at",
]
REQUEST_ITEM_LATEST_COLUMNS = [
    "sys_id", "number", "request", "state", "priority", "cat_item", "assignment_group",
    "assigned_to", "opened_at", "sys_updated_on", "closed_at",
]


def _state(latest: DataFrame, columns: list[str], as_of) -> DataFrame:
    opened = parse_time(t.started_text())
    return latest.select(
        *columns,
        F.col("snapshot_date").alias("last_snapshot_date"),
        F.col("pulled_at").alias("last_pulled_at"),
        age_days(opened, as_time(as_of)).alias("age_days"),
        t.open_flag(F.col("closed_at")).alias("is_open"),
    )


def incident_state(latest: DataFrame, as_of=None) -> DataFrame:
    """Latest incident rows with age and open flag."""
    return _state(latest, INCIDENT_LATEST_COLUMNS, as_of)


def request_item_state(latest: DataFrame, as_of=None) -> DataFrame:
    """Latest request item rows with age and open flag."""
    return _state(latest, REQUEST_ITEM_LATEST_COLUMNS, as_of)


def incident_latest(snapshots: DataFrame, as_of=None) -> DataFrame:
    """Each incident as last seen, with its age and whether it is open."""
    return incident_state(latest_per_ticket(snapshots), as_of)


def request_item_latest(snapshots: DataFrame, as_of=None) -> DataFrame:
    """Each request item as last seen, with its age and whether it is open."""
    return request_item_state(latest_per_ticket(snapshots), as_of)


def run_summary(run_log: DataFrame, limit: int = RUN_HISTORY_ROWS) -> DataFrame:
    """Run history, newest first."""
    return run_log.orderBy(F.desc("id")).limit(limit)


def _totals(
    snapshots: DataFrame, keys: list[str | Column], total: str | None, still_open: str | None,
    open_rule: Column,
) -> DataFrame:
    counts = []
    if total:
        counts.append(F.count(F.lit(1)).alias(total))
    if still_open:
        counts.append(F.sum(open_rule.cast("bigint")).alias(still_open))
    return snapshots.groupBy(*keys).agg(*counts)


def _open() -> Column:
    return t.is_open(F.col("closed_at"))


def incident_daily_totals(snapshots: DataFrame) -> DataFrame:
    return _totals(
        snapshots, ["snapshot_date"], "total_incidents", "open_incidents", _open()
    ).orderBy("snapshot_date")


def incident_open_backlog(snapshots: DataFrame) -> DataFrame:
    category = label_blank(F.col("category"), t.NO_CATEGORY).alias("category")
    return _totals(
        snapshots, ["snapshot_date", category], None, "open_incidents", _open()
    ).orderBy("snapshot_date", F.desc("open_incidents"), "category")


def state_mix_daily(snapshots: DataFrame) -> DataFrame:
    state = label_blank(F.col("state"), t.NO_VALUE).alias("state")
    return _totals(
        snapshots, ["snapshot_date", state], "ticket_count", None, _open()
    ).orderBy("snapshot_date", "state")


def request_daily_totals(snapshots: DataFrame) -> DataFrame:
    return _totals(
        snapshots, ["snapshot_date"], "total_requests", "open_requests", _open()
    ).orderBy("snapshot_date")


def request_type_daily(snapshots: DataFrame) -> DataFrame:
    kind = label_blank(F.col("cat_item"), t.NO_ITEM).alias("request_type")
    return _totals(
        snapshots, ["snapshot_date", kind], "total_requests", None, _open()
    ).orderBy("snapshot_date", "request_type")


def change_daily_totals(snapshots: DataFrame) -> DataFrame:
    return _totals(
        snapshots,
        ["snapshot_date"],
        "total_changes",
        "open_changes",
        ~t.is_terminal(F.col("state")),
    ).orderBy("snapshot_date")


def problem_daily_totals(snapshots: DataFrame) -> DataFrame:
    return _totals(
        snapshots, ["snapshot_date"], "total_problems", "open_problems", _open()
    ).orderBy("snapshot_date")


def sla_daily_totals(snapshots: DataFrame) -> DataFrame:
    late = t.breached(F.col("seconds"), t.sla_limit_hours(F.col("priority")))
    return (
        resolved_incidents(snapshots)
        .groupBy("snapshot_date")
        .agg(
            F.count(F.lit(1)).alias("resolved_count"),
            F.sum(late.cast("bigint")).alias("breached_count"),
        )
        .orderBy("snapshot_date")
    )


def sla_by_priority(snapshots: DataFrame) -> DataFrame:
    return (
        incident_sla_daily(snapshots)
        .select(
            "snapshot_date",
            "priority",
            F.col("resolved_count").alias("resolved"),
            F.col("breached_count").alias("breached"),
        )
        .orderBy("snapshot_date", "priority")
    )


def _top(snapshots: DataFrame, label: Column, name: str, count_name: str, limit: int) -> DataFrame:
    return (
        snapshots.groupBy(label.alias(name))
        .agg(F.count(F.lit(1)).alias(count_name))
        .orderBy(F.desc(count_name), name)
        .limit(limit)
    )


def top_categories(snapshots: DataFrame, limit: int = TOP_LIST_ROWS) -> DataFrame:
    """Categories by tickets across all snapshots; equal counts go by name."""
    return _top(
        snapshots, label_blank(F.col("category"), t.NO_CATEGORY), "category", "tickets", limit
    )


def top_request_types(snapshots: DataFrame, limit: int = TOP_LIST_ROWS) -> DataFrame:
    """Request types by requests across all snapshots; equal counts go by name."""
    return _top(
        snapshots, label_blank(F.col("cat_item"), t.NO_ITEM), "request_type", "requests", limit
    )


def request_share_weekly(snapshots: DataFrame) -> DataFrame:
    return period_share(snapshots, "week")


def request_share_monthly(snapshots: DataFrame) -> DataFrame:
    return period_share(snapshots, "month")
