"""The SQL face: temporary views under the names existing reports query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickettide.operators import trends
from tickettide.operators.upsert import latest_per_ticket
from tickettide.plans import reports
from tickettide.plans.store import SnapshotStore
from tickettide.schema import DOMAINS, RUN_LOG_TABLE


def view_frames(
    snapshots: Mapping[str, DataFrame],
    run_log: DataFrame,
    as_of=None,
    latest: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Every table and view by the name under which reports know it.

    ``latest`` may give each domain's latest rows where there is a shorter way
    to them than through the snapshots.
    """
    incident, request_item = snapshots["incident"], snapshots["request_item"]
    newest = latest or {
        name: latest_per_ticket(snapshots[name]) for name in ("incident", "request_item")
    }
    # View names.
    views = {
        "v_incident_latest": reports.incident_state(newest["incident"], as_of),
        "v_request_item_latest": reports.request_item_state(newest["request_item"], as_of),
        "v_incident_trends_daily": trends.incident_trends_daily(incident),
        "v_request_type_trends_daily": trends.request_type_trends_daily(request_item),
        "v_incident_sla_daily": trends.incident_sla_daily(incident),
        "v_change_request_trends_daily": trends.change_request_trends_daily(
            snapshots["change_request"]
        ),
        "v_problem_trends_daily": trends.problem_trends_daily(snapshots["problem"]),
        "v_snapshot_run_summary": run_log.orderBy(F.desc("id")),
    }
    tables = {DOMAINS[name].table: rows for name, rows in snapshots.items()}
    return tables | {RUN_LOG_TABLE: run_log} | views


def register_views(
    snapshots: Mapping[str, DataFrame],
    run_log: DataFrame,
    as_of=None,
    latest: Mapping[str, DataFrame] | None = None,
) -> list[str]:
    """Make tables and views available to ``spark.sql``; returns their names."""
    frames = view_frames(snapshots, run_log, as_of, latest)
    for name, rows in frames.items():
        rows.createOrReplaceTempView(name)
    return list(frames)


def register_store(store: SnapshotStore, as_of=None) -> list[str]:
    """The same for the current content of a store."""
    return register_views(
        {name: store.current(name) for name in DOMAINS},
        store.run_log(),
        as_of,
        {name: store.latest(name) for name in ("incident", "request_item")},
    )
