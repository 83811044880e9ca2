"""The daily job: pull what is landed, store it as one run, report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickettide.operators.pull import pull_snapshot
from tickettide.plans.store import SnapshotStore
from tickettide.schema import DEFAULT_LOOKBACK_DAYS


def sync(
    store: SnapshotStore,
    tables: Mapping[str, DataFrame],
    as_of=None,
    since_days: int = DEFAULT_LOOKBACK_DAYS,
    run_id: int | None = None,
    stable: bool = False,
    **pull_options: object,
) -> DataFrame:
    """Run the job once and return the run's log row. `stable` tables are as in `SnapshotStore.store`."""
    return store.store(pull_snapshot(tables, as_of, since_days, **pull_options), run_id, stable)


def sync_report(run: DataFrame) -> DataFrame:
    """One line of text per run. Its wording is a fixed value."""
    return run.select(
        F.format_string(
            "Sync succeeded: snapshot_date=%s incidents=%s requests=%s changes=%s problems=%s",
            F.col("snapshot_date").cast("string"),
            "incident_count",
            "request_item_count",
            "change_request_count",
            "problem_count",
        ).alias("report")
    )
