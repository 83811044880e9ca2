"""Daily reports kept beside the settled rows they come from.

Layout under the store's root::

    reports/<report>/generation=.../snapshot_date=...   a report's rows of the dates of a generation
    reports_log/report=.../generation=...               the dates a report has been kept for

A row of a daily report depends on the snapshots of its date alone, so dates
that no newer run has touched are read as they were kept, and only the others
are computed. Dates that were settled without their report are computed too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.operators import trends
from tickettide.plans import reports
from tickettide.plans.store import SnapshotStore
from tickettide.plans.workspace import path_exists

#: Reports with a row or more per date, by name: the domain and the function of its snapshots.
DAILY: Mapping[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "incident_trends_daily": ("incident", trends.incident_trends_daily),
    "request_type_trends_daily": ("request_item", trends.request_type_trends_daily),
    "change_request_trends_daily": ("change_request", trends.change_request_trends_daily),
    "problem_trends_daily": ("problem", trends.problem_trends_daily),
    "incident_daily_totals": ("incident", reports.incident_daily_totals),
    "incident_open_backlog": ("incident", reports.incident_open_backlog),
    "state_mix_daily": ("incident", reports.state_mix_daily),
    "request_daily_totals": ("request_item", reports.request_daily_totals),
    "request_type_daily": ("request_item", reports.request_type_daily),
    "incident_sla_daily": ("incident", trends.incident_sla_daily),
    "sla_daily_totals": ("incident", reports.sla_daily_totals),
    "sla_by_priority": ("incident", reports.sla_by_priority),
    "change_daily_totals": ("change_request", reports.change_daily_totals),
    "problem_daily_totals": ("problem", reports.problem_daily_totals),
}

_LOG_SCHEMA = T.StructType([T.StructField("snapshot_date", T.DateType()), T.StructField("report", T.StringType()),
                            T.StructField("generation", T.LongType())])


class MaintainedReports:
    """Reads reports over a store, and keeps them when its dates are settled."""

    def __init__(self, store: SnapshotStore, daily: Mapping[str, tuple[str, Callable[[DataFrame], DataFrame]]] = DAILY):
        self.store, self.daily, self.spark = store, daily, store.spark

    def settle(self, name: str) -> None:
        """Settle a domain and keep its reports for the dates of all generations they lack."""
        self.store.settle(name)
        for report, (domain, _) in self.daily.items():
            if domain == name:
                self._keep(report)

    def _log(self, report: str) -> DataFrame:
        path = f"{self.store.root}/reports_log"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], _LOG_SCHEMA).drop("report")
        return self.spark.read.schema(_LOG_SCHEMA).parquet(path).filter(F.col("report") == report).drop("report")

    def _dates(self, report: str) -> tuple[DataFrame, DataFrame]:
        """Untouched settled dates with their generation: those the report is kept for, and those it isn't."""
        settled, kept = self.store.settled_dates(self.daily[report][0]), self._log(report)
        keys = ["snapshot_date", "generation"]
        return settled.join(kept, keys, "left_semi"), settled.join(kept, keys, "left_anti")

    def _keep(self, report: str) -> None:
        name, compute = self.daily[report]
        _, missing = self._dates(report)
        generation = missing.agg(F.max("generation")).first()[0]
        if generation is None:
            return
        # Each date goes to the generation that its rows are of.
        rows = compute(self.store.current_of_dates(name, missing)).join(missing, "snapshot_date")
        self.store._write(rows, f"reports/{report}", "generation", "snapshot_date")
        self.store._write(missing.withColumn("report", F.lit(report)), "reports_log", "report", "generation")

    def read(self, report: str) -> DataFrame:
        """The report over the whole store."""
        name, compute = self.daily[report]
        kept, missing = self._dates(report)
        fresh = compute(self.store.current_of_dates(name, missing))
        path = f"{self.store.root}/reports/{report}"
        if not path_exists(self.spark, path):
            return fresh
        schema = T.StructType([*fresh.schema.fields, T.StructField("generation", T.LongType())])
        held = self.spark.read.schema(schema).parquet(path).join(kept, ["snapshot_date", "generation"], "left_semi")
        return held.select(*fresh.columns).unionByName(fresh)
