"""Daily trends, SLA figures and regroupings of them.

Every aggregate is a count or a sum over fixed-width values, so Spark combines
rows in each task before the shuffle and a group of any size arrives as one
row per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickettide.functions import tickets as t
from tickettide.functions.text import label_blank
from tickettide.functions.times import rounded_ratio

def _count_rows() -> Column:
    return F.count(F.lit(1))


def _count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))


def daily_trend(
    snapshots: DataFrame,
    raw: Mapping[str, str],
    labelled: Mapping[str, Column],
    count_name: str,
    open_rule: Column,
    with_closed: bool = False,
) -> DataFrame:
    """Tickets per day and group: all, open and, if wanted, closed.

    ``raw`` columns are grouped as stored and labelled afterwards, so NULL and
    an empty text stay two rows with one label. ``labelled`` columns are
    grouped by their label.
    """
    grouped = snapshots.groupBy(
        "snapshot_date", *raw, *(label.alias(name) for name, label in labelled.items())
    ).agg(
        _count_rows().alias(count_name),
        _count_where(open_rule).alias("open_count"),
        *([_count_where(~open_rule).alias("closed_count")] if with_closed else []),
    )
    return grouped.withColumns({c: label_blank(F.col(c), label) for c, label in raw.items()})


def _trend(
    snapshots: DataFrame,
    labels: Mapping[str, tuple[str, str]],
    raw: tuple[str, ...],
    merge_blank: bool,
    **rest,
) -> DataFrame:
    """Split ``{output: (column, label)}`` into raw and labelled grouping columns."""
    by_column = {} if merge_blank else {
        out: label for out, (_, label) in labels.items() if out in raw
    }
    by_label = {
        out: label_blank(F.col(column), label)
        for out, (column, label) in labels.items()
        if out not in by_column
    }
    result = daily_trend(snapshots, by_column, by_label, **rest)
    counts = [c for c in result.columns if c not in ("snapshot_date", *labels)]
    return result.select("snapshot_date", *labels, *counts)


def incident_trends_daily(snapshots: DataFrame, merge_blank: bool = False) -> DataFrame:
    """Incidents per day, category and state."""
    return _trend(
        snapshots,
        {"category": ("category", t.NO_CATEGORY), "state": ("state", t.NO_VALUE)},
        ("category", "state"),
        merge_blank,
        count_name="ticket_count",
        open_rule=t.is_open(F.col("closed_at")),
        with_closed=True,
    )


def request_type_trends_daily(snapshots: DataFrame, merge_blank: bool = False) -> DataFrame:
    """Request items per day, request type and state."""
    return _trend(
        snapshots,
        {"request_type": ("cat_item", t.NO_ITEM), "state": ("state", t.NO_VALUE)},
        ("state",),
        merge_blank,
        count_name="request_count",
        open_rule=t.is_open(F.col("closed_at")),
        with_closed=True,
    )


def change_request_trends_daily(snapshots: DataFrame, merge_blank: bool = False) -> DataFrame:
    """Change requests per day, type and state; open means not in a terminal state."""
    return _trend(
        snapshots,
        {"change_type": ("type", t.NO_TYPE), "state": ("state", t.NO_VALUE)},
        ("state",),
        merge_blank,
        count_name="change_count",
        open_rule=~t.is_terminal(F.col("state")),
    )


def problem_trends_daily(snapshots: DataFrame, merge_blank: bool = False) -> DataFrame:
    """Problems per day, category and state."""
    return _trend(
        snapshots,
        {"category": ("category", t.NO_CATEGORY), "state": ("state", t.NO_VALUE)},
        ("category", "state"),
        merge_blank,
        count_name="problem_count",
        open_rule=t.is_open(F.col("closed_at")),
    )


def resolved_incidents(snapshots: DataFrame, strict: bool = False) -> DataFrame:
    """Incidents that have both times, with seconds taken and priority label."""
    return snapshots.filter(
        t.started_text().isNotNull() & t.finished_text(strict).isNotNull()
    ).select(
        "snapshot_date",
        label_blank(F.col("priority"), t.NO_VALUE).alias("priority"),
        t.resolution_seconds(strict).alias("seconds"),
    )


def incident_sla_daily(
    snapshots: DataFrame,
    strict: bool = False,
    limits: Mapping[str, int] = t.SLA_LIMIT_HOURS,
    default: int = t.SLA_DEFAULT_HOURS,
) -> DataFrame:
    """Resolved incidents, mean hours and SLA breaches per day and priority."""
    timed = resolved_incidents(snapshots, strict)
    late = t.breached(F.col("seconds"), t.sla_limit_hours(F.col("priority"), limits, default))
    return _sla_figures(timed, late)


def incident_sla_by_table(
    snapshots: DataFrame, limits: DataFrame, default: int = t.SLA_DEFAULT_HOURS
) -> DataFrame:
    """As `incident_sla_daily`, with limits from a table (priority, limit_hours).

    A priority listed twice with different limits is an error when the plan
    runs; rows that agree count once. Incidents are first counted per day,
    priority and whole seconds taken, in every task before the shuffle, so the
    few priorities never have all rows dealt out by them; what then meets the
    limits has a row per day and duration, and salts spread it.
    """
    salts = int(snapshots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = limits.groupBy("priority").agg(F.min("limit_hours").alias("limit_hours"), F.max("limit_hours").alias("_most"))
    # An error may not be optimised away, so the limit itself depends on it.
    agreed = F.when(F.col("limit_hours").eqNullSafe(F.col("_most")), F.col("limit_hours")).otherwise(
        F.raise_error(F.concat(F.lit("two limits for priority "), F.coalesce("priority", F.lit("NULL")))).cast("double"))
    salted = one.select("priority", agreed.alias("limit_hours")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    counts = (
        resolved_incidents(snapshots)
        .groupBy("snapshot_date", "priority", "seconds")
        .agg(_count_rows().alias("n"))
        .withColumn("_salt", F.pmod(F.xxhash64("snapshot_date", "seconds"), F.lit(salts)).cast("int"))
    )
    timed = counts.join(salted, ["priority", "_salt"], "left")
    late = t.breached(F.col("seconds"), F.coalesce("limit_hours", F.lit(default)))
    return _sla_figures(timed, late, F.col("n"))


def _sla_figures(timed: DataFrame, late: Column, times: Column | None = None) -> DataFrame:
    """Figures per day and priority; `times` is how many incidents a row stands for."""
    n = F.lit(1).cast("bigint") if times is None else times
    nothing = F.lit(0).cast("bigint")
    return (
        timed.groupBy("snapshot_date", "priority")
        .agg(
            F.sum(n).alias("resolved_count"),
            F.sum(F.col("seconds") * n).alias("_sum"),
            F.sum(F.when(F.col("seconds").isNotNull(), n).otherwise(nothing)).alias("_timed"),
            F.sum(F.when(late, n).otherwise(nothing)).alias("breached_count"),
        )
        .select(
            "snapshot_date",
            "priority",
            "resolved_count",
            rounded_ratio(F.col("_sum"), F.col("_timed") * 3600, 2).alias("avg_resolution_hours"),
            "breached_count",
        )
    )


def period_share(
    snapshots: DataFrame, period: str, merge_column: str = "cat_item", label: str = t.NO_ITEM
) -> DataFrame:
    """Share of each request type in its week or month, to four decimals.

    The window runs over rows already aggregated: one per period and type.
    """
    start = F.trunc("snapshot_date", period).alias("period_start")
    counts = snapshots.groupBy(
        start, label_blank(F.col(merge_column), label).alias("request_type")
    ).agg(_count_rows().alias("request_count"))
    total = F.sum("request_count").over(Window.partitionBy("period_start"))
    return counts.withColumn("period_total", total).withColumn(
        "share", rounded_ratio(F.col("request_count"), F.col("period_total"), 4)
    )
