"""Pulling tickets: table queries, capped fetches, lookback pulls, backfill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickettide.functions.times import as_time, parse_time, to_second
from tickettide.operators.selection import Level, first_rows, written
from tickettide.operators.upsert import first_per_key
from tickettide.schema import DEFAULT_LOOKBACK_DAYS, DOMAINS, Domain

UPDATED = "sys_updated_on"


def query_table(
    table: DataFrame,
    *,
    limit: int | None = None,
    filters: Mapping[str, object] | None = None,
    query: str | Column | None = None,
    order_by: str | Sequence[str] | None = None,
    fields: Sequence[str] | None = None,
    offset: int = 0,
) -> DataFrame:
    """Rows of a table: conditions, ascending order, offset, limit, projection.

    Without a limit all rows come.
    """
    conditions = [F.expr(query) if isinstance(query, str) else query] if query is not None else []
    conditions += [F.col(name) == value for name, value in (filters or {}).items()]
    rows = table.filter(reduce(Column.__and__, conditions)) if conditions else table
    if order_by:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        rows = rows.orderBy(*(F.col(k).asc_nulls_first() for k in keys))
    if offset > 0:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    return rows.select(*fields) if fields else rows


def page_info(page: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Row count of a page, where the next one starts and whether there may be one."""
    return page.agg(F.count(F.lit(1)).alias("count")).select(
        "count",
        (F.col("count") + F.lit(offset)).alias("next_offset"),
        (F.col("count") == limit).alias("has_more"),
    )


def oldest_updates(
    rows: DataFrame,
    max_records: int | None,
    *,
    newest_first: bool = False,
    tie_break: Sequence[str] = ("sys_id",),
    ordered: bool = True,
) -> DataFrame:
    """The first ``max_records`` rows by update time; all of them without a cap.

    The update time of the last one is counted out in a pass over that column
    and is a filter of the scan; see `first_rows` for rows that share it. So a
    cap of any size, and a bulk update that gives all rows one time, are cut by
    the tasks that read them. Sorting what is left is optional.
    """
    if max_records is None:
        return rows
    order = [Level(UPDATED, descending=newest_first), *map(Level, tie_break)]
    found = first_rows(rows, max_records, order)
    return found.orderBy(*(level.order() for level in order)) if ordered else found


def lookback_start(as_of: Column, since_days: int) -> Column:
    """The day so many days back (one at least), as text; its times all sort after it."""
    return F.date_sub(as_of.cast("date"), max(int(since_days), 1)).cast("string")


def pull_domain(
    tickets: DataFrame,
    domain: Domain,
    as_of: Column | datetime | date | str | None = None,
    since_days: int = DEFAULT_LOOKBACK_DAYS,
    max_records: int | None = None,
) -> DataFrame:
    """Tickets updated within the lookback, in the domain's columns; with a cap the oldest updates, in no order.

    A record that the source has kept (`raw_payload`) comes along.

    The lookback compares text with text: ISO times sort as they read, and the
    comparison can be pushed down to the files.
    """
    recent = tickets.filter(F.col(UPDATED) >= lookback_start(as_time(as_of), since_days))
    kept = [c for c in ("raw_payload",) if c in tickets.columns]
    return oldest_updates(recent.select(*domain.fields, *kept), max_records, ordered=False)


def stamp(rows: DataFrame, run_id: int | Column, as_of: Column | datetime | date | str | None) -> DataFrame:
    """Rows with the run, its date and its time to the second in front."""
    moment = as_time(as_of)
    run = run_id if isinstance(run_id, Column) else F.lit(run_id)
    return rows.select(
        run.cast("bigint").alias("run_id"),
        moment.cast("date").alias("snapshot_date"),
        to_second(moment).alias("pulled_at"),
        "*",
    )


@dataclass
class Snapshot:
    """The plan of one pull: a frame per domain and what the run log will say."""

    frames: dict[str, DataFrame]
    as_of: Column | datetime | date | str | None
    since_days: int | None = DEFAULT_LOOKBACK_DAYS
    notes: str | None = field(default=None)


def pull_snapshot(
    tables: Mapping[str, DataFrame],
    as_of: Column | datetime | date | str | None = None,
    since_days: int = DEFAULT_LOOKBACK_DAYS,
    *,
    max_records: Mapping[str, int | None] | None = None,
    include_change_requests: bool = False,
    include_problems: bool = False,
) -> Snapshot:
    """Pull every domain that is wanted from its landed table.

    Nothing is capped unless `max_records` says so; `CAPPED_PULL` has usual caps.
    """
    wanted = {"change_request": include_change_requests, "problem": include_problems}
    caps = dict.fromkeys(DOMAINS) | dict(max_records or {})
    frames = {
        name: pull_domain(tables[name], domain, as_of, since_days, caps[name])
        for name, domain in DOMAINS.items()
        if wanted.get(name, True)
    }
    return Snapshot(frames, as_of, max(int(since_days), 1))


def backfill(
    changes: DataFrame,
    domain: Domain,
    first_day: date | str,
    last_day: date | str,
    since_days: int = DEFAULT_LOOKBACK_DAYS,
    max_records: int | None = None,
) -> DataFrame:
    """What daily pulls over a range of days would have stored, from a change log.

    A pull sees each ticket's last change up to that day, if it lies within the
    lookback. Instead of joining days with changes, every ticket is first cut
    to one row per day on which it changed, each row learns when the next one
    replaces it, and only then is it repeated for the days it was current. The
    shuffles carry changes, not snapshots, and no ticket has more rows in one
    group than there are days. With a cap the changes so cut are written once,
    and the cut-off of every day is looked for before the result is planned.
    """
    lookback = max(int(since_days), 1)
    others = [f for f in domain.fields if f not in ("sys_id", UPDATED)]
    first, last = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    # Text bounds for the scan, a day wide on either side for times with an offset.
    near = F.col(UPDATED).between(
        F.date_sub(first, lookback + 1).cast("string"), F.date_add(last, 2).cast("string")
    )
    per_day = first_per_key(
        changes.filter(near)
        .select(*domain.fields)
        .withColumn("_day", parse_time(F.col(UPDATED)).cast("date"))
        .filter(F.col("_day") <= last),
        ["sys_id", "_day"],
        [F.col(c).desc_nulls_last() for c in (UPDATED, *others)],
    )
    following = F.lead("_day").over(Window.partitionBy("sys_id").orderBy("_day"))
    spans = (
        per_day.withColumn("_next", following)
        .withColumns({
            "_from": F.greatest("_day", first),
            "_until": F.least(F.date_add("_day", lookback), F.date_sub("_next", 1), last),
        })
        .filter("_from <= _until")
        .drop("_next")
    )
    if max_records is not None:
        spans = written(spans, "spans")
    seen = spans.withColumn("_date", F.explode(F.sequence("_from", "_until"))).drop("_from", "_until", "_day")
    if max_records is not None:
        seen = cap_per_day(seen, max_records, "_date")
    return stamp(
        seen,
        F.datediff("_date", first) + 1,
        F.col("_date").cast("timestamp_ntz") + F.make_dt_interval(*map(F.lit, (0, 23, 59, 59))),
    ).drop("_date")


def cap_per_day(rows: DataFrame, max_records: int, day: str = "snapshot_date") -> DataFrame:
    """The oldest updates of each day, up to a cap of any size.

    Per day the cut-off is looked for by date, then by time, then by ticket,
    and joined to the rows: a row per day, and no window over the day's rows.
    """
    dated = rows.withColumn("_updated_day", F.left(UPDATED, F.lit(10)))
    order = [Level("_updated_day"), Level(UPDATED), Level("sys_id")]
    return first_rows(dated, max_records, order, [day]).drop("_updated_day")
