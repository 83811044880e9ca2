"""Choosing one row per key: last write wins, latest state."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickettide.schema import Domain

SNAPSHOT_KEY = ("snapshot_date", "sys_id")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Iterable[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Spark limits each key to one row before the shuffle as well as after it
    (WindowGroupLimit), so a key that fills a third of the table reaches its
    task as one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_place", F.row_number().over(window))
        .filter("_place = 1")
        .drop("_place")
    )


def write_order(domain: Domain) -> list[Column]:
    """Newest write first: run, then update time, then all other fields.

    The remaining fields only settle ties, and make the order total.
    """
    lead = ["run_id", "sys_updated_on"]
    rest = [f for f in domain.fields if f not in (*lead, "sys_id")]
    return [F.col(c).desc_nulls_last() for c in lead + rest]


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with an empty text for a missing ticket id, so that it can be a key."""
    return rows.withColumn("sys_id", F.coalesce("sys_id", F.lit("")))


def last_write_wins(
    rows: DataFrame, domain: Domain, texts: Mapping[str, Column] | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """One row per ticket and day out of any number of runs.

    Fields given as `texts` are not yet columns of the rows but made of them:
    then rows are sorted and shuffled as they are, and texts are made of those
    that run and update time leave over. Of rows that tie in these, which lie
    side by side, the greatest texts win, so nothing is sorted again.

    `within` names columns that all rows of a ticket share, as those that its
    id is made of. Rows that a join has dealt out by them stay where they are.
    Rows without an id are one ticket a day and need not share these columns,
    so they are taken apart.
    """
    if within:
        missing = F.coalesce("sys_id", F.lit("")) == ""
        known = _winners(rows.filter(~missing), domain, texts, [*within, *SNAPSHOT_KEY])
        return known.unionByName(_winners(rows.filter(missing), domain, texts, SNAPSHOT_KEY))
    return _winners(rows, domain, texts, SNAPSHOT_KEY)


def _winners(rows: DataFrame, domain: Domain, texts: Mapping[str, Column] | None, keys: Sequence[str]) -> DataFrame:
    if texts is None:
        return first_per_key(keyed(rows), keys, write_order(domain))
    newest = Window.partitionBy(*keys).orderBy(*write_order(domain)[:2])
    tied = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = list(dict.fromkeys(["run_id", "snapshot_date", "sys_id", "sys_updated_on", *keys]))
    rest = [f for f in domain.fields if f not in lead]
    return (
        keyed(rows).withColumn("_rank", F.rank().over(newest)).filter("_rank = 1")
        # NULL is less than any text, as in `write_order`.
        .select(*lead, F.struct(*(texts.get(f, F.col(f)).alias(f) for f in rest), "pulled_at").alias("_rest"))
        .select(*lead, F.max("_rest").over(tied).alias("_rest"), F.row_number().over(newest).alias("_place"))
        .filter("_place = 1")
        .select(*lead, "_rest.*")
        .select(*(c for c in domain.snapshot_columns if c != "raw_payload"))
    )


def once_per_ticket(rows: DataFrame) -> bool:
    """Whether no ticket id repeats. Only the ids are read and shuffled, counted in every task first."""
    return _repeated(rows, []).isEmpty()


def repeating(rows: DataFrame, group: str) -> set[str]:
    """The groups, a handful, in which a ticket id repeats; rows are read once for all of them."""
    return {row[group] for row in _repeated(rows, [group]).select(group).distinct().collect()}


def _repeated(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    return keyed(rows).groupBy(*group, "sys_id").count().filter("count > 1")


def latest_run_wins(rows: DataFrame) -> DataFrame:
    """As `last_write_wins`, where a run holds a ticket at most once.

    Ordering by the run alone lets the scan skip every column the caller does
    not ask for.
    """
    return first_per_key(rows, SNAPSHOT_KEY, [F.desc("run_id")])


def latest_write_per_ticket(rows: DataFrame, domain: Domain) -> DataFrame:
    """Each ticket's newest snapshot out of any number of runs.

    The same rows as `latest_per_ticket` of `last_write_wins`, with one shuffle
    instead of two: the winner of the newest date is the first row by date and
    then by write order.
    """
    return first_per_key(
        keyed(rows), ["sys_id"], [F.desc("snapshot_date"), *write_order(domain)]
    )


def latest_run_per_ticket(rows: DataFrame) -> DataFrame:
    """As `latest_write_per_ticket`, where a run holds a ticket at most once."""
    return first_per_key(rows, ["sys_id"], [F.desc("snapshot_date"), F.desc("run_id")])


def latest_per_ticket(rows: DataFrame) -> DataFrame:
    """The row of each ticket's newest snapshot."""
    return first_per_key(rows, ["sys_id"], [F.desc("snapshot_date"), F.desc("pulled_at")])
