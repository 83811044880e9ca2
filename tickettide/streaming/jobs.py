"""Streaming jobs over landed files. Each returns its started query."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickettide.functions import tickets as t
from tickettide.functions.text import label_blank
from tickettide.functions.times import instant_of, utc_of
from tickettide.operators.pull import Snapshot
from tickettide.operators.upsert import repeating
from tickettide.plans.store import SnapshotStore
from tickettide.plans.workspace import little_disk
from tickettide.schema import DOMAINS
from tickettide.sources.landed import RAW
from tickettide.streaming.key_index import KeyIndex
from tickettide.streaming.partials import PartialCounts


def _run_available(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stream_name(checkpoint: str) -> str:
    """A stream is known by its checkpoint: a new one is another stream."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def stream_sync(
    tickets: DataFrame,
    domain: str,
    store: SnapshotStore,
    checkpoint: str,
    clock: Callable[[], datetime] | None = None,
    since_days: int | None = None,
) -> StreamingQuery:
    """Store each batch of newly landed tickets as one run.

    The store hands out the run and its time once per batch, above all runs it
    knows, and gives the same ones to a batch that is run again. A stream has
    no lookback of its own, so the log holds `since_days` as given.
    """
    now = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    stream = _stream_name(checkpoint)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        run, as_of = store.run_of_batch(stream, batch_id, now())
        store.store(Snapshot({domain: batch}, as_of, since_days), run)

    return _run_available(tickets.writeStream.foreachBatch(store_batch), checkpoint)


DOMAIN = "domain"


def tagged_union(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Tickets of several domains as one stream, each row with its domain; fields a domain lacks are NULL."""
    tagged = (
        rows.select(*DOMAINS[name].fields, *(c for c in (RAW,) if c in rows.columns), F.lit(name).alias(DOMAIN))
        for name, rows in sources.items()
    )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def stream_sync_domains(
    sources: Mapping[str, DataFrame],
    store: SnapshotStore,
    checkpoint: str,
    clock: Callable[[], datetime] | None = None,
    since_days: int | None = None,
) -> StreamingQuery:
    """Store what lands of all domains in a batch as one run with one log row.

    One query follows all sources, so a batch has one id and commits their
    files together. Sources give the same rows each time, as landed files do:
    a batch is no copy of them, but read once for the ids of all domains and
    once per domain to be stored. A domain of which nothing landed counts zero.
    """
    now = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    stream, names = _stream_name(checkpoint), list(sources)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        run, as_of = store.run_of_batch(stream, batch_id, now())
        kept = [RAW] if RAW in batch.columns else []
        frames = {name: batch.filter(F.col(DOMAIN) == name).select(*DOMAINS[name].fields, *kept) for name in names}
        with little_disk(batch.sparkSession):
            once = set(names) - repeating(batch, DOMAIN)
            store.store(Snapshot(frames, as_of, since_days), run, once=once)

    return _run_available(tagged_union(sources).writeStream.foreachBatch(store_batch), checkpoint)


def ingested_keys(spark: SparkSession, out: str) -> DataFrame:
    """The key of every file that came, once."""
    return KeyIndex(spark, out).keys()


def stream_ingest_once(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Add the key of each file that no earlier batch has brought to an index, however late it comes.

    See `KeyIndex`: a batch meets the keys of its own days only.
    """
    stream = _stream_name(checkpoint)

    def record(batch: DataFrame, batch_id: int) -> None:
        KeyIndex(batch.sparkSession, out).add(batch, stream, batch_id)

    return _run_available(files.writeStream.foreachBatch(record), checkpoint)


HOUR_KEYS = ["hour_start", "category", "state"]
PARTIAL_SCHEMA = T.StructType([
    T.StructField("hour_start", T.TimestampNTZType()),
    T.StructField("category", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("ticket_count", T.LongType()),
    T.StructField("open_count", T.LongType()),
    T.StructField("closed_count", T.LongType()),
])


def hourly_trend(tickets: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tickets per hour of `pulled_at`, category and state: all, open, closed."""
    still_open = t.is_open(F.col("closed_at")).cast("bigint")
    return (
        tickets.select(
            instant_of(F.col("pulled_at")).alias("pulled_at"),
            label_blank(F.col("category"), t.NO_CATEGORY).alias("category"),
            label_blank(F.col("state"), t.NO_VALUE).alias("state"),
            still_open.alias("open"),
        )
        .withWatermark("pulled_at", delay)
        .groupBy(F.window("pulled_at", "1 hour").alias("hour"), "category", "state")
        .agg(F.count(F.lit(1)).alias("ticket_count"), F.sum("open").alias("open_count"))
        .select(
            utc_of(F.col("hour.start")).alias("hour_start"),
            "category",
            "state",
            "ticket_count",
            "open_count",
            (F.col("ticket_count") - F.col("open_count")).alias("closed_count"),
        )
    )


def hourly_counts(spark: SparkSession, out: str) -> PartialCounts:
    """The counts that `stream_hourly_trend` in update mode keeps in a folder."""
    return PartialCounts(spark, out, PARTIAL_SCHEMA, HOUR_KEYS)


def hourly_totals(spark: SparkSession, out: str) -> DataFrame:
    """The trend that the batches of `stream_hourly_trend` in update mode add up to."""
    return hourly_counts(spark, out).sums()


def stream_hourly_trend(
    tickets: DataFrame, out: str, checkpoint: str, mode: str = "append", delay: str = "1 day", compact_every: int = 64
) -> StreamingQuery:
    """Write the hourly trend.

    In append mode an hour is written once the watermark has passed it, and
    rows that come later are dropped. In update mode every batch writes the
    counts of its own rows and nothing else: counts add up, so there is no
    state, no row is too late, and `hourly_totals` has the sums. Every so many
    batches, the counts so far are merged into one generation.
    """
    if mode == "append":
        trend = hourly_trend(tickets, delay)
        return _run_available(trend.writeStream.format("parquet").option("path", out), checkpoint)
    if mode != "update":
        raise ValueError(f"mode is append or update, not {mode!r}")
    stream = _stream_name(checkpoint)

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = hourly_counts(batch.sparkSession, out)
        counts.write_batch(hourly_trend(batch, delay), stream, batch_id)
        if (batch_id + 1) % compact_every == 0:
            counts.compact()

    return _run_available(tickets.writeStream.foreachBatch(add), checkpoint)
