"""Ingest-once bookkeeping on (filename, received_at).

The log holds each key once, so it is joined as it is. A small log is
broadcast by Spark after its size check; else both sides are shuffled, and a
file that fills a third of the incoming rows is split by AQE's skew join.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.functions.times import as_time, second_text
from tickettide.operators.upsert import first_per_key
from tickettide.schema import INGEST_LOG_KEYS, INGEST_LOG_SCHEMA


def already_ingested(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Incoming rows whose file was loaded before."""
    return incoming.join(log.select(*INGEST_LOG_KEYS), INGEST_LOG_KEYS, "left_semi")


def not_yet_ingested(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Incoming rows whose file is new."""
    return incoming.join(log.select(*INGEST_LOG_KEYS), INGEST_LOG_KEYS, "left_anti")


def new_log_rows(
    incoming: DataFrame,
    log: DataFrame,
    logged_at: Column | datetime | date | str | None = None,
) -> DataFrame:
    """Log rows to append: one per new file, the first of its repeats.

    "First" is by target table and row count, so that it does not depend on
    the order in which rows are read.
    """
    firsts = first_per_key(
        incoming.select(*INGEST_LOG_KEYS, "target_table", F.col("rows_loaded").cast("bigint")),
        INGEST_LOG_KEYS,
        [F.asc("target_table"), F.asc("rows_loaded")],
    )
    return (
        not_yet_ingested(firsts, log)
        .withColumn("logged_at", second_text(as_time(logged_at)))
        .select(*INGEST_LOG_SCHEMA.fieldNames())
    )


def record_ingest(
    incoming: DataFrame,
    log: DataFrame,
    logged_at: Column | datetime | date | str | None = None,
) -> DataFrame:
    """The log after recording: rows written earlier stay as they are."""
    return log.select(*INGEST_LOG_SCHEMA.fieldNames()).unionByName(
        new_log_rows(incoming, log, logged_at)
    )
