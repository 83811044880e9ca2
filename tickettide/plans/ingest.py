"""Attached workbooks to a table: leave out logged files, decode, append, record.

Layout under a root folder::

    <table>/load=...       the rows of one load, of all its files
    ingest_log/load=...    the files of that load, written last

Rows count once their load is in the log, so a load that failed leaves nothing
to be seen and is simply run again. However many files a load has, it is one
folder; the column `FILE` tells their rows apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickettide.operators.ingest_log import new_log_rows, not_yet_ingested
from tickettide.operators.upsert import first_per_key
from tickettide.plans.workspace import new_folder, path_exists, remove
from tickettide.schema import INGEST_LOG_KEYS, INGEST_LOG_SCHEMA
from tickettide.sources.workbooks import ROW_SCHEMA, decode_workbooks, typed_rows

FILE = "file"


def ingest_log(spark: SparkSession, root: str) -> DataFrame:
    """The files recorded under a root so far."""
    path = f"{root}/ingest_log"
    if not path_exists(spark, path):
        return spark.createDataFrame([], INGEST_LOG_SCHEMA)
    return spark.read.schema(INGEST_LOG_SCHEMA).parquet(path).select(*INGEST_LOG_SCHEMA.fieldNames())


def ingest_workbooks(
    files: DataFrame,
    root: str,
    table: str,
    columns: Mapping[str, str],
    logged_at: Column | datetime | date | str | None = None,
) -> DataFrame:
    """Load new workbooks into a table under the root and return the files that can't be read.

    ``files`` has ``filename``, ``received_at`` and ``content``; `columns` maps
    clean headers to types. A file that the log knows by name and time of
    receipt is left out, and so are repeats: of different contents the one with
    the smallest digest stays. Workbooks are decoded once. Files that can't be
    read are neither loaded nor recorded: (filename, received_at, error).
    """
    spark, load = files.sparkSession, f"load-{uuid.uuid4().hex}"
    arrived = files.select(*INGEST_LOG_KEYS, "content", F.sha2("content", 256).alias("_digest"))
    fresh = first_per_key(
        not_yet_ingested(arrived, ingest_log(spark, root)), INGEST_LOG_KEYS, [F.asc("_digest")]
    ).drop("_digest")
    key = F.sha2(F.to_json(F.struct(*INGEST_LOG_KEYS)), 256)
    named = fresh.withColumn("path", key)
    decoded = new_folder(spark, "ingest-decoded")
    decode_workbooks(named, clean=True).write.parquet(decoded)
    rows = spark.read.schema(ROW_SCHEMA).parquet(decoded)
    typed_rows(rows, columns).withColumnRenamed("path", FILE).drop("row_number").write.parquet(f"{root}/{table}/load={load}")
    outcome = rows.groupBy("path").agg(
        F.count("row_number").alias("rows_loaded"), F.max("error").alias("error")
    )
    told = new_folder(spark, "ingest-outcome")
    named.drop("content").join(outcome, "path", "left").write.parquet(told)
    done = spark.read.parquet(told)
    loaded = done.filter(F.col("error").isNull()).select(
        *INGEST_LOG_KEYS, F.lit(table).alias("target_table"), F.coalesce("rows_loaded", F.lit(0)).alias("rows_loaded")
    )
    failed = done.filter(F.col("error").isNotNull()).select(*INGEST_LOG_KEYS, "error")
    new_log_rows(loaded, ingest_log(spark, root), logged_at).write.parquet(f"{root}/ingest_log/load={load}")
    remove(spark, decoded)
    return failed


def ingested_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of all loaded files; FILE tells them apart."""
    log = spark.read.schema("load string").parquet(f"{root}/ingest_log").distinct()
    return spark.read.parquet(f"{root}/{table}").join(log, "load", "left_semi").drop("load")
