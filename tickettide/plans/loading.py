"""Bulk loading into Parquet tables: append with alignment, replace, or only if new.

A table is a folder of loads, ``load=<n>``, and a log of those that finished,
``_loads``. A load counts once it is in the log, and a replacing load makes the
earlier ones invisible in the same moment: readers see the old table or the new
one, and a load that fails changes nothing. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.operators.align import align_to
from tickettide.plans.workspace import path_exists

# What to do when the table exists.
IF_EXISTS = ("append", "replace", "fail")

_LOADS_SCHEMA = T.StructType([
    T.StructField("load", T.LongType()),
    T.StructField("replaces", T.BooleanType()),
])


def _loads(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Finished loads since the last replacing one: one small row per load."""
    if not path_exists(spark, f"{path}/_loads"):
        return []
    log = spark.read.schema(_LOADS_SCHEMA).parquet(f"{path}/_loads")
    last = F.coalesce(log.agg(F.max(F.when(F.col("replaces"), F.col("load")))).scalar(), F.lit(0))
    return sorted((r.load, r.replaces) for r in log.filter(F.col("load") >= last).collect())


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table, None where there is none yet."""
    folders = [f"{path}/load={load}" for load, _ in _loads(spark, path)]
    return spark.read.parquet(*folders) if folders else None


def load_table(rows: DataFrame, path: str, if_exists: str = "append") -> int:
    """Write rows to a table and return how many were written.

    Appended rows take the table's columns: missing ones become NULL, others
    are left out. ``fail`` raises a `FileExistsError` where there is a table.
    The count is taken while writing, in the last stage, where each partition
    is counted once even if a task has to run again.
    """
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists is one of {', '.join(IF_EXISTS)}, not {if_exists!r}")
    spark = rows.sparkSession
    loads = _loads(spark, path)
    if loads and if_exists == "fail":
        raise FileExistsError(f"there is a table at {path}")
    if loads and if_exists == "append":
        rows = align_to(rows, read_table(spark, path).schema)
    load = max((n for n, _ in loads), default=0) + 1
    written = Observation()
    rows.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/load={load}")
    entry = spark.createDataFrame([(load, if_exists == "replace")], _LOADS_SCHEMA)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/_loads")
    return written.get["n"]
