"""Keys that have come before: an index by day of receipt, with a Bloom filter per day.

Layout under the root folder::

    filters/day=.../stream=.../batch=...   bitmaps of the keys a batch brought for that day
    keys/day=.../stream=.../batch=...      the keys that no other batch had brought
    arrivals/stream=.../batch=...          the distinct keys of the batch at work

A batch looks only into the days its own keys are of: their folders are named,
so older ones are neither read nor listed. There it asks the filters first, and
reads the keys of a day only where one of its own may be known. Filters hold
all of a batch's keys and are written first: a key without its filter does not
exist. A batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.functions.times import parse_date
from tickettide.plans.workspace import path_exists
from tickettide.schema import INGEST_LOG_KEYS, INGEST_LOG_SCHEMA

#: Bits of a day's filter and hashes per key: one false hit in ten thousand for a million keys a day.
FILTER_BITS, HASHES = 1 << 26, 3
#: Where keys go whose time of receipt is not a date.
NO_DAY = "none"

KEYS_SCHEMA = T.StructType([f for f in INGEST_LOG_SCHEMA.fields if f.name in INGEST_LOG_KEYS])
_WRITTEN_BY = [T.StructField("day", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
_FILTER_SCHEMA = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("bitmap", T.BinaryType()), *_WRITTEN_BY])


def day_of(received_at: Column) -> Column:
    return F.coalesce(parse_date(received_at).cast("string"), F.lit(NO_DAY))


class KeyIndex:
    """The index under one folder. One batch at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, bits: int = FILTER_BITS):
        self.spark, self.root, self.bits = spark, root.rstrip("/"), bits

    def keys(self) -> DataFrame:
        """Every key, once."""
        if not path_exists(self.spark, f"{self.root}/keys"):
            return self.spark.createDataFrame([], KEYS_SCHEMA)
        return self.spark.read.schema(KEYS_SCHEMA).parquet(f"{self.root}/keys").select(*INGEST_LOG_KEYS)

    def _days(self, table: str, days: Iterable[str], schema: T.StructType) -> DataFrame:
        """A table's rows of some days, by the folders of these days alone."""
        folders = [f"{self.root}/{table}/day={day}" for day in days]
        there = [folder for folder in folders if path_exists(self.spark, folder)]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*there)

    def _probes(self, keys: DataFrame) -> DataFrame:
        """A row per key and hash: the bitmap's bucket and the place in it."""
        place = F.pmod(F.xxhash64("hash", *INGEST_LOG_KEYS), F.lit(self.bits)) + 1
        return keys.withColumn("hash", F.explode(F.sequence(F.lit(1), F.lit(HASHES)))).withColumns({
            "bucket": F.bitmap_bucket_number(place), "place": F.bitmap_bit_position(place)})

    def _maybe_known(self, keys: DataFrame, days: list[str], stream: str, batch: int) -> DataFrame:
        """The keys of which all bits are set in their day's filters."""
        others = (F.col("stream") != stream) | (F.col("batch") != batch)
        filters = self._days("filters", days, _FILTER_SCHEMA).where(others).groupBy("day", "bucket").agg(
            F.bitmap_or_agg("bitmap").alias("bitmap"))
        byte = F.conv(F.hex(F.substring("bitmap", F.expr("CAST(place DIV 8 + 1 AS INT)"), F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, F.col("place") % 8)
        return self._probes(keys).join(filters, ["day", "bucket"]).where(is_set == 1).groupBy("day", *INGEST_LOG_KEYS).agg(
            F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES)

    def fresh(self, keys: DataFrame, stream: str, batch: int) -> DataFrame:
        """The keys (with `day`) that no other batch has brought."""
        days = [row[0] for row in keys.select("day").distinct().collect()]
        suspect = [row[0] for row in self._maybe_known(keys, days, stream, batch).select("day").distinct().collect()]
        schema = T.StructType([*KEYS_SCHEMA.fields, *_WRITTEN_BY])
        known = self._days("keys", suspect, schema).where((F.col("stream") != stream) | (F.col("batch") != batch))
        same = reduce(Column.__and__, (keys[k].eqNullSafe(known[k]) for k in ("day", *INGEST_LOG_KEYS)))
        return keys.join(known, same, "left_anti")

    def add(self, arrived: DataFrame, stream: str, batch: int) -> None:
        """Take in the keys of a batch that no other batch has brought; repeats in a batch count once."""
        place = f"{self.root}/arrivals/stream={stream}/batch={batch}"
        arrived.select(*INGEST_LOG_KEYS).distinct().withColumn("day", day_of(F.col("received_at"))).write.mode("overwrite").parquet(place)
        keys = self.spark.read.schema(T.StructType([*KEYS_SCHEMA.fields, _WRITTEN_BY[0]])).parquet(place)
        filters = self._probes(keys).groupBy("day", "bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
        self._write(filters, "filters", stream, batch)
        self._write(self.fresh(keys, stream, batch), "keys", stream, batch)

    def _write(self, rows: DataFrame, table: str, stream: str, batch: int) -> None:
        """A day is one folder, and large days are split over tasks."""
        (
            rows.withColumns({"stream": F.lit(stream), "batch": F.lit(batch)}).hint("rebalance", "day")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "stream", "batch")
            .parquet(f"{self.root}/{table}")
        )
