"""Ticket extracts as they land: plain files or captured reply pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.functions.tickets import pick_field
from tickettide.schema import Domain


#: Records stay text at first, so that each can be stored as it came.
_REPLY_SCHEMA = T.StructType([T.StructField("result", T.ArrayType(T.StringType()))])
RAW = "raw_payload"


def records_from_replies(
    replies: DataFrame, column: str, domain: Domain, part: str = "value"
) -> DataFrame:
    """One row per record of each reply text ``{"result": [...]}``, with the record itself as `RAW`."""
    parsed = F.from_json(F.col(column), _REPLY_SCHEMA)
    return _fields_and_raw(replies.select(F.explode(parsed["result"]).alias(RAW)), domain, part)


def _fields_and_raw(records: DataFrame, domain: Domain, part: str) -> DataFrame:
    """Each record parsed once; one that is no JSON, or names a field twice, has no fields."""
    parsed = records.withColumn("_record", F.try_parse_json(RAW))
    return parsed.select(*(pick_field(F.col("_record"), f, part).alias(f) for f in domain.fields), RAW)


def read_pages(spark: SparkSession, path: str, domain: Domain, part: str = "value") -> DataFrame:
    """Records of all captured reply pages under a path, one reply per file."""
    pages = spark.read.schema(_REPLY_SCHEMA).json(path, multiLine=True)
    return _fields_and_raw(pages.select(F.explode("result").alias(RAW)), domain, part)


def read_extract(spark: SparkSession, path: str, domain: Domain, fmt: str = "parquet") -> DataFrame:
    """A landed table of tickets; fields it lacks read as NULL."""
    return spark.read.schema(domain.ticket_schema).format(fmt).load(path)


def stream_extract(
    spark: SparkSession, path: str, domain: Domain, fmt: str = "parquet", **options: object
) -> DataFrame:
    """The same as a stream of newly landed files."""
    return spark.readStream.schema(domain.ticket_schema).format(fmt).options(**options).load(path)
