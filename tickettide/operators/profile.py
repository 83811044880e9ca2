"""What tables there are: name, columns, row count."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW_ROWS = 100


def object_profile(
    tables: Mapping[str, DataFrame], kind: str | Mapping[str, str] = "table"
) -> DataFrame:
    """One row per table. Counting reads no column, for Parquet only footers."""
    kinds = dict.fromkeys(tables, kind) if isinstance(kind, str) else kind
    counts = [
        rows.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("name"),
            F.lit(kinds[name]).alias("type"),
            F.lit(", ".join(rows.columns)).alias("columns"),
            "row_count",
        )
        for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def catalog_profile(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """`object_profile` of the tables and views that the session's catalog lists."""
    listed = sorted(spark.catalog.listTables(pattern=pattern), key=lambda t: t.name)
    kinds = {t.name: "view" if t.isTemporary or t.tableType == "VIEW" else "table" for t in listed}
    if not kinds:
        return spark.createDataFrame([], "name string, type string, columns string, row_count bigint")
    return object_profile({name: spark.table(name) for name in kinds}, kinds)


def preview(rows: DataFrame, limit: int = PREVIEW_ROWS, order_by: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of a table, in a given order if one is wanted."""
    return (rows.orderBy(*order_by) if order_by else rows).limit(limit)
