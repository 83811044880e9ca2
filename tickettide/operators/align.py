"""Fitting rows to a table's columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.functions.text import clean_name


def clean_columns(rows: DataFrame) -> DataFrame:
    """Rename all columns to their clean names; two alike are an error."""
    names = [clean_name(c) for c in rows.columns]
    doubles = sorted({n for n in names if names.count(n) > 1})
    if doubles:
        raise ValueError(f"columns have the same name after cleaning: {', '.join(doubles)}")
    return rows.toDF(*names)


def align_to(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in a table's shape: its order and types, NULL for what is missing.

    Columns the table does not have are left out.
    """
    have = set(rows.columns)
    return rows.select(
        *(
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )


def evolve_union(
    older: DataFrame, newer: DataFrame, defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """Both sets of rows in the union of their columns.

    A column new to the older rows takes its default where one is given.
    """
    added = {c: v for c, v in (defaults or {}).items() if c not in older.columns}
    filled = older.withColumns({c: F.lit(v) for c, v in added.items()}) if added else older
    return filled.unionByName(newer, allowMissingColumns=True)
