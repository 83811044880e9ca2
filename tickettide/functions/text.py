"""Text expressions: labels, file names, table names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_blank(text: Column, label: str) -> Column:
    """The text, or a label where it is NULL or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(label))


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def base_name(path: Column) -> Column:
    """Last segment of a path, with either kind of slash."""
    slashed = F.translate(path, "\\", "/")
    return F.substring_index(F.rtrim(slashed, F.lit("/")), "/", -1)


def _visible_name(path: Column) -> Column:
    """Base name without leading dots: the dot of ``.profile`` starts no extension."""
    return F.ltrim(base_name(path), F.lit("."))


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(_visible_name(path), r"(\.[^.]+)$", 1))


def table_name(path: Column) -> Column:
    """A table name from a file name: lower-case letters, digits and underscores."""
    stem = F.regexp_replace(_visible_name(path), r"\.[^.]+$", "")
    safe = F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_")
    return label_blank(F.btrim(safe, F.lit("_")), "data")


def clean_name(header: str) -> str:
    """A header as a column name: its words in small letters, one underscore for whatever space is between them."""
    return "_".join(header.lower().split())
