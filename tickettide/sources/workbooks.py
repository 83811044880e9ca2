"""Rows of many spreadsheet files, one task per group of files.

A workbook is read with the standard library only (it is XML in a zip file):
first sheet, first row as header. A task holds the bytes of an Arrow batch of
files (``spark.sql.execution.arrow.maxBytesPerBatch``, one file at least), the
strings that the workbook shares, and a batch of its rows; the sheet itself is
read as a stream and its rows are dropped as they pass.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickettide.functions.text import clean_name
from tickettide.functions.times import parse_time

ROW_SCHEMA = "path string, row_number bigint, cells map<string,string>, error string"
BATCH_ROWS = 10_000

# Built-in number formats that show a date or a time.
DATE_FORMAT_IDS = {*range(14, 23), *range(45, 48)}


def read_workbooks(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """Rows of every ``.xlsx`` file under a path; other workbooks give an error row."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{xlsx,xls,XLSX,XLS}")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return decode_workbooks(files, clean)


def decode_workbooks(files: DataFrame, clean: bool = False) -> DataFrame:
    """Rows of workbooks given as (path, content).

    ``cells`` maps header to text, or the header's clean name to it. A file that
    cannot be read, or has two headers that are alike when clean, gives one row
    with ``error`` set.
    """

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                yield from _decode_file(path.as_py(), content.as_py(), clean)

    return files.select("path", "content").mapInArrow(decode, ROW_SCHEMA)


def typed_rows(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Chosen headers as typed columns; text that does not fit reads as NULL."""
    return rows.filter(F.col("error").isNull()).select(
        "path",
        "row_number",
        *(F.col("cells")[name].try_cast(kind).alias(name) for name, kind in columns.items()),
    )


def column_types(rows: DataFrame) -> DataFrame:
    """The narrowest type that fits all texts of each header: (name, type).

    Numbers, booleans and times are recognised; anything else, and a column
    without any text, is a string.
    """
    value = F.col("value")
    fits = {
        "bigint": value.try_cast("bigint").isNotNull(),
        "double": value.try_cast("double").isNotNull(),
        "boolean": value.isin("true", "false"),
        "timestamp_ntz": parse_time(value).isNotNull(),
    }
    kind = F
    for name in fits:
        kind = kind.when(F.col(name), name)
    texts = rows.filter(F.col("error").isNull()).select(F.explode("cells").alias("name", "value"))
    return (
        texts.groupBy("name")
        .agg(*(F.coalesce(F.every(F.when(value.isNotNull(), fit)), F.lit(False)).alias(name)
               for name, fit in fits.items()))
        .select("name", kind.otherwise("string").alias("type"))
    )


def _decode_file(path: str, content: bytes, clean: bool = False) -> Iterator[pa.RecordBatch]:
    numbers: list[int] = []
    cells: list[list[tuple[str, str | None]]] = []
    try:
        for number, row in enumerate(_sheet_rows(content, clean), start=1):
            numbers.append(number)
            cells.append(row)
            if len(numbers) == BATCH_ROWS:
                yield _to_arrow(path, numbers, cells)
                numbers, cells = [], []
    except Exception as problem:  # one bad file must not fail the job
        yield _to_arrow(path, [None], [None], f"{type(problem).__name__}: {problem}")
    if numbers:
        yield _to_arrow(path, numbers, cells)


def _to_arrow(path, numbers, cells, error=None) -> pa.RecordBatch:
    size = len(numbers)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * size, pa.string()),
            pa.array(numbers, pa.int64()),
            pa.array(cells, pa.map_(pa.string(), pa.string())),
            pa.array([error] * size, pa.string()),
        ],
        ["path", "row_number", "cells", "error"],
    )


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheet_rows(content: bytes, clean: bool = False) -> Iterator[list[tuple[str, str | None]]]:
    """Data rows of the first sheet as (header, text) pairs. Empty rows are passed over."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheet, epoch = _first_sheet(book)
        shared = _shared_strings(book)
        dates = _date_styles(book)
        headers: list[str] | None = None
        with book.open(sheet) as xml:
            rows = None
            for event, element in ElementTree.iterparse(xml, events=("start", "end")):
                if event == "start":
                    rows = element if _local(element.tag) == "sheetData" else rows
                    continue
                if _local(element.tag) != "row":
                    continue
                values = dict(_row_values(element, shared, dates, epoch))
                if rows is not None:
                    rows.clear()  # the row goes with its place in the sheet
                if headers is None:
                    headers = _clean_headers(_header_names(values)) if clean else _header_names(values)
                elif any(v is not None for v in values.values()):
                    yield [(name, values.get(i)) for i, name in enumerate(headers)]


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, datetime]:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    first = next(e for e in root.iter() if _local(e.tag) == "sheet")
    link = next(v for k, v in first.attrib.items() if _local(k) == "id")
    since_1904 = any(
        e.get("date1904") in ("1", "true") for e in root.iter() if _local(e.tag) == "workbookPr"
    )
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in links if e.get("Id") == link)
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return path, datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)


def _text_of(element: ElementTree.Element) -> str:
    """Text of a string item, runs joined, reading aids left out."""
    parts = []
    for child in element:
        name = _local(child.tag)
        if name == "t":
            parts.append(child.text or "")
        elif name == "r":
            parts.append(_text_of(child))
    return "".join(parts)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_text_of(item) for item in root if _local(item.tag) == "si"]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Positions of the cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    shows_date = set(DATE_FORMAT_IDS)
    styles: list[int] = []
    for part in root:
        if _local(part.tag) == "numFmts":
            for fmt in part:
                bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
                if re.search("[dmyhs]", bare, re.IGNORECASE):
                    shows_date.add(int(fmt.get("numFmtId")))
        elif _local(part.tag) == "cellXfs":
            styles = [int(style.get("numFmtId", 0)) for style in part]
    return {i for i, fmt in enumerate(styles) if fmt in shows_date}


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - ord("A") + 1
    return index - 1


def _row_values(row, shared, dates, epoch) -> Iterator[tuple[int, str | None]]:
    position = -1
    for cell in row:
        if _local(cell.tag) != "c":
            continue
        reference = cell.get("r")
        position = _column_index(reference) if reference else position + 1
        yield position, _cell_text(cell, shared, dates, epoch)


def _cell_text(cell, shared, dates, epoch) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = next((e for e in cell if _local(e.tag) == "is"), None)
        return None if inline is None else _text_of(inline)
    value = next((e.text for e in cell if _local(e.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = epoch + timedelta(seconds=round(float(value) * 86400))
        return moment.strftime("%Y-%m-%d %H:%M:%S")
    return value.replace("T", " ") if kind == "d" else value


def _header_names(values: Mapping[int, str | None]) -> list[str]:
    """Header texts; blank ones get a name by position, repeats a number."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for i in range(max(values, default=-1) + 1):
        name = values.get(i) or f"Unnamed: {i}"
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        names.append(f"{name}.{repeat}" if repeat else name)
    return names


def _clean_headers(names: list[str]) -> list[str]:
    cleaned = [clean_name(name) for name in names]
    alike = sorted({name for name in cleaned if cleaned.count(name) > 1})
    if alike:
        raise ValueError(f"headers alike after cleaning: {', '.join(alike)}")
    return cleaned
