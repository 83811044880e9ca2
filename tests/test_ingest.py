"""The chain from attached workbooks to a table."""

from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import tickettide.functions.text
import tickettide.sources.workbooks as workbooks
from checks.xlsx import encode_workbook
from tickettide.plans import ingest

cloudpickle.register_pickle_by_value(workbooks)
cloudpickle.register_pickle_by_value(tickettide.functions.text)

COLUMNS = {"berth": "string", "crates": "bigint"}


@pytest.fixture
def files(spark):
    def build(*rows):
        made = [(name, at, content if isinstance(content, bytes) else encode_workbook(["Berth", "Crates"], content)) for name, at, content in rows]
        return spark.createDataFrame(made, "filename string, received_at string, content binary")
    return build


def content(spark, root):
    rows = sorted(tuple(r) for r in ingest.ingested_rows(spark, root, "t").select("berth", "crates").collect())
    log = sorted((r.filename, r.rows_loaded) for r in ingest.ingest_log(spark, root).collect())
    return rows, log


def test_loads_add_up_and_repeats_stay_out(spark, files, tmp_path):
    root = str(tmp_path / "root")
    book = [["North", "3"], ["South", "4"]]
    first = files(("a.xlsx", "2024-01-01", book), ("a.xlsx", "2024-01-01", book), ("bad.xlsx", "2024-01-01", b"no zip"))
    failed = ingest.ingest_workbooks(first, root, "t", COLUMNS)
    assert [(r.filename, "BadZipFile" in r.error) for r in failed.collect()] == [("bad.xlsx", True)]
    assert content(spark, root) == ([("North", 3), ("South", 4)], [("a.xlsx", 2)])
    again = files(("a.xlsx", "2024-01-01", book), ("a.xlsx", "2024-01-02", [["East", "x"]]), ("b.xlsx", "2024-01-02", []))
    ingest.ingest_workbooks(again, root, "t", COLUMNS)
    assert content(spark, root) == ([("East", None), ("North", 3), ("South", 4)], [("a.xlsx", 1), ("a.xlsx", 2), ("b.xlsx", 0)])
    assert len([p for p in Path(root, "t").iterdir() if p.is_dir()]) == 2


def test_a_load_that_failed_is_not_seen(spark, files, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    ingest.ingest_workbooks(files(("a.xlsx", "2024-01-01", [["North", "3"]])), root, "t", COLUMNS)

    def fail(*_):
        raise OSError("cut short")

    more = files(("b.xlsx", "2024-01-02", [["East", "5"]]))
    monkeypatch.setattr(ingest, "new_log_rows", fail)
    with pytest.raises(OSError):
        ingest.ingest_workbooks(more, root, "t", COLUMNS)
    assert content(spark, root) == ([("North", 3)], [("a.xlsx", 1)])
    monkeypatch.undo()
    ingest.ingest_workbooks(more, root, "t", COLUMNS)
    assert content(spark, root) == ([("East", 5), ("North", 3)], [("a.xlsx", 1), ("b.xlsx", 1)])


def test_of_different_contents_one_is_taken(spark, files, tmp_path):
    rows = files(("a.xlsx", "2024-01-01", [["North", "3"]]), ("a.xlsx", "2024-01-01", [["South", "4"]]))
    for k in range(2):
        ingest.ingest_workbooks(rows.orderBy(F.rand()), str(tmp_path / str(k)), "t", COLUMNS)
    assert content(spark, str(tmp_path / "0")) == content(spark, str(tmp_path / "1"))
    assert len(content(spark, str(tmp_path / "0"))[0]) == 1
