"""The registered queries next to their SQL; the others are tested against brute force elsewhere."""

import pytest

import __spark_entry__ as driver
from compare import compare, connect
from tickettide.llm.sql import STATEMENTS


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_spark_and_sql_agree(spark, name):
    assert compare(spark, connect(driver.SMOKE_FOLDER), name, driver.SMOKE_FOLDER) is None


@pytest.mark.parametrize("name, columns", [
    ("op1_warc_from_arc", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    ("op3_quality_classifier", ["doc_id", "held_out", "score", "predicted"]),
    ("op4_simhash_near_dedup", ["doc_id", "fingerprint", "component_id"]),
    ("op8_html_text", ["page_id", "url", "text", "n_chars"]),
    ("op9_toxicity", ["doc_id", "held_out", "score", "predicted"]),
])
def test_columns(spark, name, columns):
    rows = driver.queries()[name](spark, driver.SMOKE_FOLDER)
    assert rows.columns == columns and rows.count() in (50, 200)
