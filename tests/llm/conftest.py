import pytest
from pyspark import cloudpickle

import tickettide.llm

cloudpickle.register_pickle_by_value(tickettide.llm)


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, source]) rows."""
    def build(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return build


@pytest.fixture
def clashing():
    """The same rows with extra columns named as operators name their own."""
    from pyspark.sql import functions as F

    names = ("fp", "size", "component", "component_id", "label", "turn", "_score", "_bytes", "_doc_id", "_gone", "ranges", "items", "digest", "line", "group_high",
             "path", "host", "query", "shard", "edits", "_leaves", "node", "row")
    return lambda rows: rows.withColumns({n: F.lit(7) for n in names})
