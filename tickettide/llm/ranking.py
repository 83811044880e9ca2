"""Places of rows within groups of any size, over range partitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.llm.common import written

PART, PLACE, FIRST, LAST = "_part", "_place", "_first", "_last"


def _changes(batch: pa.RecordBatch, group: Sequence[str], before: list) -> np.ndarray:
    """Where a row's group differs from the row before it; `before` holds the group of the row before the batch."""
    changed = np.zeros(batch.num_rows, bool)
    for name, last in zip(group, before):
        column = batch.column(name)
        shifted = pa.concat_arrays([pa.array([last], column.type), column.slice(0, batch.num_rows - 1)])
        differ = pc.not_equal(column, shifted)
        null = pc.xor(pc.is_null(column), pc.is_null(shifted))
        changed |= np.asarray(pc.or_(pc.fill_null(differ, False), null))
    return changed


def _numbered(stream, group: list[str]):
    """Adds the partition, the place within the group, and whether the row is of the first group or the last row."""
    part, place, first, before, held = TaskContext.get().partitionId(), 0, True, None, None
    for batch in stream:
        n = batch.num_rows
        if not n:
            continue
        if before is None:
            before = [batch.column(name)[0].as_py() for name in group]
        changed = _changes(batch, group, before)
        at = np.arange(n)
        starts = np.where(changed, at, -1)
        starts = np.maximum.accumulate(starts)
        places = np.where(starts < 0, place + at + 1, at - starts + 1)
        firsts = (starts < 0) & first
        place, first = int(places[-1]), bool(firsts[-1])
        before = [batch.column(name)[n - 1].as_py() for name in group]
        if held is not None:
            yield held
        held = pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(places.astype(np.int64)), pa.array(firsts),
             pa.array(np.zeros(n, bool))],
            [*batch.schema.names, PART, PLACE, FIRST, LAST])
    if held is not None:
        ends = np.zeros(held.num_rows, bool)
        ends[-1] = True
        yield held.set_column(held.num_columns - 1, LAST, pa.array(ends))


def placed(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], purpose: str, sort: Sequence[str] = (),
    keep: Callable[[DataFrame], DataFrame] = lambda sorted_rows: sorted_rows,
) -> DataFrame:
    """Rows with their place (`_place`, from 1) within their group in ascending order, nulls first.

    Rows are dealt out by ranges of group and order, so a group of any size is
    spread over partitions, and numbered within each partition as they stream
    by. Only the first group of a partition can have begun in an earlier one;
    what it has there is a row per partition, which is added up and broadcast.
    `sort` settles ties of `order`, which then only bounds the ranges: rows tied
    by it stay in one partition. `keep` projects the sorted rows, before they
    are written. `group` may be empty: all rows are one group.
    Rows of equal group and order get places in no fixed order.
    """
    group, order = list(group), list(order)
    dealt = keep(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order, *sort))
    names = dealt.columns
    schema = T.StructType([*dealt.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(PLACE, T.LongType()),
                           T.StructField(FIRST, T.BooleanType()), T.StructField(LAST, T.BooleanType())])
    local = written(dealt.mapInArrow(lambda stream: _numbered(stream, group), schema), purpose)
    # Null groups compare as equal in windows.
    ends = local.where(LAST).select(PART, *group, F.col(PLACE).alias("_n"))
    begins = local.where(FIRST).groupBy(PART, *group).agg(F.lit(0).cast("bigint").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(PART).rangeBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("_end", F.lit(True)).unionByName(begins.withColumn("_end", F.lit(False))).withColumn(
        "_before", F.sum("_n").over(earlier)).where("NOT _end AND _before > 0").select(PART, "_before")
    # A row per partition at most.
    moved = local.join(F.broadcast(offsets), PART, "left")
    return moved.select(*names, (F.col(PLACE) + F.when(F.col(FIRST), F.coalesce("_before", F.lit(0))).otherwise(0)).alias(PLACE))
