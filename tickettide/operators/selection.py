"""The first rows of a table, or of each of its groups, without sorting the table.

The last row wanted is looked for level by level. Per level the values of one
column are counted, which every task does before anything is shuffled. The
counts are dealt out by ranges of the value, so that the value at which the
wanted number is reached is found by adding up a number per range and then
looking into one of them. Only rows that share this value go on to the next
level. What is found is a cut-off per group: a filter for the rows, which are
never sorted, ranked or moved.

The cut-offs are looked for when this is called, in small jobs over the columns
that matter. Counts are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickettide.plans.workspace import new_folder

_ALL, _PART, _N, _WANT, _CUT, _REST, _DIGEST = "_all", "_part", "_n", "_want", "_cut", "_rest", "_digest"


@dataclass(frozen=True)
class Level:
    """One column of the order. Null comes before every value, or after every one if descending."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc_nulls_last() if self.descending else F.col(self.column).asc_nulls_first()

    def before(self, cut: Column) -> Column:
        """Whether a row's value comes before the cut-off's."""
        value = F.col(self.column)
        if self.descending:
            return F.coalesce(value > cut, value.isNotNull())
        return F.coalesce(value < cut, value.isNull()) & cut.isNotNull()


def written(rows: DataFrame, purpose: str) -> DataFrame:
    path = new_folder(rows.sparkSession, purpose)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def reached(counts: DataFrame, group: Sequence[str], level: Level, wanted: DataFrame | int) -> DataFrame:
    """Where each group's running count, in order, first reaches the number wanted.

    `counts` has a row per group and value with `_n`; `wanted` has `_want` per
    group, or is one number for all. Gives the group, the value as `_cut`, how
    many of its rows are wanted as `_rest` and how many there are as `_n`.
    Groups with fewer rows than wanted are left out.
    """
    ranged = written(
        counts.repartitionByRange(*group, level.order()).withColumn(_PART, F.spark_partition_id()), "counted")
    per_range = ranged.groupBy(*group, _PART).agg(F.sum(_N).alias("_in_range"))
    so_far = F.sum("_in_range").over(Window.partitionBy(*group).orderBy(_PART))
    sized = per_range.withColumn("_before", so_far - F.col("_in_range"))
    sized = sized.withColumn(_WANT, F.lit(wanted).cast("bigint")) if isinstance(wanted, int) else _beside(sized, wanted, group)
    hit = sized.where((F.col("_before") < F.col(_WANT)) & (F.col(_WANT) <= F.col("_before") + F.col("_in_range"))).select(
        *group, _PART, _WANT, "_before")
    within = F.sum(_N).over(Window.partitionBy(*group, _PART).orderBy(level.order())) + F.col("_before")
    looked = _beside(ranged, hit, [*group, _PART]).where(F.col(_WANT).isNotNull()).withColumn("_reached", within)
    return written(
        looked.where((F.col("_reached") >= F.col(_WANT)) & (F.col("_reached") - F.col(_N) < F.col(_WANT))).select(
            *group, F.col(level.column).alias(_CUT), (F.col(_WANT) - F.col("_reached") + F.col(_N)).alias(_REST), _N), "reached")


def first_rows(rows: DataFrame, most: int, order: Sequence[Level], group: Sequence[str] = ()) -> DataFrame:
    """The first `most` rows by the order, of all rows or of each group; they come in no order.

    Rows alike in every column of the order are taken by a digest of all
    columns, so reruns agree; of rows alike in all columns as many copies are
    made as are wanted. Null groups are groups. `group` should have few
    values, since the cut-offs, a row per group, are broadcast.
    """
    if most <= 0:
        return rows.limit(0)
    keys = list(group) or [_ALL]
    keyed = rows if group else rows.withColumn(_ALL, F.lit(0))
    digest = F.xxhash64(*rows.columns)
    levels, cuts, tied, wanted = [*order, Level(_DIGEST)], [], keyed, most
    for level in levels:
        if level.column == _DIGEST:
            tied, keyed = tied.withColumn(_DIGEST, digest), keyed.withColumn(_DIGEST, digest)
        counts = tied.groupBy(*keys, level.column).agg(F.count(F.lit(1)).alias(_N))
        cuts.append(reached(counts, keys, level, wanted))
        split = cuts[-1].where(F.col(_REST) < F.col(_N))
        if split.isEmpty():
            break
        wanted = split.select(*keys, F.col(_REST).alias(_WANT))
        tied = _at_cut(tied, keys, level, split)
    ends = _One(cuts) if keys == [_ALL] else _Each(cuts, keys)
    inside, partly = _sides(levels, ends.cuts, ends.wholes)
    beside = ends.beside(keyed, levels[0])
    found = beside.where(ends.uncut | inside)
    if len(cuts) == len(levels):
        some = beside.where(~ends.uncut & partly).dropDuplicates(keys)
        copies = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), ends.rest)))
        found = found.select(*rows.columns).unionByName(copies.select(*rows.columns))
    return found.select(*rows.columns)


def _sides(levels: Sequence[Level], cuts: Sequence[Column], wholes: Sequence[Column]) -> tuple[Column, Column]:
    """Whether a row is before the cut-off or wholly taken with it, and whether it is at a cut-off that takes only some."""
    inside, at_cut = F.lit(False), F.lit(True)
    for level, cut, whole in zip(levels, cuts, wholes):
        same = F.col(level.column).eqNullSafe(cut)
        inside = inside | (at_cut & (level.before(cut) | (same & whole)))
        at_cut = at_cut & same & ~whole
    return inside, at_cut


class _One:
    """The cut-off of all rows, as constants: the first one reaches the scan as a filter."""

    def __init__(self, cuts: Sequence[DataFrame]):
        found = [(table.first(), table.schema[_CUT].dataType) for table in cuts]
        self.first = found[0][0]
        self.uncut = F.lit(self.first is None)
        rows = [] if self.first is None else found
        self.cuts = [F.lit(row[_CUT]).cast(kind) for row, kind in rows]
        self.wholes = [F.lit(row[_REST] == row[_N]) for row, _ in rows]
        self.rest = F.lit(rows[-1][0][_REST] if rows else 0).cast("bigint")

    def beside(self, rows: DataFrame, level: Level) -> DataFrame:
        if self.first is None:
            return rows
        value, cut = F.col(level.column), self.first[_CUT]
        if level.descending:
            return rows if cut is None else rows.where(value >= self.cuts[0])
        return rows.where(value.isNull() if cut is None else value.isNull() | (value <= self.cuts[0]))


class _Each:
    """The cut-off of each group, joined to its rows."""

    def __init__(self, cuts: Sequence[DataFrame], keys: Sequence[str]):
        self.keys, self.table = keys, None
        for i, found in enumerate(cuts):
            named = found.select(*keys, F.col(_CUT).alias(f"_cut{i}"), (F.col(_REST) == F.col(_N)).alias(f"_whole{i}"),
                                 F.col(_REST).alias(f"_rest{i}"))
            self.table = named if self.table is None else _beside(self.table, named, keys)
        self.uncut = F.col("_whole0").isNull()
        self.cuts = [F.col(f"_cut{i}") for i in range(len(cuts))]
        self.wholes = [F.col(f"_whole{i}") for i in range(len(cuts))]
        self.rest = F.col(f"_rest{len(cuts) - 1}")

    def beside(self, rows: DataFrame, level: Level) -> DataFrame:
        return _beside(rows, F.broadcast(self.table), self.keys)


def _same_keys(keys: Sequence[str]) -> Column:
    """Equal keys, null included, where one side's are named by `_key` and number."""
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))


def _renamed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})


def _beside(rows: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join by keys, null ones included."""
    return rows.join(_renamed(more, keys), _same_keys(keys), "left").drop(*(f"_key{i}" for i in range(len(keys))))


def _at_cut(rows: DataFrame, keys: Sequence[str], level: Level, cuts: DataFrame) -> DataFrame:
    """The rows whose value is their group's cut-off."""
    if list(keys) == [_ALL]:
        return rows.where(F.col(level.column).eqNullSafe(F.lit(cuts.first()[_CUT]).cast(cuts.schema[_CUT].dataType)))
    some = F.broadcast(_renamed(cuts.select(*keys, _CUT), keys))
    return rows.join(some, _same_keys(keys) & F.col(level.column).eqNullSafe(F.col(_CUT)), "left_semi")
