"""What several operators share: the work folder, word hashing, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickettide.plans.workspace import shared_folder

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder; no other run uses it."""
    return f"{shared_folder(spark)}/tickettide-llm/{purpose}-{uuid.uuid4().hex}"


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows once to the shared folder and read them back, which cuts their lineage."""
    path = work_path(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    """A text's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def text_slices(texts: pa.Array, most: int):
    """(first, last, the texts between as bytes) of a batch's texts: at most so many bytes, or one text; null becomes empty.

    A slice is turned into Python's own objects only when it is reached.
    """
    whole = pc.fill_null(texts.cast(pa.binary()), b"")
    for a, b in slices(pc.binary_length(whole).to_numpy(), most):
        yield a, b, whole.slice(a, b - a).to_pylist()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        values ^= values >> np.uint64(30)
        values *= MIX_A
        values ^= values >> np.uint64(27)
        values *= MIX_B
        values ^= values >> np.uint64(31)
    return values


BASE = 0x2545F4914F6CDD1D | 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < size:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.full(max(size, 1 << 16), base, np.uint64))
        _POWERS[base] = have
    return have[:size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of the bytes; equal bytes, equal hash.

    A polynomial over the whole buffer is summed once, and each span's part is
    moved to the origin with the inverse of its power. Buffers should stay below
    some tens of megabytes, which the callers' batches do.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers(BASE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        inverse = _powers(pow(BASE, -1, 1 << 64), len(data) + 1)
        spans = (sums[ends] - sums[starts]) * inverse[starts]
        return mixed(spans + GOLDEN * np.uint64(seed + 1))


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def slices(lengths: np.ndarray, most: int):
    """Ranges (first, last) of consecutive items of at most that total, or of one item."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(lengths):
        yield first, len(lengths)


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, component): each node of the edges (src, dst) with the smallest node it reaches.

    Alternating large and small stars. A node's neighbours are never gathered:
    their minimum is a plain aggregate. It is written down before it is joined,
    so that both sides of the join come from exchanges of their own and AQE can
    split the rows of a hot node. Each round is written to the shared folder;
    the rounds grow with the logarithm of the longest path. No edges, no rows.
    """
    spark = edges.sparkSession
    state = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    state = written(state, f"{purpose}-edges")
    while not _settled(state):
        state = written(_small_star(_large_star(state)), f"{purpose}-round")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether every larger node has one edge and no smaller node is a larger one: all edges are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and itself, move to the smallest of them.

    After a large star a node has few smaller neighbours, so none is hot here.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def batches(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with a function from one record batch to record batches."""

    def run(stream):
        for batch in stream:
            if batch.num_rows:
                yield from function(batch)

    return rows.mapInArrow(run, schema)
