"""Nearest vectors by inner product with a vantage-point tree per shard.

Within a shard every vector gets one more component that makes all lengths
equal; the largest inner product is then the smallest distance, and the
triangle inequality holds. A leaf of the tree keeps the range of its distances
to each vantage point above it. A query skips a leaf whose lower bound, times a
factor, exceeds the distance of its k-th best so far: factor one loses nothing,
a larger one skips more.

Equal vectors are one entry with the ids that could ever be reported, so a
vector with a third of all rows is one entry as well. Shards and blocks of
queries have bounded sizes and meet in groups of one shard and one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickettide.llm.common import written

NEAREST = 20
EVERY = 20
FACTOR = 1.2
LEAF = 256
#: Distinct vectors of a shard at most, and vectors a shard should have at least.
SHARD_ROWS, SHARD_LEAST = 65_536, 4096
#: Distinct query vectors of a block.
BLOCK_ROWS = 32_768
_STEP = 2048
#: Candidates kept beyond the wanted ones, against rounding in the search.
_SPARE = 12


class Tree:
    """Leaves of a vantage-point tree over points of equal length."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.vantage, self.leaves = points, [], []
        todo = [(np.arange(len(points)), [])]
        while todo:
            rows, above = todo.pop()
            if len(rows) <= leaf:
                self.leaves.append((rows, above))
                continue
            # The point farthest from the first one makes a vantage point at the rim.
            start = points[rows[0]]
            own = rows[np.argmax(((points[rows] - start) ** 2).sum(axis=1))]
            far = np.sqrt(((points[rows] - points[own]) ** 2).sum(axis=1))
            order = np.argsort(far, kind="stable")
            half = len(rows) // 2
            at = len(self.vantage)
            self.vantage.append(own)
            for part in (order[half:], order[:half]):
                todo.append((rows[part], [*above, at]))
        for i, (rows, above) in enumerate(self.leaves):
            if above:
                gaps = points[rows][:, None, :] - points[[self.vantage[v] for v in above]][None, :, :]
                far = np.sqrt((gaps**2).sum(axis=2))
                self.leaves[i] = (rows, above, far.min(axis=0), far.max(axis=0))
            else:
                self.leaves[i] = (rows, above, np.zeros(0), np.zeros(0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No point of a leaf is nearer to a query than this."""
        lower = np.zeros((len(queries), len(self.leaves)))
        if self.vantage:
            points = self.points[self.vantage]
            square = (queries**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2 * queries @ points.T
            far = np.sqrt(np.maximum(square, 0))
            for i, (_, above, low, high) in enumerate(self.leaves):
                own = far[:, above]
                lower[:, i] = np.maximum(np.maximum(own - high, low - own), 0).max(axis=1)
        return lower


def lifted(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors with one more component, and the length all of them then have."""
    squares = (vectors**2).sum(axis=1)
    longest = float(squares.max())
    return np.concatenate([vectors, np.sqrt(np.maximum(longest - squares, 0))[:, None]], axis=1), float(np.sqrt(longest))


def search(vectors: np.ndarray, queries: np.ndarray, most: int, factor: float = FACTOR, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Per query the rows of its `most` nearest vectors found, best first (-1: none), and its inner products."""
    points, length = lifted(vectors)
    tree = Tree(points, leaf)
    found = np.full((len(queries), most), -1, np.int64)
    for at in range(0, len(queries), _STEP):
        some = queries[at : at + _STEP]
        scaled = some * (length / np.sqrt((some**2).sum(axis=1)))[:, None]
        lower = tree.bounds(np.concatenate([scaled, np.zeros((len(some), 1))], axis=1)) * factor
        best = np.full((len(some), most), -np.inf)
        rows = np.full((len(some), most), -1, np.int64)
        # Each query's most promising leaf first, so that its radius is small from the start.
        nearest = np.argmin(lower, axis=1)
        for first in (True, False):
            for i, (members, *_) in enumerate(tree.leaves):
                if first:
                    active = np.flatnonzero(nearest == i)
                else:
                    radius = np.sqrt(np.maximum(2 * length**2 - 2 * best[:, -1], 0)) * (1 + 1e-9)
                    active = np.flatnonzero((nearest != i) & (lower[:, i] <= radius))
                if len(active):
                    scores = np.concatenate([best[active], scaled[active] @ vectors[members].T], axis=1)
                    ids = np.concatenate([rows[active], np.broadcast_to(members, (len(active), len(members)))], axis=1)
                    keep = np.argpartition(-scores, most - 1, axis=1)[:, :most] if scores.shape[1] > most else np.argsort(-scores, axis=1)
                    kept = np.take_along_axis(scores, keep, axis=1)
                    order = np.argsort(-kept, axis=1, kind="stable")
                    best[active] = np.take_along_axis(kept, order, axis=1)
                    rows[active] = np.take_along_axis(np.take_along_axis(ids, keep, axis=1), order, axis=1)
        found[at : at + len(some)] = rows
    # The measure itself, component after component.
    exact = np.stack([
        (vectors[np.maximum(r, 0)] * q).cumsum(axis=1)[:, -1] for r, q in zip(found, queries)]) if len(queries) else np.zeros((0, most))
    exact[found < 0] = -np.inf
    order = np.argsort(-exact, axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(exact, order, axis=1)


def usable(vector: str = "embedding") -> Column:
    """A vector that is not null, not all zero, and finite in every component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(embeddings: DataFrame, most: int = NEAREST, every: int = EVERY, factor: float = FACTOR,
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors found for each query.

    Queries are the rows whose vec_id `every` divides; candidates all rows with
    another vec_id and a vector of the same number of components. Unusable
    vectors and rows without a vec_id take no part. Equal rows count once; a
    vec_id with several vectors is searched with each. Score is the inner
    product in double precision; ties go to the smaller vec_id.
    """
    spark = embeddings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & usable()).distinct()
    # Of equal vectors only the first ids can be among the nearest, the query's own being one more.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = rows.withColumn("place", place).where(F.col("place") <= most + 1).groupBy("embedding").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = written(entries, "vectors")
    asked = written(rows.where(F.col("vec_id") % every == 0), "queries")
    wanted = written(asked.select("embedding").distinct().withColumn("query", F.monotonically_increasing_id()), "query-vectors")
    size, n_queries = entries.count(), wanted.count()
    shards = max(-(-size // shard_rows), min(parts, -(-size // SHARD_LEAST)), 1)
    blocks = max(-(-n_queries // block_rows), 1)
    shard = F.pmod(F.xxhash64("ids"), F.lit(shards))
    left = entries.withColumn("shard", shard).withColumn("dim", F.size("embedding")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("embedding")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        columns = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            x, q = _matrix(vectors.column("embedding")), _matrix(queries.column("embedding"))
            names, ids = queries.column("query").to_numpy(), vectors.column("ids").to_pylist()
            found, scores = search(x, q, min(most + 1 + _SPARE, len(x)), factor)
            for name, own, values in zip(names, found, scores):
                best = sorted((-s, v) for i, s in zip(own, values.tolist()) if i >= 0 for v in ids[i])[: most + 1]
                columns[0] += [name] * len(best)
                columns[1] += [v for _, v in best]
                columns[2] += [-s for s, _ in best]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ["shard", "block", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= most + 1)
    named = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(wanted, "embedding").select("query_id", "query")
    # A query's own id stands among the first or nowhere; the places after it move up.
    lists = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    near = named.join(lists, "query").select("query_id", F.filter("near", lambda n: n["vec_id"] != F.col("query_id")).alias("near"))
    return near.select("query_id", F.posexplode(F.slice("near", 1, most)).alias("at", "n")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.s")).alias("score"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.values.to_numpy(zero_copy_only=False).reshape(len(flat), -1)[: len(flat)] if flat.offset == 0 else np.array(column.to_pylist())
