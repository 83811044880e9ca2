"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). Token capacity flows from patterns to source quotas; each further
repetition of a pattern costs more than the one before, so the flow repeats as
little as the quotas allow. What it sends through a pattern is then taken from
the pattern's documents in a seeded order, with exact sums.

Only the pattern table meets the driver; its rows are counted first and may
not pass MAX_PATTERNS. Running sums go over hash buckets, so a source with a
third of all rows is no window of its own.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickettide.llm.common import written

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
#: Distinct membership patterns the flow is solved for on the driver.
MAX_PATTERNS = 100_000
#: Leading hex digits of the seeded order that make a bucket.
BUCKET_DIGITS = 4
#: Documents added one by one, per pattern, into what a prefix leaves open.
FILLS = 3


def n_words(column: str = "text"):
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, share: Fraction | int = 1, most: int = MAX_REPEATS) -> dict:
    """Targets by source: the whole, shared by weight, none above `most` times its size;
    the excess is shared again by weight until none is above."""
    whole = Fraction(sum(sizes.values())) * share
    targets: dict = {}
    open_ = {s for s in sizes if sizes[s] > 0}
    targets.update({s: Fraction(0) for s in sizes if s not in open_})
    left = whole
    while open_:
        total = sum(weights[s] for s in open_)
        above = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not above:
            targets.update({s: left * weights[s] / total for s in open_})
            break
        for s in above:
            targets[s] = Fraction(most * sizes[s])
            left -= targets[s]
        open_ -= above
    return targets


def route(patterns: list[tuple[tuple, int]], targets: dict, most: int = MAX_REPEATS) -> dict[tuple[int, object], int]:
    """Tokens from pattern i to source s at least cost, as {(i, s): tokens}.

    Repetition r of a pattern has the pattern's tokens as capacity and costs r;
    as much of the quotas as the patterns can fill is filled. Successive
    shortest paths; patterns of one source need no search.
    """
    want = {s: int(round(t)) for s, t in targets.items()}
    flow: dict[tuple[int, object], int] = {}
    layers: list[list[int]] = []
    shared = [i for i, (members, _) in enumerate(patterns) if len(members) > 1]
    alone = [i for i, (members, _) in enumerate(patterns) if len(members) == 1]
    if not shared:
        for i in alone:
            (s,), size = patterns[i]
            flow[i, s] = min(want[s], most * size)
            want[s] -= flow[i, s]
        return flow
    nodes = {("p", i): k for k, i in enumerate(range(len(patterns)))}
    nodes |= {("s", s): len(nodes) + k for k, s in enumerate(want)}
    source, sink = len(nodes), len(nodes) + 1
    graph: list[list[list]] = [[] for _ in range(len(nodes) + 2)]

    def arc(a, b, capacity, cost):
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, (members, size) in enumerate(patterns):
        for r in range(most):
            arc(source, nodes["p", i], size, r)
        for s in members:
            arc(nodes["p", i], nodes["s", s], most * size, 0)
    for s, t in want.items():
        arc(nodes["s", s], sink, t, 0)
    potential = [0] * len(graph)
    while True:
        distance = [None] * len(graph)
        before: list = [None] * len(graph)
        distance[source], queue = 0, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for k, (b, capacity, cost, _) in enumerate(graph[a]):
                if capacity > 0:
                    new = d + cost + potential[a] - potential[b]
                    if distance[b] is None or new < distance[b]:
                        distance[b], before[b] = new, (a, k)
                        heapq.heappush(queue, (new, b))
        if distance[sink] is None:
            break
        potential = [p + d if d is not None else p for p, d in zip(potential, distance)]
        path, at, push = [], sink, None
        while at != source:
            a, k = before[at]
            path.append(graph[a][k])
            push = graph[a][k][1] if push is None else min(push, graph[a][k][1])
            at = a
        for edge in path:
            edge[1] -= push
            graph[edge[0]][edge[3]][1] += push
    for i, (members, size) in enumerate(patterns):
        for edge in graph[nodes["p", i]]:
            for s in members:
                if edge[0] == nodes["s", s] and edge[2] == 0 and most * size - edge[1] > 0:
                    flow[i, s] = most * size - edge[1]
    return flow


def _ordered(members):
    """Sources by code point, null last."""
    return sorted(members, key=lambda s: (s is None, s or ""))


def mix(documents: DataFrame, share: Fraction | int = 1, most: int = MAX_REPEATS, seed: str = SEED,
        max_patterns: int = MAX_PATTERNS, weights=None) -> DataFrame:
    """(doc_id, sources, size, pattern_size, quota, repeats, taken): the mix, one row per document.

    `documents` has doc_id, text and either `sources` (an array) or `source`.
    An empty or null array counts as the null source, a source named twice as
    named once. `weights` maps a source to its weight; by default sources by
    code point, null last, weigh 1, 2, 3, repeating. `repeats` is how often the
    document is taken, `quota` the tokens the flow sends through its pattern.
    A document's taken words are whole repeats. A pattern's documents come in
    the order of a seeded digest of the id (ties: id, size) while the whole
    next one fits; then, up to three times, the largest remaining one that
    fits; then the smallest remaining one, if that comes closer. Null texts and texts without words have size 0 and are taken 0 words.
    Null ids are digested as empty text. An empty table gives no rows.
    """
    if "sources" in documents.columns:
        named = F.array_sort(F.array_distinct(F.coalesce(F.when(F.size("sources") > 0, F.col("sources")), F.array(F.lit(None).cast("string")))))
    else:
        named = F.array(F.col("source").cast("string"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = written(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), named.alias("sources"), n_words().alias("size"), digest.alias("turn"),
        F.monotonically_increasing_id().alias("row")), "mix-sizes")
    sums = rows.groupBy("sources").agg(F.sum("size").alias("size"))
    table = sums.limit(max_patterns + 1).collect()  # counted below, never cut short
    if len(table) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; raise max_patterns")
    patterns = [(tuple(_ordered(r["sources"])), int(r["size"])) for r in table]
    members = _ordered({s for own, _ in patterns for s in own})
    weight = {s: (weights or {}).get(s, WEIGHTS[k % len(WEIGHTS)]) for k, s in enumerate(members)}
    held = {s: sum(size for own, size in patterns if s in own) for s in members}
    whole = sum(size for _, size in patterns)
    targets = quotas(held, weight, share * Fraction(whole, max(1, sum(held.values()))), most)
    flow = route(patterns, targets, most)
    plan = []
    for i, r in enumerate(table):
        sent = sum(flow.get((i, s), 0) for s in patterns[i][0])
        times, rest = divmod(sent, patterns[i][1]) if patterns[i][1] else (0, 0)
        one = patterns[i][0][0] if len(patterns[i][0]) == 1 else None
        plan.append((list(r["sources"]), patterns[i][1], float(targets[one]) if len(patterns[i][0]) == 1 else float(sent), sent, times, rest))
    plans = rows.sparkSession.createDataFrame(
        plan, "sources array<string>, pattern_size long, quota double, sent long, times long, rest long")
    planned = rows.join(F.broadcast(plans), "sources")
    taken = _select(planned)
    return taken.select(
        "doc_id", "sources", "size", "pattern_size", "quota", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def _select(planned: DataFrame) -> DataFrame:
    """Adds repeats: the whole rounds, and one more for the chosen part of each pattern."""
    spark = planned.sparkSession
    open_ = planned.where("rest > 0")
    edge = open_.groupBy("sources").agg(F.lit("").alias("edge"), F.lit(0).cast("long").alias("edge_before"))
    # One row per pattern, which max_patterns bounds; a level has 256 buckets of each.
    for digits in range(2, BUCKET_DIGITS + 1, 2):
        near = open_.join(F.broadcast(edge), "sources").where(F.substring("turn", 1, digits - 2) == F.col("edge"))
        sums = near.groupBy("sources", F.substring("turn", 1, digits).alias("bucket")).agg(
            F.sum("size").alias("bucket_size"), F.max("rest").alias("rest"), F.max("edge_before").alias("edge_before"))
        earlier = F.sum("bucket_size").over(Window.partitionBy("sources").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        before = sums.withColumn("before", F.col("edge_before") + F.coalesce(earlier, F.lit(0)))
        edge = written(before.where("before <= rest and before + bucket_size > rest").groupBy("sources").agg(
            F.min("bucket").alias("edge"), F.min_by("before", "bucket").alias("edge_before")), "mix-edge")
    planned = planned.withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS))
    rows = written(planned.join(F.broadcast(edge), "sources", "left"), "mix-order")
    inner = rows.where("bucket = edge")
    at = Window.partitionBy("sources").orderBy("turn", F.col("doc_id").asc_nulls_first(), "size", "row")
    inside = inner.withColumn("until", F.col("edge_before") + F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("more", F.col("until") <= F.col("rest")).drop("until")
    outside = rows.where("edge is null or bucket <> edge").withColumn(
        "more", (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))))
    chosen = written(inside.unionByName(outside), "mix-chosen")
    # What the prefix leaves open, at most one row per pattern.
    gaps = {_key(r): r["gap"] for r in chosen.groupBy("sources").agg(
        (F.max("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap")).collect()}
    picked: list[int] = []
    largest = F.max_by(F.struct("row", "size"), F.struct("size", "turn", F.col("doc_id"), "row"))
    for _ in range(FILLS):
        open_ = spark.createDataFrame([(list(k), g) for k, g in gaps.items() if g > 0], "sources array<string>, gap long")
        fits = _without(chosen.where("not more and size > 0"), picked).join(F.broadcast(open_), "sources").where("size <= gap")
        for r in fits.groupBy("sources").agg(largest.alias("best")).collect():
            picked.append(r["best"]["row"])
            gaps[_key(r)] -= r["best"]["size"]
    # One more than fits, where that comes closer.
    open_ = spark.createDataFrame([(list(k), g) for k, g in gaps.items() if g > 0], "sources array<string>, gap long")
    over = _without(chosen.where("not more and size > 0"), picked).join(F.broadcast(open_), "sources").where("size < 2 * gap")
    least = F.min_by("row", F.struct("size", "turn", F.col("doc_id"), "row"))
    picked += [r["row"] for r in over.groupBy("sources").agg(least.alias("row")).collect()]
    more = F.col("more") | F.col("_picked").isNotNull()
    done = chosen.join(F.broadcast(_rows(spark, picked)), F.col("row") == F.col("_picked"), "left")
    return done.withColumn("repeats", F.when(F.col("size") > 0, F.col("times") + more.cast("long")).otherwise(F.lit(0).cast("long")))


def _key(row) -> tuple:
    return tuple(row["sources"])


def _rows(spark, picked: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in picked], "_picked long")


def _without(rows: DataFrame, picked: list[int]) -> DataFrame:
    if not picked:
        return rows
    return rows.join(F.broadcast(_rows(rows.sparkSession, picked)), F.col("row") == F.col("_picked"), "left_anti")
