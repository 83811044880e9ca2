"""A trie over conversations' turns, by vertical bitmaps.

Conversations are cut into shards of consecutive ids. A shard indexes every
(position, turn) to the bitset of its conversations, and walks its trie depth
first: a node's bitset intersected with a turn's posting is a child, its lowest
bit the smallest conversation, its popcount the members. Nodes of all shards
then meet under a 128-bit key of their prefix, one row per shard and node, so a
prefix that every conversation starts with costs a row per shard.

What concerns a subtree is summed in the shards too: every node's own figures
are given to the shard of its smallest conversation, each shard adds them up
from below, and the shards' sums add up to the whole.

A bitset covers the first `LONG` positions. The few conversations beyond that
(at most a `LONG`th as many as there are turns) are followed row by row there,
by running totals over blocks of positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickettide.llm.common import written
from tickettide.llm.ranking import PLACE, placed

#: Conversations, or rows, after which a shard is cut; it holds whole conversations.
SHARD_CONVERSATIONS, SHARD_ROWS = 4096, 1 << 16
#: Positions that bitsets cover, and positions in a block of running totals beyond.
LONG = 4096
#: Conversations of a family share turns of its first one.
FAMILY, MOST_SHARED = 5, 9
#: Leading characters that deal turns out; more only matter where they tie.
HEAD = 100

KEY = ["depth", "ka", "kb"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, bytes, _place): the turns of each conversation, numbered.

    They are ordered by turn, null first, then by role and text; null roles and
    texts are empty, and repeated turns count as often as they come. Rows
    without a conversation's id belong to none and are left out. Turns are
    dealt out by conversation and turn, so that a conversation of any size is
    spread, and their texts go no further than that.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.concat(role, F.lit("\0"), text).alias("said"),
        F.octet_length(role).alias("role_bytes"), F.octet_length(text).cast("bigint").alias("bytes"))

    def digested(dealt: DataFrame) -> DataFrame:
        told = F.concat(F.col("role_bytes").cast("string"), F.lit(":"), "said")
        return dealt.select("conv_id", F.unhex(F.substring(F.sha2(told.cast("binary"), 256), 1, 32)).alias("digest"), "bytes")

    return placed(rows.withColumn("head", F.left("said", F.lit(HEAD))), ["conv_id"], ["turn", "head"], "turns", ["said"], digested)


def _shared_turns(conversation: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return (F.crc32(conversation.cast("string").cast("binary")) % MOST_SHARED).cast("bigint")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families' conversations rebuilt: (conv_id, length) and (conv_id, depth, za, zb, bytes).

    Conversation c takes the first h turns of c - c % 5 (all if there are fewer,
    none if it is absent), then its own turns after its first h, where h is the
    CRC-32 of its id modulo nine. `za` and `zb` are hashes of a turn at its
    depth; a prefix is known by the depth and the exclusive or of its turns'.
    """
    counts = written(numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversation-sizes")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    firsts = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(_shared_turns(F.col("conv_id")), F.coalesce("base_n", F.lit(0)))
    sized = counts.withColumn("base", base).join(firsts, "base", "left").select(
        "conv_id", "base", taken.alias("taken"),
        (taken + F.greatest(F.col("n") - _shared_turns(F.col("conv_id")), F.lit(0))).alias("length"))
    sized = written(sized, "conversations")
    own = numbered.withColumn("after", F.col(PLACE) - _shared_turns(F.col("conv_id"))).where("after > 0").join(
        sized.select("conv_id", "taken"), "conv_id").select("conv_id", (F.col("after") + F.col("taken")).alias("depth"), "digest", "bytes")
    lent = numbered.where((F.col(PLACE) < MOST_SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base").join(
        sized.where("taken > 0").select("conv_id", "base", "taken"), "base").where(F.col(PLACE) <= F.col("taken")).select(
        "conv_id", F.col(PLACE).alias("depth"), "digest", "bytes")
    rows = own.unionByName(lent).select(
        "conv_id", "depth", F.xxhash64("depth", "digest").alias("za"), F.xxhash64("digest", "depth").alias("zb"), "bytes")
    return sized.select("conv_id", "length"), written(rows, "rebuilt")


def _bits(units: np.ndarray) -> int:
    """The bitset of some units."""
    if len(units) == 1:
        return 1 << int(units[0])
    marks = np.zeros(int(units.max()) + 1, bool)
    marks[units] = True
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def _units(bits: int) -> np.ndarray:
    """The units of a bitset, in order."""
    data = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little"))


class _Shard:
    """The vertical index of some conversations, and its nodes in depth-first order."""

    def __init__(self, rows: dict[str, np.ndarray]):
        # A row of depth 0 opens each conversation and holds its length.
        self.starts = np.flatnonzero(rows["depth"] == 0)
        self.conv = rows["conv_id"][self.starts].tolist()
        self.length = rows["bytes"][self.starts]
        unit = np.cumsum(rows["depth"] == 0) - 1
        order = np.lexsort((rows["zb"], rows["za"], rows["depth"]))
        new = np.zeros(len(order), bool)
        for name in ("depth", "za", "zb"):
            column = rows[name][order]
            new[1:] |= column[1:] != column[:-1]
        token = np.empty(len(order), np.int64)
        token[order] = np.cumsum(new)
        self.token = token.tolist()
        cuts = np.concatenate([[0], np.flatnonzero(new), [len(order)]])
        leads = order[cuts[:-1]]
        self.za, self.zb, self.bytes = (rows[n][leads].tolist() for n in ("za", "zb", "bytes"))
        self.posting = [_bits(unit[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
        self.ends = {int(n): _bits(np.flatnonzero(self.length == n)) for n in np.unique(self.length)}

    def nodes(self, deepest: int):
        """(parent's number, depth, key, own hashes, bytes, members' bitset, ending members' bitset) in order."""
        starts, token, number = self.starts.tolist(), self.token, 0
        stack = [(-1, 0, 0, 0, 0, 0, 0, (1 << len(starts)) - 1)]
        while stack:
            parent, depth, ka, kb, za, zb, size, members = stack.pop()
            ending = members & self.ends.get(depth, 0)
            yield parent, depth, ka, kb, za, zb, size, members, ending
            rest = members ^ ending if depth < deepest else 0
            while rest:
                t = token[starts[(rest & -rest).bit_length() - 1] + depth + 1]
                child = rest & self.posting[t]
                rest ^= child
                stack.append((number, depth + 1, ka ^ self.za[t], kb ^ self.zb[t], self.za[t], self.zb[t], self.bytes[t], child))
            number += 1


_NODES = pa.schema([
    ("shard", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()),
    ("pa", pa.int64()), ("pb", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()),
    ("ends", pa.string()), ("first_end", pa.int64()), ("deeper", pa.list_(pa.int64())),
])
_NODES_SQL = ("shard bigint, node bigint, parent bigint, depth bigint, ka bigint, kb bigint, pa bigint, pb bigint, conv_id bigint, "
              "n bigint, bytes bigint, ends string, first_end bigint, deeper array<bigint>")


def _shard_nodes(rows: dict[str, np.ndarray], shard: int, deepest: int):
    index = _Shard(rows)
    found = []
    for number, (parent, depth, ka, kb, za, zb, size, members, ending) in enumerate(index.nodes(deepest)):
        ids = [index.conv[u] for u in _units(ending)] if ending else []
        deeper = [index.conv[u] for u in _units(members ^ ending)] if depth == deepest and members != ending else None
        found.append((shard, number, parent, depth, ka, kb, ka ^ za, kb ^ zb, index.conv[(members & -members).bit_length() - 1],
                      members.bit_count(), size, ",".join(map(str, ids)) if ids else None, ids[0] if ids else None, deeper))
        if len(found) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _NODES.types)], schema=_NODES)
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _NODES.types)], schema=_NODES)


def _cut(stream, most_conversations: int, most_rows: int):
    """Whole conversations of the stream in blocks of bounded size."""
    names = ("conv_id", "depth", "za", "zb", "bytes")
    held: list[dict[str, np.ndarray]] = []
    rows = conversations = 0
    for batch in stream:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        begin = 0
        for at in np.flatnonzero(columns["depth"] == 0).tolist():
            if conversations >= most_conversations or rows + at - begin >= most_rows:
                if held or at > begin:
                    held.append({n: c[begin:at] for n, c in columns.items()})
                    yield {n: np.concatenate([h[n] for h in held]) for n in names}
                held, begin, rows, conversations = [], at, 0, 0
            conversations += 1
        held.append({n: c[begin:] for n, c in columns.items()})
        rows += batch.num_rows - begin
    if rows:
        yield {n: np.concatenate([h[n] for h in held]) for n in names}


def shard_nodes(lengths: DataFrame, rows: DataFrame, long: int, most_conversations: int, most_rows: int) -> DataFrame:
    """The nodes of every shard down to `long` turns, and the conversations that go deeper."""
    openings = lengths.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("za"),
                              F.lit(0).cast("bigint").alias("zb"), F.col("length").alias("bytes"))

    def walk(stream):
        part = TaskContext.get().partitionId()
        for number, block in enumerate(_cut(stream, most_conversations, most_rows)):
            yield from _shard_nodes(block, part << 32 | number, long)

    units = rows.where(F.col("depth") <= long).unionByName(openings)
    # Conversations deeper than the bitsets hold end nowhere in them.
    return units.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(walk, _NODES_SQL)


def _exclusive_or(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _running(
    rows: DataFrame, columns: dict[str, str], total: Callable[[str], Column], join: Callable[[Column, Column], Column], block: int,
    backward: bool = False,
) -> DataFrame:
    """Adds running totals along each conversation's depths: new column by column that is totalled.

    Two levels: within blocks of positions, and over the blocks' totals.
    """
    blocked = rows.withColumn("_block", F.call_function("div", F.col("depth"), F.lit(block)))
    in_block, of_blocks = (F.col(c).desc() if backward else F.col(c).asc() for c in ("depth", "_block"))
    totals = blocked.groupBy("conv_id", "_block").agg(*(total(c).alias(f"_{n}") for n, c in columns.items()))
    earlier = Window.partitionBy("conv_id").orderBy(of_blocks).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "_block", *(F.coalesce(total(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in columns))
    inside = Window.partitionBy("conv_id", "_block").orderBy(in_block).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumns({n: total(c).over(inside) for n, c in columns.items()}).join(before, ["conv_id", "_block"])
    return summed.withColumns({n: join(F.col(n), F.col(f"_{n}")) for n in columns}).drop("_block", *(f"_{n}" for n in columns))


def _added_up(shard: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes with the sums of their subtrees and their parents' smallest conversation."""
    shard = shard.sort_values("node")
    parents, reps = shard["parent"].tolist(), shard["rep"].tolist()
    leaves, saved = shard["leaves"].tolist(), shard["saved"].tolist()
    for i in range(len(parents) - 1, 0, -1):
        leaves[parents[i]] += leaves[i]
        saved[parents[i]] += saved[i]
    above = pd.array([reps[p] if p >= 0 else None for p in parents], dtype="Int64")
    return shard[KEY].assign(parent_conv_id=above, n_leaves=leaves, saved_tokens=saved)


def _ends(stream):
    """(key, sha256) of each node's ending conversations, hashed as they stream by in order."""
    key, sha = None, None
    for batch in stream:
        done = []
        for *new, ends in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ends"))):
            if new != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = new, hashlib.sha256(ends.encode())
            else:
                sha.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*KEY, "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, sha.hexdigest())], [*KEY, "ends_sha256"])


def _deep_rows(lengths: DataFrame, rows: DataFrame, long: int, block: int) -> DataFrame:
    """The turns beyond `long` of longer conversations, with the keys of their nodes and of these nodes' parents."""
    longer = lengths.where(F.col("length") > long)
    keyed = _running(rows.join(longer, "conv_id"), {"ka": "za", "kb": "zb"}, F.bit_xor, _exclusive_or, block)
    return written(keyed.where(F.col("depth") > long).withColumns({
        "pa": F.col("ka").bitwiseXOR(F.col("za")), "pb": F.col("kb").bitwiseXOR(F.col("zb"))}), "deep-turns")


def trie(conversations: DataFrame, long: int = LONG, most_conversations: int = SHARD_CONVERSATIONS, most_rows: int = SHARD_ROWS,
         block: int = LONG) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    `conv_id` (smallest member), `depth`, `parent_conv_id` (the parent's
    smallest member; null for the root), `n_convs`, `n_children`, `n_leaves`
    (childless nodes of the subtree), `saved_tokens` (over the subtree, members
    but one times the UTF-8 bytes of the node's last text) and `ends_sha256`
    (of the ids that end at the node, ascending, joined by commas). Extra
    columns take no part; see `turns` for nulls, ties and repeats. No
    conversation, no row. Prefixes are told apart by 128-bit keys. The list of
    a node's ends is hashed in one stream, as SHA-256 must be, from a row per
    shard.
    """
    lengths, rows = rebuilt(turns(conversations))
    shards = written(shard_nodes(lengths, rows, long, most_conversations, most_rows), "shard-nodes")
    parts = [shards.select(*KEY, "pa", "pb", "conv_id", "n", "bytes")]
    ends = [shards.where("ends IS NOT NULL").select(*KEY, "first_end", "ends")]
    deep = None
    if not lengths.where(F.col("length") > long).isEmpty():
        deep = _deep_rows(lengths, rows, long, block)
        parts.append(deep.select(*KEY, "pa", "pb", "conv_id", F.lit(1).cast("bigint").alias("n"), "bytes"))
        ends.append(deep.where("depth = length").select(*KEY, F.col("conv_id").alias("first_end"), F.col("conv_id").cast("string").alias("ends")))

    def union(tables: list[DataFrame]) -> DataFrame:
        return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])

    nodes = written(union(parts).groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb")), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
        F.count(F.lit(1)).alias("n_children"))
    tree = written(nodes.join(children, KEY, "left").select(
        *KEY, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "pa", "pb"), "tree")
    known = tree.select(*KEY, F.col("conv_id").alias("rep"), "n_children", "saved")
    mine = F.col("conv_id") == F.col("rep")
    own = {"leaves": F.when(mine & (F.col("n_children") == 0), 1).otherwise(0).cast("bigint"),
           "saved": F.when(mine, F.col("saved")).otherwise(0).cast("bigint")}

    placed_nodes = shards.select("shard", "node", "parent", *KEY, "conv_id").join(known, KEY).withColumns(own)
    sums = []
    if deep is not None:
        along = written(deep.select(*KEY, "conv_id").join(known, KEY).withColumns(own), "deep-figures")
        below = _running(along, {"n_leaves": "leaves", "saved_tokens": "saved"}, F.sum, _plus, block, backward=True)
        parents = tree.where(F.col("depth") > long).select(*KEY, "pa", "pb").join(
            tree.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id")),
            ["depth", "pa", "pb"]).select(*KEY, "parent_conv_id")
        sums.append(below.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).join(
            parents, KEY).select(*KEY, "parent_conv_id", "n_leaves", "saved_tokens"))
        tails = along.groupBy("conv_id").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        carried = shards.where("deeper IS NOT NULL").select("shard", "node", F.explode("deeper").alias("conv_id")).join(tails, "conv_id").groupBy(
            "shard", "node").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        placed_nodes = placed_nodes.join(carried, ["shard", "node"], "left").withColumns({
            "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
    added = placed_nodes.select("shard", "node", "parent", *KEY, "rep", "leaves", "saved").groupBy("shard").applyInPandas(
        _added_up, "depth bigint, ka bigint, kb bigint, parent_conv_id bigint, n_leaves bigint, saved_tokens bigint")
    sums.insert(0, added.groupBy(*KEY).agg(
        F.min("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    hashes = union(ends).repartition(*KEY).sortWithinPartitions(*KEY, "first_end").mapInArrow(
        _ends, "depth bigint, ka bigint, kb bigint, ends_sha256 string")
    return tree.join(union(sums), KEY).join(hashes, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
