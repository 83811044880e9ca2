"""A Merkle manifest of a dataset: a leaf per document, a tree per source, a tree over the sources.

Nodes of a tree are cut into superblocks of 4,096 consecutive ones, three levels
of sixteen. Going up, every superblock is reduced to one node by itself. Going
down, the nodes of a superblock are cogrouped with the one row that holds what
lies outside of it: the siblings along the way from the superblock to the root.
That group finishes the levels inside, joins the proofs and folds changed leaves
to the root. A source of any size is many superblocks; none of them is larger
than its 4,096 nodes, and the rows outside are one per superblock.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.llm.common import written
from tickettide.llm.ranking import PLACE, placed

FANOUT = 16
#: Levels in a superblock.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """SHA-256 over the document's encoded fields, with this as its text."""
    columns = [encoded(F.col(name)) for name in FIELDS if name != "text"]
    return F.unhex(F.sha2(F.concat(*columns, encoded(text)).cast("binary"), 256))


def tampered() -> Column:
    """Whether the document is one whose copy is changed: its id's CRC-32 is divisible by five. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowered() -> Column:
    return F.translate(F.col("text"), UPPER, LOWER)


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], complete: bool, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of each level of a superblock: all of its levels, or up to where one node remains."""
    rows = [nodes]
    while (len(rows) <= levels) if complete else len(rows[-1]) > 1:
        below = rows[-1]
        rows.append([_h(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return rows


def _complete(place: int, n: int, fanout: int, levels: int) -> bool:
    """Whether all levels apply: a superblock after the first, or a full one, of which three levels leave one node."""
    return place > 0 or n == fanout ** levels


def _reduced(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, place, node): each superblock's node, with its place among its tree's superblocks."""

    def reduce(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        rows = _levels([b.hex() for b in group["node"]], _complete(key[1], len(group), fanout, levels), fanout, levels)
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "node": [bytes.fromhex(rows[-1][0])]})

    block = F.call_function("div", F.col("place"), F.lit(fanout ** levels)).alias("block")
    return nodes.select("tree", "place", "node").groupBy("tree", block).applyInPandas(
        reduce, "tree string, place bigint, node binary")


def _trees(nodes: DataFrame, purpose: str, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes, their superblocks' nodes and so on, until every tree is down to one."""
    tables = [nodes]
    while not tables[-1].where("place > 0").isEmpty():
        tables.append(written(_reduced(tables[-1], fanout, levels), purpose))
    return tables


#: What lies outside a superblock: siblings left and right of its path to the root, a level after another.
_OUTSIDE = "tree string, place bigint, lefts array<string>, rights array<string>, subroot string, root string"


def _paths(rows: list[list[str]], i: int, fanout: int) -> tuple[list[str], list[str]]:
    """The siblings left and right of node i and of the nodes over it, joined per level."""
    lefts, rights = [], []
    for level in rows[:-1]:
        start = i - i % fanout
        lefts.append("".join(level[start:i]))
        rights.append("".join(level[i + 1:start + fanout]))
        i //= fanout
    return lefts, rights


def _folded(node: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        node = _h([left, node, right])
    return node


def _outer(outer: pd.DataFrame) -> tuple[list[str], list[str], str | None, str | None]:
    if not len(outer):
        return [], [], None, None
    row = outer.iloc[0]
    return list(row["lefts"]), list(row["rights"]), row["subroot"], row["root"]


def _cogrouped(nodes: DataFrame, outside: DataFrame, fanout: int, levels: int):
    """The nodes of each superblock beside the row of what lies outside of it."""
    block = F.call_function("div", F.col("place"), F.lit(fanout ** levels)).alias("block")
    return nodes.groupBy("tree", block).cogroup(outside.groupBy("tree", F.col("place").alias("block")))


def _spread(nodes: DataFrame, outside: DataFrame, fanout: int, levels: int) -> DataFrame:
    """What lies outside each node, from what lies outside its superblock."""

    def spread(key: tuple, group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        rows = _levels([b.hex() for b in group["node"]], _complete(key[1], len(group), fanout, levels), fanout, levels)
        lefts, rights, subroot, root = _outer(outer)
        found = []
        for i, place in enumerate(group["place"]):
            left, right = _paths(rows, i, fanout)
            found.append((key[0], place, left + lefts, right + rights, subroot, root))
        return pd.DataFrame(found, columns=["tree", "place", "lefts", "rights", "subroot", "root"])

    return _cogrouped(nodes, outside, fanout, levels).applyInPandas(spread, _OUTSIDE)


def _source_outsides(subroots: DataFrame, fanout: int, levels: int) -> DataFrame:
    """For every source what lies outside its subroot, with subroot and root themselves.

    Sources are ordered null first, then by their UTF-8 bytes; there is a row
    for each of them, and the same superblocks as anywhere else.
    """
    ranked = placed(subroots, [], ["_null_last", "source"], "sources")
    nodes = written(ranked.select(F.lit("sources").alias("tree"), (F.col(PLACE) - 1).alias("place"), "node",
                                  F.col("tree").alias("_tree")), "subroots")
    tables = _trees(nodes.drop("_tree"), "source-nodes", fanout, levels)
    outside = subroots.sparkSession.createDataFrame([], _OUTSIDE)
    for table in reversed(tables):
        outside = written(_spread(table, outside, fanout, levels), "source-outside")

    def finished(batches):
        for rows in batches:
            yield rows.assign(
                root=[_folded(n, left, right) for n, left, right in zip(rows["subroot"], rows["lefts"], rows["rights"])])

    named = nodes.join(outside.select("place", "lefts", "rights"), "place").select(
        F.col("_tree").alias("tree"), F.lit(0).cast("bigint").alias("place"), "lefts", "rights",
        F.lower(F.hex("node")).alias("subroot"), F.lit(None).cast("string").alias("root"))
    return written(named.mapInPandas(finished, _OUTSIDE), "source-outside")


def manifest(documents: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of the document's five fields; extra columns take no
    part. Leaves of a source ascend by doc_id, null first; documents sharing an
    id are ordered by their leaves, and equal ones are interchangeable. A null
    source is a source of its own. `folded_root` is what the leaf of the
    changed copy (see `tampered`), else the leaf itself, gives with the
    original siblings; `verified` says whether it is the root. An empty table
    has no rows. Texts are hashed where they are read and never shuffled.
    """
    source = F.col("source").cast("string")
    changed = F.when(tampered() & F.col("text").isNotNull(), leaf(lowered()))
    hashed = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"), encoded(source).alias("tree"),
        source.isNotNull().alias("_null_last"), leaf(F.col("text")).alias("node"), changed.alias("changed"))
    leaves = written(hashed.withColumn("changed", F.when(F.col("changed") != F.col("node"), F.col("changed"))), "leaves")
    ranked = placed(leaves.select("tree", "doc_id", "node", "changed"), ["tree"], ["doc_id", "node"], "ranked-leaves")
    nodes = ranked.withColumn("place", F.col(PLACE) - 1).drop(PLACE)
    tables = _trees(nodes.select("tree", "place", "node"), "nodes", fanout, levels)
    names = leaves.groupBy("tree").agg(F.max("source").alias("source"), F.max("_null_last").alias("_null_last"))
    outside = _source_outsides(tables[-1].select("tree", "node").join(names, "tree"), fanout, levels)
    for table in reversed(tables[1:]):
        outside = written(_spread(table, outside, fanout, levels), "outside")

    def finish(key: tuple, group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        rows = _levels([b.hex() for b in group["node"]], _complete(key[1], len(group), fanout, levels), fanout, levels)
        outer_left, outer_right, subroot, root = _outer(outer)
        around = "".join(left + right for left, right in zip(outer_left, outer_right))
        # What a node of the superblock folds to; unchanged leaves all meet in one.
        above, found = {}, []
        for i, (doc_id, own, new) in enumerate(zip(group["doc_id"], rows[0], group["changed"])):
            lefts, rights = _paths(rows, i, fanout)
            proof = _h([left + right for left, right in zip(lefts, rights)] + [around])
            inside = _folded(own if new is None else new.hex(), lefts, rights)
            if inside not in above:
                above[inside] = _folded(inside, outer_left, outer_right)
            folded = above[inside]
            found.append((doc_id, own, subroot, root, proof, folded, folded == root))
        return pd.DataFrame(found, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    # As text, an id beside a null one keeps all of its digits in pandas.
    texts = nodes.withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = _cogrouped(texts, outside, fanout, levels).applyInPandas(
        finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
