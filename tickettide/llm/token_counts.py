"""Token counts that follow edits without encoding whole texts again.

A text's pre-tokens (the pieces the tokenizer never merges across) are put in
leaves of a segment tree: a leaf keeps its length, its pre-tokens and its
tokens, an inner node the sums below it. An edit finds its leaf through the
sums. From a boundary safely before the edit, pre-tokens are cut again until
they meet an old boundary behind it; since cutting looks only ahead, all that
follows is as before. The leaves in between are replaced and sums above them
updated.

Everything is narrow: a document's tree and edits are columns of its row, so
nothing is shuffled, and a task keeps one tree and a bounded cache of pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: The vocabulary: lines of a piece in base64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer cuts pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How many characters behind a pre-token its cut can depend on, at most.
LOOK_AHEAD = 3
LEAF = 64
#: Pieces whose counts a worker remembers.
CACHE = 400_000
_PIECE = regex.compile(PATTERN)
_COUNTERS: dict[str, Callable[[str], int]] = {}


def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """Tokens of a pre-token; one per worker and vocabulary, with a bounded memory."""
    if vocabulary not in _COUNTERS:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        known: dict[str, int] = {}

        def count(piece: str) -> int:
            n = known.get(piece)
            if n is None:
                n = len(encoding.encode_ordinary(piece))
                if len(known) >= CACHE:
                    known.clear()
                known[piece] = n
            return n

        _COUNTERS[vocabulary] = count
    return _COUNTERS[vocabulary]


class Tree:
    """A balanced tree over leaves (characters, pre-tokens, tokens), sums in an array."""

    def __init__(self, leaves: list[tuple[int, int, int]]):
        self.size = 1
        while self.size < max(1, len(leaves)):
            self.size *= 2
        self.sums = np.zeros((2 * self.size, 3), np.int64)
        self.used = len(leaves)
        if leaves:
            self.sums[self.size : self.size + len(leaves)] = leaves
        width = self.size
        while width > 1:
            width //= 2
            self.sums[width : 2 * width] = self.sums[2 * width : 4 * width : 2] + self.sums[2 * width + 1 : 4 * width : 2]

    @property
    def total(self) -> tuple[int, int, int]:
        return tuple(int(x) for x in self.sums[1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before it; behind the end, the last leaf."""
        node, before = 1, 0
        place = min(place, max(int(self.sums[1, 0]) - 1, 0))
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if place < before + left:
                node = 2 * node
            else:
                node, before = 2 * node + 1, before + left
        return node - self.size, before

    def put(self, leaf: int, values: tuple[int, int, int]) -> None:
        node = leaf + self.size
        change = np.array(values) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def leaves(self) -> list[tuple[int, int, int]]:
        return [tuple(int(x) for x in row) for row in self.sums[self.size : self.size + self.used]]


def cut(text: str, count: Callable[[str], int], leaf: int = LEAF) -> list[tuple[int, int, int]]:
    """The leaves of a text: at most `leaf` pre-tokens each."""
    leaves = []
    pieces = _PIECE.findall(text)
    for i in range(0, len(pieces), leaf):
        some = pieces[i : i + leaf]
        leaves.append((sum(map(len, some)), len(some), sum(map(count, some))))
    return leaves


def edit(tree: Tree, text: str, first: int, last: int, new: str, count: Callable[[str], int], leaf: int = LEAF) -> tuple[Tree, str, int]:
    """(tree, text, pre-tokens cut again) after characters [first, last) become `new`.

    Old leaves between the restart and the first old leaf boundary behind the
    edit that is a boundary again are replaced. As many leaves as before are
    updated in place; a different number makes a new tree from the sums.
    """
    after = text[:first] + new + text[last:]
    if not tree.total[0]:
        made = cut(after, count, leaf)
        return Tree(made), after, sum(n for _, n, _ in made)
    shift = len(new) - (last - first)
    start_leaf, start = tree.find(max(0, first - LOOK_AHEAD))
    if start_leaf and start > first - LOOK_AHEAD - 1:
        # The piece before may look into the edit.
        start_leaf -= 1
        start -= int(tree.sums[tree.size + start_leaf, 0])
    end_leaf, before = tree.find(last)
    end = before + int(tree.sums[tree.size + end_leaf, 0])
    made: list[tuple[int, int, int]] = []
    chars = pieces = tokens = again = 0
    at = start
    while at < len(after):
        piece = _PIECE.match(after, at)
        at = piece.end()
        chars, pieces, tokens, again = chars + at - piece.start(), pieces + 1, tokens + count(piece[0]), again + 1
        while end + shift < at and end_leaf + 1 < tree.used:
            end_leaf += 1
            end += int(tree.sums[tree.size + end_leaf, 0])
        met = at == end + shift and end >= last
        if met or pieces == leaf:
            made.append((chars, pieces, tokens))
            chars = pieces = tokens = 0
        if met:
            break
    if pieces:
        made.append((chars, pieces, tokens))
    if at >= len(after):
        end_leaf = tree.used - 1
    if len(made) == end_leaf + 1 - start_leaf:
        for i, values in enumerate(made):
            tree.put(start_leaf + i, values)
        return tree, after, again
    own = tree.leaves()
    return Tree(own[:start_leaf] + made + own[end_leaf + 1 :]), after, again


_LEAVES = ArrayType(StructType([StructField("chars", LongType()), StructField("pieces", LongType()), StructField("tokens", LongType())]))
_LEAF_TYPE = pa.list_(pa.struct([("chars", pa.int64()), ("pieces", pa.int64()), ("tokens", pa.int64())]))


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def with_trees(documents: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """The documents with `_leaves`, the leaves of each text's tree. Null and empty texts have none."""
    documents = documents.drop("_leaves")
    names = documents.schema.fieldNames()

    def run(stream):
        count = counter(vocabulary)
        for batch in stream:
            made = [[dict(zip(("chars", "pieces", "tokens"), x)) for x in cut(t, count, leaf)] for t in _texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, _LEAF_TYPE)], [*names, "_leaves"])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField("_leaves", _LEAVES)]))


def tokens_of(leaves: str = "_leaves") -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + x["tokens"])


def apply_edits(documents: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Documents (text, _leaves, edits) with text and _leaves after the edits, and `_again`,
    the pre-tokens that were cut again.

    `edits` is an array of structs (first, last, new): character places in the
    text as it was, not overlapping, in any order; they are applied from the
    last to the first. A null or empty array leaves the row as it is. A place
    beyond the text counts as its end; a null `new` deletes.
    """
    documents = documents.drop("_again")
    names = documents.schema.fieldNames()

    def run(stream):
        count = counter(vocabulary)
        for batch in stream:
            texts, trees, agains = [], [], []
            for text, leaves, edits in zip(batch.column("text").to_pylist(), batch.column("_leaves").to_pylist(), batch.column("edits").to_pylist()):
                again = 0
                if edits:
                    text = text or ""
                    tree = Tree([(x["chars"], x["pieces"], x["tokens"]) for x in leaves or []])
                    for e in sorted(edits, key=lambda e: (e["first"], e["last"]), reverse=True):
                        first, last = min(e["first"], len(text)), min(e["last"], len(text))
                        tree, text, n = edit(tree, text, first, max(first, last), e["new"] or "", count, leaf)
                        again += n
                    leaves = [dict(zip(("chars", "pieces", "tokens"), x)) for x in tree.leaves()]
                texts.append(text)
                trees.append(leaves)
                agains.append(again)
            columns = dict(zip(names, batch.columns)) | {
                "text": pa.array(texts, batch.column("text").type), "_leaves": pa.array(trees, _LEAF_TYPE)}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(agains, pa.int64())], [*names, "_again"])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField("_again", LongType())]))


#: What the registered query edits out: e-mail addresses, addresses of machines, long digit and hex runs.
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{32,}\b|\b\d{9,}\b"
MASK = "[removed]"


def with_masking_edits(documents: DataFrame, pattern: str = PERSONAL, mask: str = MASK) -> DataFrame:
    """The documents with `edits` that replace every match of a pattern in their text."""
    documents = documents.drop("edits")
    names = documents.schema.fieldNames()
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("new", pa.string())]))

    def run(stream):
        search = regex.compile(pattern)
        for batch in stream:
            made = [[{"first": m.start(), "last": m.end(), "new": mask} for m in search.finditer(t)] for t in _texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*names, "edits"])

    schema = StructType([*documents.schema.fields, *StructType.fromDDL("edits array<struct<first:bigint,last:bigint,new:string>>").fields])
    return documents.mapInArrow(run, schema)


def edited_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_edits, n_before, n_tokens, n_pieces, n_again): token counts before and after
    personal data is masked, the pre-tokens of the new text, and how many of them were cut again.

    A row per row: repeated rows repeat, shared and null ids need no rule. Null
    texts are empty and have no tokens. An empty table gives an empty one.
    """
    rows = with_masking_edits(with_trees(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), vocabulary))
    before = rows.withColumn("n_before", tokens_of()).withColumn("n_edits", F.size("edits").cast("long"))
    return apply_edits(before, vocabulary).select(
        "doc_id", "n_edits", "n_before", tokens_of().alias("n_tokens"),
        F.aggregate("_leaves", F.lit(0).cast("long"), lambda n, x: n + x["pieces"]).alias("n_pieces"), F.col("_again").alias("n_again"))
