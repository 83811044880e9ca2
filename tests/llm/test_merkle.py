"""The manifest against a plain Merkle tree built on one list."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tickettide.llm import merkle
from tickettide.llm.ranking import PLACE, placed


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h("".join(rows[-1][i:i + fanout])) for i in range(0, len(rows[-1]), fanout)])
    return rows


def way(rows, i, fanout):
    """(left siblings, right siblings) at every level."""
    found = []
    for level in rows[:-1]:
        start = i // fanout * fanout
        found.append(("".join(level[start:i]), "".join(level[i + 1:start + fanout])))
        i //= fanout
    return found


def plain_manifest(rows, fanout):
    def leaf(row, text):
        return h("".join(map(enc, (row[0], row[3], row[2], row[4], text))))

    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in sources[s]], fanout)
    top = tree([trees[s][-1][0] for s in order], fanout)
    found = []
    for k, s in enumerate(order):
        for i, row in enumerate(sources[s]):
            path = way(trees[s], i, fanout) + way(top, k, fanout)
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(row, text)
            for left, right in path:
                node = h(left + node + right)
            root = top[-1][0]
            found.append((row[0], leaf(row, row[1]), trees[s][-1][0], root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(found, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 9_007_199_254_740_993


def corpus(n, sources):
    rows = [(i * 7 % n, f"Text {i} ÄÖ" + "x" * (i % 5), "en" if i % 3 else None, sources[min(i % 9, len(sources) - 1)], i if i % 4 else None)
            for i in range(n)]
    return rows + [(BIG, "Big", "en", "a", 1), (BIG + 1, "Big Too", "en", "a", 1), (None, "No Id", "en", "a", 1), (None, None, None, None, None),
                   (5, None, "de", "a", 3), (5, "", "de", "a", 3), (5, "SAME", "de", "a", 3), (5, "SAME", "de", "a", 3)]


@pytest.mark.parametrize("n, sources, fanout, levels", [
    (300, ["a"], 2, 2), (300, ["a", None, "", "é", "b"], 3, 2), (150, ["a", "b"], 16, 3), (40, [f"s{i}" for i in range(9)], 2, 1),
])
def test_equals_a_plain_tree(spark, clashing, n, sources, fanout, levels):
    rows = corpus(n, sources)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    extra = clashing(frame).withColumns({c: F.lit("x") for c in ("tree", "place", "node", "changed", "root", "block")})
    got = sorted((tuple(r) for r in merkle.manifest(extra, fanout, levels).collect()), key=repr)
    assert got == plain_manifest(rows, fanout)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(3, "T", "en", "a", 1)], SCHEMA)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h("") and row.verified
    assert merkle.manifest(one.limit(0)).count() == 0


def test_more_sources_than_a_superblock(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 40}", 1) for i in range(90)]
    got = sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), 2, 2).collect()), key=repr)
    assert got == plain_manifest(rows, 2)


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_places_over_range_partitions(spark, partitions):
    """A group larger than a partition, groups that end inside one, null groups and ties."""
    rows = [(g, i * 17 % n) for g, n in (("hot", 500), ("a", 3), (None, 90), ("z", 1), ("m", 40)) for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = placed(spark.createDataFrame(rows, "g string, v long"), ["g"], ["v"], "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_group = {}
    for r in got:
        by_group.setdefault(r.g, []).append((r.v, r[PLACE]))
    assert len(got) == len(rows)
    for g, pairs in by_group.items():
        assert [p for _, p in sorted(pairs)] == list(range(1, len(pairs) + 1))
