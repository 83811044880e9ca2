"""The trie against a plain one in dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tickettide.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    found = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        found.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                      hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-12, 3 * n), n):
        for t in range(rng.randrange(1, longest)):
            text = "start" if t == 0 and c % 3 else f"é{rng.randrange(2)}" * rng.randrange(3)
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", text))
    # A copied conversation, ties, repeats, nulls, and rows of no conversation.
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(60) for t in range(6)]
    rows += [(5000, None, "b", "x"), (5000, None, "a", "y"), (5000, None, "a", None), (5000, 3, None, "x"), (5000, 3, None, "x"),
             (None, 1, "user", "nobody"), (None, None, None, None), (5001, 1, None, None), (5002, 1, "", ""), (5003, 1, "a\0", "b"), (5004, 1, "a", "\0b"),
             (7000, 1, "user", "long " * 5000), (2 ** 60, 1, "user", "start")]
    rng.shuffle(rows)
    return rows


def result(frame, **options):
    return sorted((tuple(r) for r in prefix_trie.trie(frame, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [
    {}, {"most_conversations": 7}, {"long": 3, "block": 2, "most_conversations": 9, "most_rows": 40},
    {"long": 1, "block": 3}, {"most_rows": 1},
])
def test_equals_a_plain_trie(spark, options):
    rows = conversations(3, 80, 12)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in (
        "depth", "ka", "kb", "said", "head", "digest", "bytes", "base", "taken", "length", "n", "node", "shard", "_place", "_part")})
    assert result(frame, **options) == plain_trie(rows)


def test_a_conversation_of_many_turns(spark):
    rows = [(c, t, "user", f"t{t % 7 if t < 150 else t % 7 + c}") for c in (10, 12) for t in range(200)] + [(11, t, "user", f"t{t % 7}") for t in range(20)]
    assert result(spark.createDataFrame(rows, SCHEMA), long=20, block=16) == plain_trie(rows)


def test_no_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(empty) == []
    assert result(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
