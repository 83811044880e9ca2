"""Near duplicates by SimHash: links within a Hamming radius through half-radius balls.

Every fingerprint emits all its variants within half the radius. Two
fingerprints within the radius share a variant halfway, so what meets on a
variant holds every link; and what meets there is no farther apart than the
radius, so one star per variant holds the same components as all pairs.

Variants are shuffled by their leading bits alone: the flips there are made
before the shuffle, those of the remaining bits after it, next to the
collision. That sends 137 rows a fingerprint instead of 2,081. Leading values
where many rows would meet take 24 further bits, decided from exact counts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.llm.common import batches, components, popcount, signed, text_bytes, written

RADIUS = 4
WORDS = 4
SEED = 42
#: Leading bits that variants are dealt out by, at least; more fingerprints take more.
LEAD_BITS = 16
MORE_BITS = 24
#: Rows meeting at one leading value, on average, beyond which a bit is added; values out of line are split further.
HOT_ROWS = 20_000
#: Variants made at once in a task.
BLOCK = 4_000_000
_CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text: words between ASCII white space, A-Z lower-cased,
    shingles with repeats; fewer words give one shingle, none give zero."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = min(words, len(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        hashes = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])), np.dtype("<u8"))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document, the fingerprint's bits as a signed long.

    A null text counts as empty, whose fingerprint is zero. `text_hash` tells
    rows that share an id apart.
    """

    def each(batch):
        made = np.array([fingerprint(x, words, seed) for x in batch.column(2).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(signed(made))], ["doc_id", "text_hash", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), text_bytes().alias("text"))
    return batches(rows, each, "doc_id long, text_hash long, fp long")


def _text_hash() -> Column:
    return F.xxhash64(text_bytes())


def masks(bits: int, most: int, shift: int = 0) -> np.ndarray:
    """All masks of at most so many of the bits, fewest first."""
    chosen = [sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(bits), n)]
    return np.array(chosen, np.uint64) << np.uint64(shift)


def lead_bits(fingerprints_: int, flips: int, hot_rows: int = HOT_ROWS) -> int:
    """Leading bits for so many fingerprints: a bit more for each doubling, so that as many rows meet at a value.

    Rows per fingerprint grow with the square of that: 137 up to nine million
    fingerprints, 172 at thirty, 211 at a hundred, 301 at one and a half billion.
    """
    bits = LEAD_BITS
    while bits < 64 - MORE_BITS and fingerprints_ * len(masks(bits, flips)) > hot_rows << bits:
        bits += 1
    return bits


def links(distinct: DataFrame, radius: int = RADIUS, hot_rows: int = HOT_ROWS, bits: int | None = None) -> DataFrame:
    """(src, dst): links among distinct fingerprints `fp` with the components of all
    pairs within the radius. Each row is a verified pair; no pair is emitted twice.

    `bits` are the leading bits, by default as many as the fingerprints need.
    """
    half, other = radius // 2, radius - radius // 2
    flips = max(half, other)
    lead = F.shiftrightunsigned("fp", 64 - LEAD_BITS).cast("int")
    counts = np.zeros(1 << LEAD_BITS, np.int64)
    for row in distinct.groupBy(lead.alias("lead")).count().collect():  # 65,536 rows at most
        counts[row["lead"]] = row["count"]
    width = bits or lead_bits(int(counts.sum()), flips, hot_rows)
    values = np.arange(1 << LEAD_BITS)
    arriving = sum(counts[values ^ int(m)] for m in masks(LEAD_BITS, flips))
    hot = arriving > hot_rows << (width - LEAD_BITS)

    def spread(batch):
        fps = batch.column(0).to_numpy().view(np.uint64)
        shift, coarse = np.uint64(64 - width), np.uint64(width - LEAD_BITS)
        for mask in masks(width, flips):
            keys = (fps >> shift) ^ mask
            split = hot[(keys >> coarse).astype(np.int64)]
            plain = ~split
            if plain.any():
                yield _sent(keys[plain], width, fps[plain])
            if split.any():
                rest = flips - int(popcount(mask))
                narrow = np.uint64(64 - width - MORE_BITS)
                long_keys = (fps[split] >> narrow) ^ (mask << np.uint64(MORE_BITS))
                for more in masks(MORE_BITS, rest):
                    yield _sent(long_keys ^ more, width + MORE_BITS, fps[split])

    def meet(stream):
        carried = None
        for batch in stream:  # sorted by key: a key's rows are together
            table = np.stack([batch.column(i).to_numpy() for i in range(3)]) if batch.num_rows else np.zeros((3, 0), np.int64)
            if carried is not None:
                table = np.concatenate([carried, table], axis=1)
            if not table.shape[1]:
                continue
            last = (table[0] == table[0, -1]) & (table[1] == table[1, -1])
            done, carried = table[:, ~last], table[:, last]
            yield from _collide(done, flips, radius)
        if carried is not None:
            yield from _collide(carried, flips, radius)

    sent = batches(distinct.select("fp"), spread, "bits long, lead long, fp long")
    met = sent.repartition(*_keys(distinct)).sortWithinPartitions("bits", "lead").mapInArrow(meet, "src long, dst long")
    return met.distinct()


def _keys(rows: DataFrame) -> tuple:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bits", "lead"


def _sent(keys: np.ndarray, bits: int, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), bits, np.int64)), pa.array(signed(keys)), pa.array(signed(fps))], ["bits", "lead", "fp"])


def _collide(table: np.ndarray, flips: int, radius: int):
    """Links among the rows (bits, lead, fp) of whole keys."""
    if table.shape[1] < 2:
        return
    new = np.flatnonzero(np.any(table[:2, 1:] != table[:2, :-1], axis=0)) + 1
    first = np.concatenate([[0], new])
    sizes = np.diff(np.concatenate([first, [table.shape[1]]]))
    keep = np.repeat(sizes > 1, sizes)
    bits, lead, fps = table[0][keep], table[1][keep].view(np.uint64), table[2][keep].view(np.uint64)
    group = np.repeat(np.arange(int((sizes > 1).sum())), sizes[sizes > 1])
    for width in np.unique(bits):
        chosen = bits == width
        yield from _collide_width(int(width), lead[chosen], fps[chosen], group[chosen], flips, radius)


def _collide_width(width: int, lead, fps, group, flips: int, radius: int):
    low = 64 - width
    spent = popcount((fps >> np.uint64(low)) ^ lead).astype(np.int64)
    ball = [len(masks(low, flips - s)) if s <= flips else 0 for s in range(flips + 1)]
    weight = np.array(ball)[spent]
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    per_group = np.add.reduceat(weight, edges[:-1]) if len(group) else np.zeros(0, np.int64)
    for a, b in _runs(per_group):
        i, j = edges[a], edges[b]
        # A single key beyond the block is met in passes over the low bits of its variants.
        passes = 1
        while per_group[a:b].sum() / passes > BLOCK and passes < 1 << min(low, 20):
            passes *= 2
        for part in range(passes):
            made, owner = _variants(lead[i:j], fps[i:j], spent[i:j], low, flips, passes, part)
            found = _stars(made, owner)
            if len(found):
                a_, b_ = found[:, 0], found[:, 1]
                near = popcount(a_ ^ b_) <= radius
                yield pa.RecordBatch.from_arrays([pa.array(signed(a_[near])), pa.array(signed(b_[near]))], ["src", "dst"])


def _runs(weights: np.ndarray):
    first, total = 0, 0
    for i, w in enumerate(weights.tolist()):
        if i > first and total + w > BLOCK:
            yield first, i
            first, total = i, 0
        total += w
    if first < len(weights):
        yield first, len(weights)


def _variants(lead, fps, spent, low: int, flips: int, passes: int, part: int):
    """(variant, fingerprint) of the rows, those whose low bits fall into the pass."""
    base = (lead << np.uint64(low)) | (fps & np.uint64((1 << low) - 1))
    made, owner = [], []
    for s in range(flips + 1):
        rows = spent == s
        if not rows.any():
            continue
        some, own = base[rows], fps[rows]
        if passes == 1:
            all_masks = masks(low, flips - s)
            made.append((some[:, None] ^ all_masks[None, :]).ravel())
            owner.append(np.repeat(own, len(all_masks)))
            continue
        for mask in masks(low, flips - s):
            variants = some ^ mask
            inside = variants & np.uint64(passes - 1) == np.uint64(part)
            made.append(variants[inside])
            owner.append(own[inside])
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(made), np.concatenate(owner)


def _stars(made: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct pairs (fingerprint, first fingerprint) of the fingerprints that share a variant."""
    order = np.argsort(made, kind="stable")
    made, owner = made[order], owner[order]
    same = np.zeros(len(made), bool)
    same[1:] = made[1:] == made[:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    made, owner, same = made[shared], owner[shared], same[shared]
    if not len(made):
        return np.zeros((0, 2), np.uint64)
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(owner.view(np.int64), starts).view(np.uint64)
    least = np.repeat(least, np.diff(np.concatenate([starts, [len(made)]])))
    pairs = np.stack([owner, least], axis=1)[owner != least]
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _classes(documents: DataFrame, radius: int, words: int, seed: int, hot_rows: int) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every document, and its group's least row as `least`."""
    prints = written(fingerprints(documents, words, seed), "simhash-prints")
    row = F.struct("doc_id", "text_hash")
    distinct = written(prints.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), row)).alias("first")), "simhash-distinct")
    linked = components(links(distinct.select("fp"), radius, hot_rows), "simhash")
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    by_print = written(rooted.join(least, "root").select("fp", "least"), "simhash-classes")
    return prints.join(by_print, "fp").withColumn("component_id", F.col("least.doc_id"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): every document with its near-duplicate group.

    component_id is the smallest doc_id among all documents reachable through
    links of at most `radius` differing bits, the document itself included.
    Documents with equal fingerprints, empty and null texts among them, are one
    group. Repeated rows stay repeated. A null doc_id keeps its row and never is
    the smallest; a group of null ids only has a null component. Other columns
    are not read. An empty table gives no rows.
    """
    return _classes(documents, radius, words, seed, hot_rows).select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The documents without near duplicates: of each group the row with the smallest doc_id.

    Columns and rows stay as they are. Of rows that share this id the one whose
    text's hash is smallest stays, of equal rows one; rows that share an id but
    are of different groups are different documents. Rows without a doc_id all
    stay.
    """
    classes = _classes(documents, radius, words, seed, HOT_ROWS)
    kept = classes.where(F.struct("doc_id", "text_hash") == F.col("least")).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct()
    whole = documents.where("doc_id is not null").withColumn("hash of the text", _text_hash())
    same = (whole["doc_id"].cast("long") == kept["_doc_id"]) & (whole["hash of the text"] == kept["_text_hash"])
    single = whole.join(kept, same, "left_semi").dropDuplicates(["doc_id", "hash of the text"]).drop("hash of the text")
    return single.unionByName(documents.where("doc_id is null"))
