"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, groups.

Lines are normalised and equal ones put together by a 128-bit digest. Of the
distinct lines only the SimHash travels to the block keys: with at most three
differing bits, two of five blocks agree, so every pair meets on one of ten keys. Lines that have a partner there, and only those, are then brought
together with their texts, which confirms each pair by its edit similarity. A
pair that the group already connects is not compared again, and a group emits
the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.llm.common import batches, components, popcount, signed, span_hashes, spans_of, text_bytes, text_slices, written

MIN_WORDS = 5
SIMILARITY = 0.8
DISTANCE = 3
#: Bits of the five blocks; a key is two of them.
BLOCKS = (13, 13, 13, 13, 12)
PICKED = len(BLOCKS) - DISTANCE
_SLOT_BITS = PICKED * max(BLOCKS)
_BATCH_BYTES = 1 << 20
_TILE = 2048
_SMALL = 64
#: Lines of a key whose texts are compared in one group; more are dealt to pairs of slices.
SLICE_LINES = 1000

_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def normal_words(line: bytes) -> list[bytes]:
    """A line's words: A-Z lower-cased, all other ASCII but digits and letters a gap."""
    data = np.frombuffer(line.lower(), np.uint8)
    starts, ends = spans_of(_IN_WORD[data]) if len(data) else ((), ())
    return [line[a:b].lower() for a, b in zip(starts, ends)]


def line_prints(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every line of the texts: text, place in it, words, two digests, SimHash.

    The digests are two independent hashes of the normalised words in order.
    """
    joined = b"\n".join(texts).lower()
    data = np.frombuffer(joined, np.uint8)
    breaks = np.append(np.flatnonzero(data == 10), len(data))
    text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    text_of = np.searchsorted(text_starts, line_starts, side="right") - 1
    place = np.arange(len(line_starts)) - np.searchsorted(line_starts, text_starts)[text_of]
    starts, ends = spans_of(_IN_WORD[data]) if len(data) else (np.zeros(0, np.int64),) * 2
    hashes = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, np.append(line_starts, len(data) + 1))
    counts = np.diff(first)
    some = counts > 0
    digests = [np.zeros(len(counts), np.uint64) for _ in range(2)]
    prints = np.zeros(len(counts), np.uint64)
    if len(hashes):
        at = first[:-1][some]
        inside = (np.arange(len(hashes)) - np.repeat(at, counts[some])).astype(np.uint64)
        with np.errstate(over="ignore"):
            for k, step in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                # A word's scrambled hash at its place; the sum hashes the sequence.
                placed = (hashes ^ (inside * np.uint64(step))) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
                placed ^= placed >> np.uint64(32)
                placed *= np.uint64(0xA0761D6478BD642F)
                placed ^= placed >> np.uint64(29)
                digests[k][some] = np.add.reduceat(placed, at)
        prints[some] = _simhash(hashes, at, counts[some])
    return text_of, place, counts, digests[0], digests[1], prints


def _simhash(hashes: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit by bit the majority of the words' hashes; ties are zero.

    Eight bits are counted at once in byte lanes, over pieces of at most 255 words.
    """
    pieces = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    piece_at = at[owner] + 255 * inner
    whole = np.cumsum(pieces) - pieces
    made = np.zeros((len(counts), 8), np.uint8)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], piece_at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        totals = np.add.reduceat(lanes, whole, axis=0)
        made[:, k] = np.packbits(2 * totals > counts[:, None], axis=1, bitorder="little")[:, 0]
    return made.view(np.uint64)[:, 0]


def block_keys() -> list[tuple[int, int]]:
    """(number, mask) of the keys: each choice of blocks that must agree."""
    masks, shift = [], 0
    for bits in BLOCKS:
        masks.append(((1 << bits) - 1) << shift)
        shift += bits
    return [(k, sum(some)) for k, some in enumerate(combinations(masks, PICKED))]


def edit_similarity(a: bytes, b: bytes, least: float) -> float:
    """1 - edit distance / longer length over the words, zero where it falls below `least`."""
    return word_similarity(a.split(b" "), b.split(b" "), least)


def word_similarity(x: list[bytes], y: list[bytes], least: float) -> float:
    """`edit_similarity` of lines already cut into words."""
    whole = max(len(x), len(y))
    distance = word_distance(x, y) if abs(len(x) - len(y)) <= _most(whole, least) else whole
    return 1 - distance / whole if whole and distance <= _most(whole, least) else float(not whole)


def _most(whole: int, least: float) -> int:
    """The largest distance at which lines of so many words are still alike."""
    return int((1 - least) * whole + 1e-9)


def word_distance(x: list[bytes], y: list[bytes]) -> int:
    """Edit distance over words: a column of the distance matrix at a time, its differences as bits of two integers."""
    n, m = len(x), len(y)
    while n and m and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    skip = 0
    while skip < min(n, m) and x[skip] == y[skip]:
        skip += 1
    x, y = x[skip:n], y[skip:m]
    if not x or not y:
        return len(x) + len(y)
    at: dict[bytes, int] = {}
    for i, word in enumerate(x):
        at[word] = at.get(word, 0) | 1 << i
    whole, last = (1 << len(x)) - 1, 1 << len(x) - 1
    distance, more, less = len(x), whole, 0  # the column's steps up and down
    for word in y:
        same = at.get(word, 0)
        diagonal = (((same & more) + more) ^ more) | same | less
        up, down = less | whole & ~(diagonal | more), more & diagonal
        distance += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        more, less = whole & (down | ~(same | less | up)), whole & up & (same | less)
    return distance


def alike(x: list[bytes], y: list[bytes], least: float) -> bool:
    """Whether the similarity of two lines' words is at least that.

    Words changed in place bound the distance from above, which settles most pairs.
    """
    most = _most(max(len(x), len(y)), least)
    if abs(len(x) - len(y)) > most:
        return False
    return len(x) == len(y) and sum(map(ne, x, y)) <= most or word_distance(x, y) <= most


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, words, high, low, print): every line of every text, by its place.

    A row is known by its id and its text's hash, so that rows sharing an id are kept apart.
    """

    def each(batch):
        for a, b, texts in text_slices(batch.column(2), _BATCH_BYTES):
            text_of, place, counts, high, low, prints = line_prints(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(a, b - a).take(pa.array(text_of)) for k in range(2)), pa.array(place),
                 pa.array(counts.astype(np.int64)), pa.array(signed(high)), pa.array(signed(low)), pa.array(signed(prints))],
                ["doc_id", "text_hash", "line", "words", "high", "low", "print"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(), text_bytes().alias("text"))
    return batches(rows, each, "doc_id long, text_hash long, line long, words long, high long, low long, print long")


def _text_hash() -> Column:
    return F.xxhash64(text_bytes()).alias("text_hash")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _near_lines(distinct: DataFrame) -> DataFrame:
    """(key, at, high, low): distinct lines with a partner within DISTANCE on a block key.

    A pair belongs to its first agreeing key, so most lines come once.
    """
    keys = block_keys()
    masks = np.array([m for _, m in keys], np.uint64)

    def spread(batch):
        prints = batch.column(0).to_numpy().view(np.uint64)
        for number in range(len(keys)):
            yield pa.RecordBatch.from_arrays([pa.array(_slots(prints, number)), pa.array(signed(prints))], ["slot", "print"])

    def meet(stream):
        carried = None
        for batch in stream:
            table = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(2)])
            if carried is not None:
                table = np.concatenate([carried, table], axis=1)
            if not table.shape[1]:
                continue
            last = table[0] == table[0, -1]
            carried = table[:, last]
            yield from partnered(table[:, ~last])
        if carried is not None:
            yield from partnered(carried)

    def partnered(table):
        if table.shape[1] > 1:
            numbers, prints = table[0] >> _SLOT_BITS, table[1].view(np.uint64)
            rows = _partners(numbers, table[0], prints, masks)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[rows].astype(np.int32)), pa.array(signed(prints[rows] & masks[numbers[rows]])), pa.array(table[1, rows])],
                    ["key", "at", "print"])

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = batches(distinct.select("print").distinct(), spread, "slot int, print long")
    return sent.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(meet, "key int, at long, print long")


def _slots(prints: np.ndarray, number: int) -> np.ndarray:
    """The bits that key `number` picks, put together below the number itself: one small number for key and value."""
    starts = np.cumsum((0, *BLOCKS))
    slots = np.full(len(prints), number, np.uint64)
    for block in list(combinations(range(len(BLOCKS)), PICKED))[number]:
        slots = slots << np.uint64(max(BLOCKS)) | prints >> np.uint64(starts[block]) & np.uint64((1 << BLOCKS[block]) - 1)
    return slots.astype(np.int32)


def _partners(keys: np.ndarray, at: np.ndarray, prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The rows, sorted by (at, key), that have a near partner whose first agreeing key is theirs.

    Small groups, nearly all, are compared at once: every row with the next one
    of its group, then with the one after that, and so on.
    """
    edges = np.flatnonzero((keys[1:] != keys[:-1]) | (at[1:] != at[:-1])) + 1
    edges = np.concatenate([[0], edges, [len(keys)]])
    sizes = np.diff(edges)
    group = np.repeat(np.arange(len(sizes)), sizes)
    found = np.zeros(len(keys), bool)
    first = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= _SMALL))
    for step in range(1, _SMALL):
        first = first[first + step < len(keys)]
        first = first[group[first] == group[first + step]]
        if not len(first):
            break
        apart = prints[first] ^ prints[first + step]
        near = np.flatnonzero(popcount(apart) <= DISTANCE)
        apart, one = apart[near], first[near]
        own = np.ones(len(near), bool)
        for number, mask in enumerate(masks):
            own &= (keys[one] <= number) | (apart & mask != 0)
        found[one[own]] = found[one[own] + step] = True
    for g in np.flatnonzero(sizes > _SMALL):
        inside = slice(edges[g], edges[g + 1])
        found[inside] = _with_partner(prints[inside], int(keys[edges[g]]), masks)
    return np.flatnonzero(found)


def _with_partner(prints: np.ndarray, number: int, masks: np.ndarray) -> np.ndarray:
    """Which of the prints of a key have another one near whose first agreeing key is this.

    Many prints are compared by pigeonhole once more: of four parts of the bits
    that the key leaves open, three differing bits leave one alike.
    """
    found = np.zeros(len(prints), bool)
    if len(prints) > 4 * _TILE:
        open_ = [b for b in range(64) if not int(masks[number]) >> b & 1]
        for part in range(DISTANCE + 1):
            own = np.uint64(sum(1 << b for b in open_[part :: DISTANCE + 1]))
            order = np.argsort(prints & own, kind="stable")
            values = (prints & own)[order]
            edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    found[order[a:b]] |= _near_each_other(prints[order[a:b]], number, masks)
        return found
    return _near_each_other(prints, number, masks)


def _near_each_other(prints: np.ndarray, number: int, masks: np.ndarray) -> np.ndarray:
    found = np.zeros(len(prints), bool)
    for i in range(0, len(prints), _TILE):
        for j in range(i, len(prints), _TILE):
            apart = prints[i : i + _TILE, None] ^ prints[None, j : j + _TILE]
            near = popcount(apart) <= DISTANCE
            if i == j:
                np.fill_diagonal(near, False)
            for mask in masks[:number]:
                near &= (apart & mask) != 0
            found[i : i + _TILE] |= near.any(axis=1)
            found[j : j + _TILE] |= near.any(axis=0)
    return found


def _forest(rows: list[tuple[int, int, list[bytes]]]) -> list[tuple[int, int]]:
    """Links that connect what the pairs within DISTANCE and SIMILARITY connect."""
    clusters: list[list] = []
    found = []
    for row in rows:
        joined = None
        for cluster in clusters[:]:
            hit = next((m for m in cluster if (m[1] ^ row[1]).bit_count() <= DISTANCE
                        and alike(m[2], row[2], SIMILARITY)), None)
            if hit is None:
                continue
            found.append((row[0], hit[0]))
            if joined is None:
                joined = cluster
            else:
                joined.extend(cluster)
                clusters.remove(cluster)
        if joined is None:
            clusters.append([row])
        else:
            joined.append(row)
    return found


def _verified(stream):
    """Links of the groups (at, key, one, other); the rows come sorted by them."""
    current, rows = None, []
    for batch in stream:
        found: list = []
        for *own, id_, print_, text in zip(*(c.to_pylist() for c in batch.columns)):
            if own != current:
                found += _forest(rows)
                current, rows = own, []
            rows.append((id_, print_ & 0xFFFFFFFFFFFFFFFF, text.split(b" ")))
        yield _pairs(found)
    yield _pairs(_forest(rows))


def _pairs(found: list) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["src", "dst"])


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, print, text): the normalised words of the wanted lines, one row per distinct line.

    `wanted` names rows of documents by id and text, and the places of lines in them.
    """

    def each(batch):
        made = []
        for places, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = text.split(b"\n")
            made += [(p["id"], p["print"], b" ".join(normal_words(parts[p["line"]]))) for p in places]
        columns = list(zip(*made)) if made else [[]] * 3
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "print", "text"])

    by_row = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line", "id", "print")).alias("places"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(), text_bytes().alias("text"))
    return batches(rows.join(by_row, _same_row(rows, by_row)).select("places", "text"), each, "id long, print long, text binary")


def _sliced(near: DataFrame, slice_lines: int) -> DataFrame:
    """`near` with `one` and `other`, the slices of its key that a row is compared in.

    A key of many lines is cut into slices by the print, and every pair of
    slices is a group of its own, so no pair of lines is missed and no group
    grows with the key.
    """
    many = written(near.groupBy("key", "at").count().where(F.col("count") > slice_lines), "lines-many")
    counted = near.join(many, ["key", "at"], "left")
    slices = F.ceil(F.coalesce("count", F.lit(1)) / F.lit(slice_lines)).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("_slices")).cast("int")
    pairs = counted.withColumn("_slices", slices).withColumn("_own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return pairs.select("key", "at", "print", F.least("_own", "_other").alias("one"), F.greatest("_own", "_other").alias("other"))


def line_groups(documents: DataFrame, min_words: int = MIN_WORDS, slice_lines: int = SLICE_LINES) -> tuple[DataFrame, DataFrame]:
    """(all lines, groups): `lines` of the documents, written once; and of the distinct
    lines that are linked to others (high, low, group_high, group_low)."""
    every = written(lines(documents), "lines")
    able = every.where(F.col("words") >= min_words)
    # A number for each distinct line, so that links and groups are of single longs.
    distinct = written(able.groupBy("high", "low", "print").agg(
        F.min(F.struct("doc_id", "text_hash", "line")).alias("first")).withColumn("id", F.monotonically_increasing_id()), "lines-distinct")
    # Prints that several distinct lines share need their texts compared as well.
    twins = distinct.groupBy("print").count().where("count > 1").select(F.lit(-1).alias("key"), F.col("print").alias("at"), "print")
    near = written(_near_lines(distinct).unionByName(twins), "lines-near")
    some = near.select("print").distinct()
    rows = distinct.join(some, "print").select("id", "print", "first.doc_id", "first.text_hash", "first.line")
    texts = _texts(documents, rows).dropDuplicates(["id"])
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The value first: it tells rows apart where few keys would not, so that sorting looks at one number.
    group = ["at", "key", "one", "other"]
    together = _sliced(near, slice_lines).join(texts, "print").select(*group, "id", "print", "text")
    pairs = together.repartition(parts, *group).sortWithinPartitions(*group, "id").mapInArrow(_verified, "src long, dst long")
    linked = components(pairs, "lines")
    names = distinct.select("id", "high", "low")
    groups = linked.join(names.withColumnRenamed("id", "node"), "node").join(
        names.select(F.col("id").alias("component"), F.col("high").alias("group_high"), F.col("low").alias("group_low")), "component")
    return every, groups.select("high", "low", "group_high", "group_low")


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS, slice_lines: int = SLICE_LINES) -> DataFrame:
    """(doc_id, text_hash, line, group_high, group_low, first_doc_id, first_line): every line but the first of its group.

    A group holds equal normalised lines and those linked to them; its first
    line is the one with the smallest (doc_id, text's hash, place). Lines of
    fewer than `min_words` words never repeat anything. Lines of rows without a
    doc_id come before all others and are never returned themselves. Rows with
    the same id and text are one.
    """
    every, groups = line_groups(documents, min_words, slice_lines)
    able = every.where(F.col("words") >= min_words)
    place = F.struct("doc_id", "text_hash", "line")
    named = able.join(groups, ["high", "low"], "left").select(
        "doc_id", "text_hash", "line", F.coalesce("group_high", "high").alias("group_high"), F.coalesce("group_low", "low").alias("group_low"))
    first = named.groupBy("group_high", "group_low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # A table of its own, so that the lines of a hot group can be split over tasks when they meet it.
    first = written(first, "lines-first")
    repeated = named.join(first, ["group_high", "group_low"]).where(place > F.col("first"))
    return repeated.where("doc_id is not null").select(
        "doc_id", "text_hash", "line", "group_high", "group_low", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line").alias("first_line"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated lines; each group's first line stays where it is.

    Texts lose whole lines and nothing else. A document that loses every line
    stays with an empty text, null texts and documents without repeats stay as
    they are, and so do all other columns; `n_chars`, where there is one of a
    number type, counts the new text. Rows that share a doc_id are told apart by
    their texts, and rows without one lose nothing.
    """
    gone = repeated_lines(documents, min_words).groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("line").cast("int")).alias("_gone")).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "_gone")
    schema = documents.schema
    joined = documents.join(gone, (documents["doc_id"].cast("long") == gone["_doc_id"]) & (
        F.xxhash64(F.coalesce(documents["text"].cast("binary"), F.lit(b""))) == gone["_text_hash"]), "left")
    # A column of its own, so that the text is cut once and not for each line.
    joined = joined.withColumn("lines of the text", F.when(gone["_gone"].isNotNull(), F.split(documents["text"], "\n", -1)))
    parts = F.col("lines of the text")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone["_gone"])
    kept = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
    text = F.when(gone["_gone"].isNull(), documents["text"]).otherwise(kept)
    out = []
    for field in schema.fields:
        if field.name == "text":
            out.append(text.alias("text"))
        elif field.name == "n_chars" and field.dataType.typeName() in ("long", "integer"):
            out.append(F.when(gone["_gone"].isNull(), documents["n_chars"]).otherwise(F.length(kept)).cast(field.dataType).alias("n_chars"))
        else:
            out.append(documents[field.name])
    return joined.select(out)
