"""Benchmark decontamination by word windows.

The windows of a benchmark block become sorted hash arrays whose size is
bounded by the words of the block; they are broadcast, document windows are
looked up in them, and every hit is verified on the words themselves. A
benchmark above the bound is taken in several blocks, each with a pass of its
own over the documents; nothing is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickettide.llm.common import BASE, batches, mixed, slices, span_hashes, spans_of, text_bytes, text_slices, written

WINDOW = 13
#: A document is contaminated when at least this part of its words is hit.
HIT_PART = 20
#: Benchmark words whose windows are broadcast at once: about 40 bytes each.
BLOCK_WORDS = 2_000_000
#: Bytes of text looked at at once in a task; its arrays take some forty times as much.
_BATCH_BYTES = 1 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts lower-cased (A-Z) and put together, word starts and ends, words before each text."""
    joined = b"\0".join(texts).lower()
    data = np.frombuffer(joined, np.uint8)
    starts, ends = spans_of(_IN_WORD[data]) if len(data) else (np.zeros(0, np.int64),) * 2
    places = np.cumsum([0] + [len(t) + 1 for t in texts])
    return joined, starts, ends, np.searchsorted(starts, places)


def _window_hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * np.uint64(BASE) + words[at + j]
    return mixed(total)


def window_index(items: list[str], texts: list[bytes], window: int) -> dict:
    """The windows of some items as plain arrays, sorted by hash within each length.

    text, starts, ends: the items' words; vocabulary: their distinct hashes;
    by_size: length -> (hash, first word, item) of every window.
    """
    joined, starts, ends, first = words_of(texts)
    counts = np.diff(first)
    text = b" ".join(joined[a:b] for a, b in zip(starts, ends))
    data = np.frombuffer(text, np.uint8)
    starts, ends = spans_of(data != 32) if len(data) else (np.zeros(0, np.int64),) * 2
    hashes = span_hashes(data, starts, ends)
    places: dict[int, list] = {}
    for i, n in enumerate(counts.tolist()):
        if n:
            size = min(n, window)
            at = np.arange(first[i], first[i] + n - size + 1)
            places.setdefault(size, []).append((at, np.full(len(at), i)))
    by_size = {}
    for size, parts in places.items():
        at, item = (np.concatenate(x) for x in zip(*parts))
        found = _window_hashes(hashes, at, size)
        order = np.argsort(found, kind="stable")
        by_size[size] = found[order], at[order], item[order]
    return {"items": items, "text": text, "starts": starts, "ends": ends, "vocabulary": np.unique(hashes), "by_size": by_size}


def hits(texts: list[bytes], windows: dict) -> tuple[list[int], dict[int, list], dict[int, set]]:
    """Words of each text; by text with hits, its occurrences as (start, end) bytes
    and words, and the items whose windows occur."""
    joined, starts, ends, first = words_of(texts)
    counts = np.diff(first).tolist()
    ranges: dict[int, list] = {}
    items: dict[int, set] = {}
    if not len(starts) or not windows["by_size"]:
        return counts, ranges, items
    hashes = span_hashes(np.frombuffer(joined, np.uint8), starts, ends)
    vocabulary = windows["vocabulary"]
    known = vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    # How many known words of the same text follow, this one included.
    breaks = ~known
    breaks[1:] |= text_of[1:] != text_of[:-1]
    stops = np.flatnonzero(breaks)
    following = np.searchsorted(stops, np.arange(len(known)), side="right")
    run = np.where(following < len(stops), np.append(stops, len(known))[following], len(known)) - np.arange(len(known))
    for size, (table, at, item) in windows["by_size"].items():
        candidates = np.flatnonzero(known & (run >= size))
        if not len(candidates):
            continue
        values = _window_hashes(hashes, candidates, size)
        low, high = np.searchsorted(table, values), np.searchsorted(table, values, side="right")
        for k in np.flatnonzero(high > low):
            place = int(candidates[k])
            words = b" ".join(joined[a:b] for a, b in zip(starts[place : place + size], ends[place : place + size]))
            found = {int(item[m]) for m in range(low[k], high[k])
                     if windows["text"][windows["starts"][at[m]] : windows["ends"][at[m] + size - 1]] == words}
            if found:
                own = int(text_of[place])
                begin = int(first[own])
                ranges.setdefault(own, []).append((place - begin, place - begin + size))
                items.setdefault(own, set()).update(windows["items"][x] for x in found)
    return counts, ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    done: list[list[int]] = []
    for a, b in sorted(ranges):
        if done and a <= done[-1][1]:
            done[-1][1] = max(done[-1][1], b)
        else:
            done.append([a, b])
    return [(a, b) for a, b in done]


def _blocks(benchmark: DataFrame, window: int, block_words: int):
    """The benchmark's windows, block by block."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text")).where("item is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-(size // 2) // block_words))  # a word takes two bytes at least
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect() if blocks > 1 else rows.collect()
        yield blocks, window_index([r["item"] for r in part], [bytes(r["text"]) for r in part], window)


_HITS = "n_words long, ranges array<struct<first:long,last:long>>, items array<string>"
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scan(documents: DataFrame, windows: dict, text: bool, hit_only: bool = False) -> DataFrame:
    """(doc_id, digest, [text,] n_words, ranges, items) of the documents against one block."""
    shared = documents.sparkSession.sparkContext.broadcast(windows)

    def each(batch):
        for a, b, part in text_slices(batch.column(1), _BATCH_BYTES):
            counts, ranges, items = hits(part, shared.value)
            rows = sorted(ranges) if hit_only else range(len(part))
            columns = [
                batch.column(0).slice(a, b - a).take(pa.array(rows, pa.int64())),
                pa.array([xxhash.xxh3_128_digest(part[i]) for i in rows], pa.binary()),
                *([pa.array([part[i] for i in rows], pa.binary())] if text else []),
                pa.array([counts[i] for i in rows], pa.int64()),
                pa.array([[{"first": x, "last": y} for x, y in merged(ranges.get(i, []))] for i in rows], _RANGES),
                pa.array([sorted(items.get(i, ())) for i in rows], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", *(["text"] if text else []), "n_words", "ranges", "items"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return batches(rows, each, f"doc_id long, digest binary, {'text binary, ' if text else ''}{_HITS}")


def occurrences(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, digest, n_words, ranges, items): every document's words inside occurring windows.

    `ranges` are merged word ranges [first, last), `items` the sorted ids, as
    text, of the items with an occurring window, `digest` the XXH3-128 of the
    text. Null texts have no words, null item_ids and items without words no
    windows; an item_id that repeats counts once. Repeated documents stay repeated.
    """
    total = None
    for blocks, windows in _blocks(benchmark, window, block_words):
        if blocks == 1:
            return _scan(documents, windows, text=False)
        part = written(_scan(documents, windows, text=False, hit_only=True), "decontamination")
        total = part if total is None else total.unionByName(part)
    # Equal documents find equal rows, so each block counts once by digest.
    found = total.dropDuplicates(["doc_id", "digest", "ranges", "items"]).select("doc_id", "digest", "ranges", "items").groupBy("doc_id", "digest").agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    base = _scan(documents, window_index([], [], window), text=False).drop("ranges", "items")
    join = base["doc_id"].eqNullSafe(found["doc_id"]) & (base["digest"] == found["digest"])
    rows = base.join(found, join, "left").select(base["doc_id"], base["digest"], "n_words", "ranges", "items")

    def merge(batch):
        ranges = [merged([(r["first"], r["last"]) for r in x or []]) for x in batch.column(3).to_pylist()]
        merged_column = pa.array([[{"first": a, "last": b} for a, b in x] for x in ranges], _RANGES)
        items = pa.array([x or [] for x in batch.column(4).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], merged_column, items], ["doc_id", "digest", "n_words", "ranges", "items"])

    return batches(rows, merge, f"doc_id long, digest binary, {_HITS}")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_part: int = HIT_PART,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every document.

    A document is contaminated when some word is hit and `hit_part` times the
    hit words reach all its words. See `occurrences` for nulls and repeats.
    """
    rows = occurrences(documents, benchmark, window, block_words)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return rows.select("doc_id", "digest", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (hit_part * F.col("n_hit") >= F.col("n_words")))


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_part: int = HIT_PART,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, all columns and repeats as they are.

    Each row is judged by its own text where it is read, so shared and null ids
    need no rule, and nothing is shuffled. A benchmark of several blocks takes
    a pass each, and what is hit so far goes along with the row.
    """
    columns = documents.columns
    at = columns.index("text")
    rows = documents.withColumn("words hit", F.lit(None).cast("array<struct<first:long,last:long>>"))
    schema = rows.schema
    for number, (blocks, windows) in enumerate(_blocks(benchmark, window, block_words)):
        shared, last = documents.sparkSession.sparkContext.broadcast(windows), number == blocks - 1

        def each(batch, shared=shared, last=last):
            for a, b, texts in text_slices(batch.column(at), _BATCH_BYTES):
                part = batch.slice(a, b - a)
                counts, ranges, _ = hits(texts, shared.value)
                before = part.column(len(columns)).to_pylist()
                every = [merged([*((r["first"], r["last"]) for r in x or []), *ranges.get(i, [])]) for i, x in enumerate(before)]
                if last:
                    n_hit = [sum(y - x for x, y in found) for found in every]
                    part = part.filter(pa.array([not (n and hit_part * n >= words) for n, words in zip(n_hit, counts)], pa.bool_()))
                    yield part
                else:
                    marks = pa.array([[{"first": x, "last": y} for x, y in found] for found in every], _RANGES)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], marks], part.schema.names)

        rows = batches(rows, each, schema)
    return rows.select(*columns)


def without_passages(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with every occurring window cut out of the text, other columns as they are.

    What stands between the first and the last word of an occurrence goes with
    it; everything else stays byte for byte. Texts without hits, null texts
    among them, stay as they are.
    """
    schema = documents.schema
    at = documents.columns.index("text")
    for _, windows in _blocks(benchmark, window, BLOCK_WORDS):
        shared = documents.sparkSession.sparkContext.broadcast(windows)

        def each(batch, shared=shared):
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            whole = batch.column(at).to_pylist()
            for a, b in slices(np.array([len(t) for t in texts]), _BATCH_BYTES):
                for i, ranges in hits(texts[a:b], shared.value)[1].items():
                    whole[a + i] = _cut(texts[a + i], merged(ranges))
            columns = list(batch.columns)
            columns[at] = pa.array(whole, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        documents = written(batches(documents, each, schema), "decontaminated")
    return documents


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> str:
    _, starts, ends, _ = words_of([text])
    kept, after = [], 0
    for first, last in ranges:
        kept.append(text[after : starts[first]])
        after = ends[last - 1]
    return b"".join([*kept, text[after:]]).decode()
