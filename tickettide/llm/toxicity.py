"""Toxic passages by maximum-scoring segments.

Words get log-odds between toxic and clean labelled documents under an
informative Dirichlet prior, shrunk by their standard error; a word takes the
best of itself and its leading bytes, which carry a stem. The counts of all
training documents meet in a hash table of fixed size. A linear scan finds
every maximal scoring segment of a text; its score becomes an extreme-value
score (lambda, K of the clean documents), and a document sums the evidence of
its significant segments.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickettide.llm.common import batches, slices, span_hashes, spans_of, text_bytes
from tickettide.llm.labelled import sample

#: Labelled documents that are learned from, in a seeded order of their ids.
TRAIN_DOCUMENTS = 32_768
#: Slots of the token table.
SLOTS = 1 << 19
#: Leading bytes of a word that are tokens of their own; 0 is the whole word.
STEMS = (0, 4, 5, 6, 8)
#: Weight of the prior, in documents; standard errors a log-odds value is shrunk by.
PRIOR, SHRINK = 20.0, 1.0
#: What a word without evidence takes away from a segment, and a word's most evidence.
DRIFT, MOST = 0.6, 6.0
#: Expected segments of clean text, of a document's length, at which a segment is significant.
SIGNIFICANT = 0.05
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
_BATCH_BYTES = 2 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True


def word_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots of every word's tokens, words before each text, word starts, word ends).

    A-Z is lower-cased; digits, letters and everything beyond ASCII make words.
    A word shorter than a stem has its own slot there again.
    """
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    starts, ends = spans_of(_IN_WORD[data]) if len(data) else (np.zeros(0, np.int64),) * 2
    places = np.cumsum([0] + [len(t) + 1 for t in texts])
    slots = np.stack([
        (span_hashes(data, starts, np.minimum(starts + (n or 1 << 40), ends), seed=n) % np.uint64(SLOTS)).astype(np.int64) for n in STEMS])
    return slots, np.searchsorted(starts, places), starts, ends


def token_counts(training: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents of each slot among the toxic and the clean, and how many of each there are."""

    def run(stream):
        counts, documents = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in stream:
            labels, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(np.array([len(t) for t in texts]), _BATCH_BYTES):
                slots, first, _, _ = word_slots(texts[a:b])
                for i in range(b - a):
                    own = int(labels[a + i] > 0)
                    counts[own, np.unique(slots[:, first[i] : first[i + 1]])] += 1
                    documents[own] += 1
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(counts[1, used], documents[1])), pa.array(np.append(counts[0, used], documents[0]))],
            ["slot", "toxic", "clean"])

    summed = training.select("label", "text").mapInArrow(run, "slot long, toxic long, clean long").groupBy("slot").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean, documents = np.zeros(SLOTS), np.zeros(SLOTS), (0, 0)
    for row in summed.collect():  # at most SLOTS + 1 rows
        if row["slot"] < 0:
            documents = (row["toxic"], row["clean"])
        else:
            toxic[row["slot"]], clean[row["slot"]] = row["toxic"], row["clean"]
    return toxic, clean, *documents


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Shrunk log-odds of each slot; zero where the evidence is within the error."""
    if not n_toxic or not n_clean:
        return np.zeros(len(toxic), np.float32)
    share = (toxic + clean + 0.02) / (n_toxic + n_clean + 0.04)
    prior = PRIOR * share
    a, b = toxic + prior, clean + prior
    rest_a, rest_b = np.maximum(n_toxic + PRIOR - a, 0.5), np.maximum(n_clean + PRIOR - b, 0.5)
    value = np.log(a / rest_a) - np.log(b / rest_b)
    error = np.sqrt(1 / a + 1 / b)
    return np.clip(value - SHRINK * error, 0, MOST).astype(np.float32)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in linear time.

    Only positive scores start or end one, so the scan goes over them and over
    the running sums in between.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, the last smaller one before
    for i in np.flatnonzero(scores > 0).tolist():
        first, last, low, high = i, i + 1, sums[i], sums[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, last, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last, float(high - low)) for first, last, low, high, _ in stack]


def text_segments(texts: list[bytes], table: np.ndarray):
    """Per text: its words, and its segments with byte places."""
    slots, first, starts, ends = word_slots(texts)
    scores = table[slots].max(axis=0) - np.float32(DRIFT) if slots.size else np.zeros(0, np.float32)
    joined_at = np.cumsum([0] + [len(t) + 1 for t in texts])
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        found = segments(scores[a:b])
        yield int(b - a), [(int(starts[a + x] - joined_at[i]), int(ends[a + y - 1] - joined_at[i]), s) for x, y, s in found]


def decay(clean_scores: np.ndarray, weights: np.ndarray) -> float:
    """The lambda with mean exp(lambda * score) of one over clean words."""
    if not len(clean_scores) or clean_scores.max() <= 0 or (clean_scores * weights).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    mean = lambda x: (weights * np.exp(x * clean_scores)).sum() / weights.sum()
    while mean(high) < 1 and high < 50:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if mean(middle) > 1 else (middle, high)
    return high


def evidence(words: int, found: list[tuple[int, int, float]], model: dict) -> tuple[float, float]:
    """The extreme-value score of a text's best segment, and the sum over its significant ones."""
    if not found:
        return 0.0, 0.0
    chance = math.log(model["K"] * max(words, 1))
    values = [max(0.0, model["lambda"] * s - chance) for _, _, s in found]
    threshold = -math.log(SIGNIFICANT)
    return max(values), sum(v for v in values if v >= threshold)


def _features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.minimum(best, 40) / 10, np.log1p(total)], axis=1)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", allowed: Column | None = None, most: int = TRAIN_DOCUMENTS) -> dict:
    """The model from at most `most` labelled documents, whole texts; all its parts have a fixed size.

    Without labels of both kinds every document scores near zero.
    """
    chosen = sample(documents, labels, label, most, F.lit(True) if allowed is None else allowed, "toxicity-sample")
    toxic, clean, n_toxic, n_clean = token_counts(chosen)
    table = log_odds(toxic, clean, n_toxic, n_clean)
    shared = documents.sparkSession.sparkContext.broadcast(table)
    grid = np.linspace(-DRIFT, MOST - DRIFT, 133)

    def histogram(stream):
        counts, words = np.zeros(len(grid), np.int64), np.zeros(1, np.int64)
        for batch in stream:
            texts = batch.column(0).to_pylist()
            for a, b in slices(np.array([len(t) for t in texts]), _BATCH_BYTES):
                slots, *_ = word_slots(texts[a:b])
                if slots.size:
                    scores = shared.value[slots].max(axis=0) - DRIFT
                    counts += np.bincount(np.rint((scores - grid[0]) / (grid[1] - grid[0])).astype(np.int64), minlength=len(grid))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(counts)], ["bin", "n"])

    clean_rows = chosen.where("label = 0").select("text")
    bins = np.zeros(len(grid))
    for r in clean_rows.mapInArrow(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        bins[r["bin"]] = r["n"]
    rate = decay(grid, bins) if bins.sum() else 1.0

    def measured(batch):
        texts = batch.column(2).to_pylist()
        for a, b in slices(np.array([len(t) for t in texts]), _BATCH_BYTES):
            made = list(text_segments(texts[a:b], shared.value))
            best = [max((s for *_, s in f), default=0.0) for _, f in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([n for n, _ in made], pa.int64()),
                 pa.array(best, pa.float64()), pa.array([[s for *_, s in f if s > 1] for _, f in made], pa.list_(pa.float64()))],
                ["turn", "label", "words", "best", "scores"])

    rows = batches(chosen, measured, "turn long, label double, words long, best double, scores array<double>")
    # Extreme values: clean texts' best scores have the distribution exp(-K n e^(-lambda s)).
    rows = rows.withColumn("shift", F.col("words") * F.exp(-rate * F.col("best")))
    mean = rows.where("label = 0 and best > 0 and words > 0").agg(F.avg("shift")).first()[0]
    model = {"table": table, "lambda": float(rate), "K": float(min(max(1 / mean if mean else 1.0, 1e-6), 1e6)), "weights": np.array([-6.0, 0.0, 0.0])}
    chance = F.log(F.lit(model["K"]) * F.greatest("words", F.lit(1)))
    value = lambda s: F.greatest(F.lit(0.0), F.lit(model["lambda"]) * s - chance)
    significant = F.aggregate("scores", F.lit(0.0), lambda t, s: t + F.when(value(s) >= -math.log(SIGNIFICANT), value(s)).otherwise(0.0))
    points = rows.select("turn", "label", value(F.col("best")).alias("best"), significant.alias("total")).collect()
    if n_toxic and n_clean:
        points = sorted((r["turn"], r["label"], r["best"], r["total"]) for r in points)
        at = np.array([p[1:] for p in points])
        model["weights"] = _logistic(_features(at[:, 1], at[:, 2]), at[:, 0] > 0)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.05 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def _shared(documents: DataFrame, model: dict):
    return documents.sparkSession.sparkContext.broadcast({k: v for k, v in model.items()})


def score(documents: DataFrame, model: dict, name: str = "_score") -> DataFrame:
    """The documents' columns and `name`, the toxicity from 0 to 1, which replaces a column called so.

    Null and empty texts have no segment. A score depends on the row's text
    alone: repeated rows repeat, shared and null ids need no rule, equal texts
    score alike. An empty table gives an empty one.
    """
    documents = documents.drop(name)
    names = documents.schema.fieldNames()
    shared = _shared(documents, model)

    def each(batch):
        texts = batch.column(len(names)).to_pylist()
        own = shared.value
        for a, b in slices(np.array([len(t) for t in texts]), _BATCH_BYTES):
            values = np.array([evidence(n, found, own) for n, found in text_segments(texts[a:b], own["table"])]).reshape(-1, 2)
            made = 1 / (1 + np.exp(-np.clip(_features(values[:, 0], values[:, 1]) @ own["weights"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(made)], [*names, name])

    return batches(documents.select("*", text_bytes().alias("bytes of the text")), each,
                   StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def toxic_passages(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, passage, first_byte, last_byte, segment_score, expected): every significant segment of every text.

    `passage` is the text between the segment's first and last word, `expected`
    how many clean segments of at least this score a clean text of this length has.
    """
    shared = _shared(documents, model)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def each(batch):
        texts = batch.column(1).to_pylist()
        own = shared.value
        for a, b in slices(np.array([len(t) for t in texts]), _BATCH_BYTES):
            rows, ids = [], []
            for i, (n, found) in enumerate(text_segments(texts[a:b], own["table"])):
                for x, y, s in found:
                    expected = own["K"] * n * math.exp(-own["lambda"] * s)
                    if expected <= SIGNIFICANT:
                        ids.append(a + i)
                        rows.append((texts[a + i][x:y].decode("utf-8", "replace"), x, y, s, expected))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "passage", "first_byte", "last_byte", "segment_score", "expected"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return batches(rows, each, "doc_id long, passage string, first_byte long, last_byte long, segment_score double, expected double")
