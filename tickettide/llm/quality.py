"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 128 words. A passage is described by how
its bytes' classes follow one another and how its words repeat; a learned layer
encodes it. Gated attention, learned from document labels alone, weighs the
encoded passages, and the weighted sum is scored. Scoring is one narrow pass:
its weights have a fixed size, and a batch is taken a few megabytes of text at
a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickettide.llm.common import batches, slices, span_hashes, spans_of, text_slices, written
from tickettide.llm.labelled import sample

PASSAGE_WORDS = 128
#: Labelled documents the model is fitted on, and passages of them, in seeded order.
TRAIN_DOCUMENTS = 4096
TRAIN_PASSAGES = 32_768
#: From this score on a document is predicted as good.
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
ENCODED, GATE = 24, 12
EPOCHS, BAGS, RATE, SEED = 24, 64, 0.004, 7
_BATCH_BYTES = 1 << 19

#: Byte classes: 0 control, 1 blank, 2 line break, 3 digit, 4 upper, 5 lower,
#: 6 beyond ASCII, 7 sentence marks, 8 commas, 9 quotes and brackets, 10 to 15 further signs.
CLASSES = 16
_CLASS = np.zeros(256, np.uint8)
for _number, _members in ((1, b" \t"), (2, b"\n\r"), (3, b"0123456789"), (4, bytes(range(65, 91))), (5, bytes(range(97, 123))),
                          (6, bytes(range(128, 256))), (7, b".?:;"), (8, b","), (9, b"\"'()[]{}"), (10, b"!"), (11, b"|"),
                          (12, b"#%&"), (13, b"$*"), (14, b"-_/\\=+"), (15, b"<>@~^`")):
    _CLASS[list(_members)] = _number
WIDTH = CLASSES * CLASSES + 4


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, text of each). A text without words is one passage."""
    joined = b"".join(t + b"\n" for t in texts)
    data = np.frombuffer(joined, np.uint8)
    places = np.cumsum([0] + [len(t) + 1 for t in texts])
    kinds = _CLASS[data]
    starts, ends = spans_of((kinds != 1) & (kinds != 2) & (data > 32)) if len(data) else (np.zeros(0, np.int64),) * 2
    first = np.searchsorted(starts, places)
    counts = np.diff(first)
    per_text = np.maximum(1, -(-counts // PASSAGE_WORDS))
    owner = np.repeat(np.arange(len(texts)), per_text)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    word_at = first[owner] + inner * PASSAGE_WORDS
    begin = np.where(inner == 0, places[owner], starts[np.minimum(word_at, max(len(starts) - 1, 0))] if len(starts) else 0)
    features = np.zeros((len(owner), WIDTH), np.float32)
    if len(data) > 1:
        # Every text ends with a line break of its own; what follows that is another text.
        inner_pairs = np.ones(len(data) - 1, bool)
        inner_pairs[places[1:-1] - 1] = False
        passage = np.searchsorted(begin, np.arange(len(data) - 1), side="right") - 1
        code = passage * (CLASSES * CLASSES) + kinds[:-1].astype(np.int64) * CLASSES + kinds[1:]
        found = np.bincount(code[inner_pairs], minlength=len(owner) * CLASSES * CLASSES)[: len(owner) * CLASSES * CLASSES].reshape(len(owner), -1)
        features[:, : CLASSES * CLASSES] = np.sqrt(found / np.maximum(1, found.sum(axis=1, keepdims=True)))
    words = np.minimum(PASSAGE_WORDS, counts[owner] - inner * PASSAGE_WORDS).clip(0)
    if len(starts):
        hashes = span_hashes(data, starts, ends)
        of = np.repeat(np.arange(len(owner)), words)
        again = np.zeros(len(hashes))
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        kept = np.unique(hashes ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        some = np.maximum(1, words)
        features[:, -4] = np.bincount(of, again, len(owner)) / some
        features[:, -3] = (words - np.bincount(of[kept], minlength=len(owner))) / some
        features[:, -2] = np.bincount(of, ends - starts, len(owner)) / some / 16
    features[:, -1] = words / PASSAGE_WORDS
    return features, owner


def start_model() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    return {"W": draw(WIDTH, ENCODED), "b": np.zeros(ENCODED), "V": draw(ENCODED, GATE), "U": draw(ENCODED, GATE),
            "a": draw(GATE, 1)[:, 0], "c": draw(ENCODED, 1)[:, 0], "c0": np.zeros(1)}


def encode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Encoded passages, both halves of the gate, and the attention before normalising."""
    h = np.tanh(x @ model["W"] + model["b"])
    v, u = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    return h, v, u, (v * u) @ model["a"]


def train(x: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gated attention fitted with Adam on bags; reruns agree."""
    center, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - center) / scale).astype(np.float64)
    model = start_model()
    mean = {k: np.zeros_like(p) for k, p in model.items()}
    square = {k: np.zeros_like(p) for k, p in model.items()}
    rng = np.random.default_rng(SEED)
    bounds = np.searchsorted(owner, np.arange(len(labels) + 1))
    step = 0
    for _ in range(EPOCHS if len(labels) else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BAGS):
            bags = order[at : at + BAGS]
            rows = np.concatenate([np.arange(bounds[b], bounds[b + 1]) for b in bags])
            sizes = bounds[bags + 1] - bounds[bags]
            grads = _gradient(model, x[rows], sizes, labels[bags])
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * model[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                model[k] = model[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    # The scaling becomes part of the first layer.
    model["b"] = model["b"] - (center / scale) @ model["W"]
    model["W"] = model["W"] / scale[:, None]
    return {k: p.astype(np.float64) for k, p in model.items()}


def _gradient(model: dict, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    first = np.cumsum(sizes) - sizes
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h, v, u, score = encode(model, x)
    weight = np.exp(score - np.maximum.reduceat(score, first)[bag])
    weight /= np.add.reduceat(weight, first)[bag]
    z = np.add.reduceat(weight[:, None] * h, first, axis=0)
    p = 1 / (1 + np.exp(-(z @ model["c"] + model["c0"])))
    d = (p - y) / len(y)
    dz = d[:, None] * model["c"]
    pull = (h * dz[bag]).sum(axis=1)
    dscore = weight * (pull - np.add.reduceat(weight * pull, first)[bag])
    dgate = dscore[:, None] * model["a"]
    dv, du = dgate * u * (1 - v * v), dgate * v * u * (1 - u)
    dh = weight[:, None] * dz[bag] + dv @ model["V"].T + du @ model["U"].T
    dh *= 1 - h * h
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "a": ((v * u).T @ dscore),
            "c": z.T @ d, "c0": np.array([d.sum()])}


def bag_scores(model: dict, texts: list[bytes]) -> np.ndarray:
    """The score of each text, from its attention-weighted passages."""
    features, owner = passages(texts)
    h, _, _, score = encode(model, features.astype(np.float64))
    first = np.searchsorted(owner, np.arange(len(texts)))
    weight = np.exp(score - np.maximum.reduceat(score, first)[owner])
    total = np.add.reduceat(weight, first)
    z = np.add.reduceat(weight[:, None] * h, first, axis=0) / total[:, None]
    return 1 / (1 + np.exp(-(z @ model["c"] + model["c0"])))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", allowed: Column | None = None,
        most: int = TRAIN_DOCUMENTS, passages_most: int = TRAIN_PASSAGES) -> dict[str, np.ndarray]:
    """The model from at most `most` labelled documents and `passages_most` of their passages.

    Whole documents are used, in the seeded order of their ids, while their
    passages fit the bound; those that do not are passed over. Without any label
    the model scores near one half; labels of which no document fits are an error.
    """

    def each(batch):
        texts = batch.column(2).to_pylist()
        for a, b in slices(np.array([len(t) for t in texts]), _BATCH_BYTES):
            features, owner = passages(texts[a:b])
            bounds = np.searchsorted(owner, np.arange(b - a + 1))
            packed = [features[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)]
            counts = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts), pa.array(packed, pa.binary())],
                ["turn", "label", "n", "packed"])

    chosen = sample(documents, labels, label, most, F.lit(True) if allowed is None else allowed, "quality-sample")
    # Documents too long for the bound are left out before they are unfolded.
    rows = written(batches(chosen.where(F.octet_length("text") < 64 * PASSAGE_WORDS * passages_most), each,
                           "turn long, label double, n long, packed binary"), "quality-features")
    sizes = sorted((r["turn"], r["n"]) for r in rows.select("turn", "n").collect())
    total, turns = 0, []
    for turn, n in sizes:
        if total + n <= passages_most:
            total += n
            turns.append(turn)
    if not turns:
        if not chosen.isEmpty():
            raise ValueError(f"no labelled document fits in {passages_most} passages")
        return start_model() | {"c": np.zeros(ENCODED)}
    kept = sorted(rows.where(F.col("turn").isin(turns)).collect(), key=lambda r: (r["turn"], r["label"], bytes(r["packed"])))
    x = np.concatenate([np.frombuffer(r["packed"], np.float32).reshape(-1, WIDTH) for r in kept])
    owner = np.repeat(np.arange(len(kept)), [r["n"] for r in kept])
    return train(x, owner, np.array([r["label"] for r in kept]))


def score(documents: DataFrame, model: dict[str, np.ndarray], name: str = "_score") -> DataFrame:
    """The documents' columns, whatever they are, and `name`, the quality from 0 to 1, which replaces a column called so.

    Empty and null texts are bags of one wordless passage and get its score. A
    score depends on the row's text alone: repeated rows repeat, shared and
    null ids need no rule. An empty table gives an empty one.
    """
    documents = documents.drop(name)
    fields = documents.schema.fieldNames()

    def each(batch):
        for a, b, texts in text_slices(batch.column(fields.index("text")), _BATCH_BYTES):
            made = bag_scores(model, texts)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(made)], [*fields, name])

    return batches(documents, each, StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, allowed: Column | None = None) -> DataFrame:
    """The documents that score at least the threshold, columns and repeats as they are."""
    name = "_score"
    while name in documents.columns:
        name += "_"
    return score(documents, fit(documents, labels, allowed=allowed), name).where(F.col(name) >= threshold).drop(name)
