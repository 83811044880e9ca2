"""The operators that learn: accuracy on held-out rows, linear scans against brute force, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickettide.llm import quality, toxicity
from tickettide.llm.labelled import fold, sample

FOLDER = "/root/testdata/sf0.01"
ODD = [(901, None), (902, ""), (903, " \n"), (904, "word"), (904, "word"), (None, "a b c"), (905, "long text " * 20_000)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.mark.parametrize("operator, label, parts, held_out, threshold, least", [
    (quality, "quality", 4, 2, 0.7, 0.95), (toxicity, "toxic", 5, 0, 0.5, 0.9)])
def test_held_out_accuracy_and_odd_rows(spark, documents, clashing, tables, operator, label, parts, held_out, threshold, least):
    docs, labels = tables
    model = operator.fit(clashing(docs), labels, allowed=fold(parts) != held_out)
    rows = operator.score(docs, model).where(fold(parts) == held_out).join(labels, "doc_id").select("_score", label).collect()
    assert np.mean([(r["_score"] >= threshold) == r[label] for r in rows]) >= least
    again = operator.fit(docs, labels, allowed=fold(parts) != held_out)
    odd = clashing(documents(*ODD))
    first, second = (sorted((str(r.doc_id), r["_score"]) for r in operator.score(odd, m).collect()) for m in (model, again))
    assert [a for a, _ in first] == sorted(str(i) for i, _ in ODD) and all(0 <= s <= 1 for _, s in first)
    assert np.allclose([s for _, s in first], [s for _, s in second])
    assert operator.score(odd, model).columns.count("_score") == 1
    assert operator.score(odd.limit(0), model).count() == 0


def test_no_labels(spark, documents):
    docs = documents((1, "a b c"))
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert 0.4 < quality.score(docs, quality.fit(docs, labels)).first()["_score"] < 0.6
    assert toxicity.score(docs, toxicity.fit(docs, labels)).first()["_score"] < 0.1
    twice = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 1, 1)], labels.schema)
    assert [tuple(r)[1] for r in sample(docs, twice, "quality", 10, F.lit(True), "test").collect()] == [1.0]


def test_the_training_bounds_hold(spark, tables):
    docs, labels = tables
    assert sample(docs, labels, "quality", 25, F.lit(True), "test").count() == 25
    quality.fit(docs, labels, most=50, passages_most=60)


def test_good_documents_keep_their_columns(documents, clashing, tables):
    docs, labels = tables
    kept = quality.good_documents(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and 0 < kept.count() < docs.count()
    assert kept.where("_score <> 7").count() == 0


def test_attention_gradient():
    """Each gradient against differences of the loss."""
    rng = np.random.default_rng(0)
    x, sizes, y = rng.normal(size=(9, quality.WIDTH)), np.array([4, 2, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.start_model()

    def loss(m):
        h, _, _, score = quality.encode(m, x)
        total, at = 0.0, 0
        for n, label in zip(sizes, y):
            w = np.exp(score[at : at + n])
            p = 1 / (1 + np.exp(-((w / w.sum()) @ h[at : at + n] @ m["c"] + m["c0"][0])))
            total -= label * np.log(p) + (1 - label) * np.log(1 - p)
            at += n
        return total / len(y)

    grads = quality._gradient(model, x, sizes, y)
    for name, g in grads.items():
        at = tuple(rng.integers(0, n) for n in model[name].shape)
        for sign in (1,):
            up, down = ({k: p.copy() for k, p in model.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert g[at] * sign == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_passages_cover_whole_texts():
    texts = [b"", b"one", b" ".join(b"w%d" % i for i in range(1000)), b"\n\n", "é ü 语".encode()]
    features, owner = quality.passages(texts)
    assert np.bincount(owner).tolist() == [1, 1, 8, 1, 1]
    assert features[:, -1].sum() * quality.PASSAGE_WORDS == pytest.approx(1004)
    for i, t in enumerate(texts):
        alone, _ = quality.passages([t])
        assert np.allclose(alone, features[owner == i])


def brute_segments(scores):
    def best(a, b):
        top, place = 1e-12, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > top:
                    top, place = total, (i, j + 1)
        return [] if place is None else best(a, place[0]) + [place] + best(place[1], b)

    return best(0, len(scores))


def test_segments_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.normal(-0.2, 1, rng.integers(0, 30))
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == brute_segments(scores)


def test_toxic_passages(documents, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    text = "the of and " * 30 + "worthless idiot trash pathetic scum " * 2 + "the of and " * 30
    rows = toxicity.toxic_passages(documents((1, text), (2, "the of and " * 60), (3, None), (4, "")), model).collect()
    assert {r.doc_id for r in rows} == {1}
    assert any("idiot trash" in r.passage and text.encode()[r.first_byte : r.last_byte].decode() == r.passage for r in rows)


def test_decay_solves_its_equation():
    scores, weights = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    rate = toxicity.decay(scores, weights)
    assert (weights * np.exp(rate * scores)).sum() == pytest.approx(1, abs=1e-6)


def test_a_long_first_document_is_passed_over(spark):
    """Documents beyond the bound don't end the fit; if none fits, that is an error."""
    rows = [(i, ("good clean prose here " if i % 2 else "| spam | x $$$ ") * (400 if i < 3 else 40)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels, passages_most=30)
    scores = {r.doc_id: r._score for r in quality.score(docs, model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    with pytest.raises(ValueError, match="fits"):
        quality.fit(docs, labels, passages_most=0)
