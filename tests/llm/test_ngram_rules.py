"""The n-gram rules against a plain count, and on odd rows."""

import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tickettide.llm import ngram_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words")


def plain_measures(text):
    text = text or ""
    words, windows, lines = WORD.findall(text), {}, [line for line in text.split("\n") if WORD.search(line)]
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeated = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(repeated))


def grams(text):
    """Bucket-ready hashes of words and pairs: a pair hashes the two words' hashes in turn."""
    ones = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    chained = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
               for a, b in zip(ones, ones[1:])]
    return ones + chained


def plain_scores(rows, trusted, buckets, prior):
    raw, good = [0] * buckets, [0] * buckets
    for doc_id, text in rows:
        for gram in grams(text):
            raw[gram % buckets] += 1
            good[gram % buckets] += doc_id in trusted
    share = sum(good) / (sum(raw) or 1)
    weights = [math.log((g + prior) / (r * share + prior)) for r, g in zip(raw, good)]
    return [sum(weights[g % buckets] for g in grams(t)) / (len(grams(t)) or 1) for _, t in rows]


REPEATED = "one two three four five six seven eight nine ten "
ROWS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "word"), (4, "word"), (None, "a b c"),
    (5, REPEATED * 2), (6, "a " * 40), (7, "x y z\n\nx y z\n \nx y z \nx y z"), (8, "# * $$ %&|<> é\U0001f600 ok"),
    (9, " ".join(str(i) for i in range(30))), (10, REPEATED + "between " + REPEATED + "end " + REPEATED[:20]),
    (11, "a b c d e f g h " * 3 + " ".join(str(i) for i in range(60))), (12, "\xa0non breaking\x1cspaces\x85here"),
]


def test_measures_and_scores_equal_a_plain_count(spark, clashing):
    documents = clashing(spark.createDataFrame(ROWS, "doc_id long, text string")).withColumns(
        {n: F.lit("x") for n in ("_words", "_n", "_row", "bucket", "weight", "raw", "trusted")})
    trusted = spark.createDataFrame([(5,), (9,), (9,), (None,), (99,)], "doc_id long")
    rows = ngram_rules.judged(documents, trusted, threshold=-0.01, buckets=64, prior=0.5)
    got = sorted(((r.doc_id, r.text, *(r[n] for n in NAMES), round(r._score, 9), r._base_failed, r._kept) for r in rows.collect()), key=repr)
    scores = plain_scores(ROWS, {5, 9}, 64, 0.5)
    want = []
    for (doc_id, text), score in zip(ROWS, scores):
        m = plain_measures(text)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want.append((doc_id, text, *m, round(score, 9), failed, not failed and score >= -0.01))
    assert got == sorted(want, key=repr)
    assert "bucket" in rows.columns and "weight" in rows.columns


def test_no_documents_and_no_trusted_ones(spark):
    documents = spark.createDataFrame(ROWS, "doc_id long, text string")
    nobody = spark.createDataFrame([], "doc_id long")
    assert {r._score for r in ngram_rules.judged(documents, nobody, buckets=64).collect()} == {0.0}
    assert ngram_rules.judged(documents.limit(0), nobody, buckets=64).count() == 0
    with pytest.raises(ValueError):
        ngram_rules.fit(documents, nobody, buckets=100)


@pytest.mark.parametrize("most", [1, 5, 100, 999, 1000])
def test_trusted_ids_are_sampled_within_the_bound(spark, most):
    some = ngram_rules._sampled(spark.range(1000).withColumnRenamed("id", "_id"), most)
    ids = [r[0] for r in some.collect()]
    assert most / 2 <= len(ids) <= most and len(set(ids)) == len(ids)
    assert sorted(ids) == sorted(r[0] for r in ngram_rules._sampled(spark.range(1000).repartition(7).withColumnRenamed("id", "_id"), most).collect())


def test_every_trusted_document_is_counted(spark):
    """More of them than a model could once count: if all are trusted, both multinomials agree."""
    documents = spark.range(1 << 18, (1 << 19) + 30_000).selectExpr("id doc_id", "concat('w', id % 97, ' v', id % 89) text")
    weights = {r.weight for r in ngram_rules.fit(documents, documents.select("doc_id"), buckets=64).collect()}
    assert weights == {0.0}


def test_a_long_text_of_repeats(spark):
    text = REPEATED * 20_000
    row = ngram_rules.judged(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                             spark.createDataFrame([(1,)], "doc_id long"), buckets=64).first()
    assert (row._n_words, row._n_repeat_words, row._kept) == (200_000, 200_000, False)


def test_query_counts_every_document_and_tells_labels_apart(spark):
    folder = driver.SMOKE_FOLDER
    rows = driver.queries()["op11_ngram_quality_rules"](spark, folder)
    assert rows.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in rows.collect()}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: plain_measures(t) for i, t in texts.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [got[i].kept for i, q in labels.items() if q == 1 and not got[i].base_failed]
    bad = [got[i].kept for i, q in labels.items() if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_main_path_is_native(spark):
    documents = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = ngram_rules.judged(documents, documents.select("doc_id"), buckets=64)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
