"""Quality rules of documents: counts of words, lines and repeats, and a hashed n-gram likelihood ratio.

Single words and word pairs are hashed into a fixed number of buckets. Two
multinomials over the buckets are counted, one over trusted documents and one
over the raw corpus, and a document's score is the logarithm of the ratio of its
likelihoods under the two, divided by its number of n-grams. Everything is built
of DataFrame functions: counting is one aggregate over exploded hashes, and a
document is scored from its own row without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.llm.common import written

#: Buckets of the multinomials, a power of two. The model has a weight each, whatever the corpus.
BUCKETS = 1 << 14
#: Pseudo-counts of a bucket, in both multinomials at the size of the trusted one: rare buckets say little.
PRIOR = 16.0
#: Score from which a document is kept.
THRESHOLD = -0.08

WINDOW = 8
LEAST_WORDS = 20
#: Most words in repeated windows, in hundredths of all words.
MOST_REPEATED = 30

_SPACE = r"[\x20\x09-\x0D]+"
_NO_SPACE = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    """Runs of characters other than space and the ASCII controls from tab to return."""
    return F.array_remove(F.split(text, _SPACE), "")


def _joined(hashes: Column, step: int, n: Column) -> Column:
    """Hashes of neighbouring pairs, `step` places apart, of which there are n or none."""
    length = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, length), F.slice(hashes, 1 + step, length), lambda a, b: F.xxhash64(a, b))


def _with_grams(rows: DataFrame, words: str) -> DataFrame:
    """Adds `_n`, `_ones` and `_twos`: number of words, hashes of words and of word pairs."""
    sized = rows.withColumns({"_n": F.size(words), "_ones": F.transform(words, lambda w: F.xxhash64(w))})
    return sized.withColumn("_twos", _joined(F.col("_ones"), 1, F.col("_n") - 1))


def _bucket(value: Column, buckets: int) -> Column:
    return value.bitwiseAND(F.lit(buckets - 1).cast("bigint"))


_PREFIX_BITS = 12


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    """All ids, or those whose hashes come first, at most so many: whole ranges of the hash, by their counts.

    For callers who want fewer trusted documents; `fit` counts all it is given.
    """
    for level in range(64 // _PREFIX_BITS):
        prefix = F.shiftrightunsigned(F.shiftleft(F.xxhash64("_id"), level * _PREFIX_BITS), 64 - _PREFIX_BITS)
        counts = sorted(ids.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect())
        if sum(r["n"] for r in counts) <= most:
            return ids
        running, last = 0, None
        for row in counts:
            running += row["n"]
            if running > most:
                break
            last = row["prefix"]
        if last is not None:
            return ids.where(prefix <= last)
        ids = ids.where(prefix == counts[0]["prefix"])
    return ids


def fit(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, weight): the log-likelihood ratio of each bucket, over all documents.

    `trusted` names trusted documents by `doc_id`; repeats and nulls in it are
    ignored, and all documents of that id are trusted and counted. The raw corpus
    is all documents, trusted ones included, and is counted where it is read.
    Texts are shuffled by id to meet the trusted ids, whatever their number, so
    that the work grows with the input; nothing is sorted. The raw counts are scaled to the trusted
    total before pseudo-counts are added, so that both multinomials are smoothed
    alike and a bucket without evidence weighs 0. Without documents or without
    trusted ones all weights are 0.
    """
    if buckets & (buckets - 1):
        raise ValueError(f"the number of buckets must be a power of two, not {buckets}")
    named = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("_id")).distinct()
    ids = written(named, "trusted")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("_id"), _text().alias("_text"))
    raw = _bucket_counts(texts, buckets, "raw")
    good = _bucket_counts(texts.where("_id IS NOT NULL").join(ids.hint("shuffle_hash"), "_id", "left_semi"), buckets, "trusted")
    counted = written(raw.join(good, "bucket", "left"), "bucket-counts")
    totals = counted.agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    share = totals.select(F.coalesce(F.col("trusted") / F.nullif("raw", F.lit(0)), F.lit(0.0))).scalar()
    weight = F.log((F.coalesce("trusted", F.lit(0)) + prior) / (F.coalesce("raw", F.lit(0)) * share + prior))
    every = documents.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return written(every.join(counted, "bucket", "left").select("bucket", weight.alias("weight")), "bucket-weights")


def _bucket_counts(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, `name`): the n-grams of all `_text`s in each bucket."""
    grams = _with_grams(texts.select(_words(F.col("_text")).alias("_words")), "_words")
    return grams.select(F.explode(F.concat("_ones", "_twos")).alias("_gram")).groupBy(
        _bucket(F.col("_gram"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name))


def _as_literal(weights: DataFrame) -> Column:
    """The weights in order of their buckets as one constant: a number each, however large the corpus."""
    rows = sorted(weights.select("bucket", "weight").collect())
    return F.split(F.lit(",".join(repr(w) for _, w in rows)), ",").cast("array<double>")


def _repeated_places(pairs: Column) -> Column:
    """Places, in order, of the windows that occur twice or more, from (hash, place) pairs in order of the hashes.

    A window is one of them where a neighbour in that order has its hash.
    """
    def same(i: Column, p: Column) -> Column:
        return F.coalesce(F.get(pairs, i)["hash"] == p["hash"], F.lit(False))

    marked = F.filter(pairs, lambda p, i: same(i - 1, p) | same(i + 1, p))
    return F.sort_array(F.transform(marked, lambda p: p["place"]))


def measured(documents: DataFrame, weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """All rows and columns of `documents` with the measures behind the verdict, prefixed by an underscore.

    `_n_words`, `_word_chars` (code points in words), `_n_symbols`,
    `_n_dup_lines` (lines with a word that equal an earlier line),
    `_n_repeat_words` (words in windows of eight that occur twice or more, by
    64-bit hashes within the document) and `_score`. A null or empty text has
    zero everywhere, and so does the score of a text without words. Columns of
    `documents` of these names are replaced. Each row stands for itself, so
    repeated rows, shared and null ids need no rule. Repeats cost a sort of the
    document's own windows, and only where there are any.
    """
    table = _as_literal(weights)
    inner = ("_text", "_words", "_n", "_ones", "_twos", "_fours", "_windows", "_pairs", "_places", "_lines")
    outer = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_score")
    kept = [c for c in documents.columns if c not in (*inner, *outer)]
    row = F.struct(*kept).alias("_row")
    text, n = F.col("_text"), F.col("_n")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_NO_SPACE))
    start = documents.select(row, _text().alias("_text")).select(
        "_row", _words(text).alias("_words"), lines.alias("_lines"), F.regexp_count(text, F.lit(_SYMBOL)).alias("_n_symbols"))
    counted = _with_grams(start, "_words").select(
        "_row", "_n", "_ones", "_twos", F.length(F.array_join("_words", "")).alias("_word_chars"), "_n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_n_dup_lines"))

    def total(hashes: str) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda sum_, x: sum_ + F.get(table, _bucket(x, buckets)))

    scored = counted.withColumns({
        "_score": F.when(n > 0, (total("_ones") + total("_twos")) / (2 * n - 1)).otherwise(0.0),
        "_fours": _joined(F.col("_twos"), 2, n - 3),
    }).withColumn("_windows", _joined(F.col("_fours"), 4, n - 7)).drop("_ones", "_twos", "_fours")
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    paired = scored.withColumn("_pairs", F.when(again, F.sort_array(placed))).drop("_windows")
    marked = paired.withColumn("_places", _repeated_places(F.col("_pairs"))).drop("_pairs")
    places = F.col("_places")
    # Each place covers the words up to the next one, a window at most.
    covered = F.aggregate(
        F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))),
                   lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda sum_, x: sum_ + x)
    return marked.select(
        "_row.*", n.cast("bigint").alias("_n_words"), F.col("_word_chars").cast("bigint"), F.col("_n_symbols").cast("bigint"),
        F.col("_n_dup_lines").cast("bigint"),
        F.when(places.isNotNull(), covered).otherwise(0).cast("bigint").alias("_n_repeat_words"), "_score")


def base_failed() -> Column:
    """Whether a measured document fails before its score is looked at: too short, or mostly repeats."""
    return (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * F.col("_n_words"))


def kept(threshold: float = THRESHOLD) -> Column:
    """Whether a measured document stays: it passes the base rules and its score reaches the threshold."""
    return ~base_failed() & (F.col("_score") >= threshold)


def judged(documents: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS,
           prior: float = PRIOR) -> DataFrame:
    """`measured` documents with `_base_failed` and `_kept`, by a model counted from them.

    An empty table gives an empty table.
    """
    rows = measured(documents, fit(documents, trusted, buckets, prior), buckets)
    return rows.withColumns({"_base_failed": base_failed(), "_kept": kept(threshold)})
