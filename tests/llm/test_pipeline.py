"""The pipeline's stages, each against a brute-force version over its own input."""

import re

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from tests.llm.test_documents import BENCHMARK, brute_hits, brute_targets, plain_print, reachable
from tickettide.llm import line_dedup, quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        seen.append(docs)
    return seen


def texts(rows):
    return {r.doc_id: r.text for r in rows.collect()}


def test_columns(steps):
    for rows in steps[:-1]:
        assert rows.columns == steps[0].columns
    assert set(steps[-1].columns) >= {"doc_id", "size", "source_size", "target", "taken"}


def test_rejected_documents_go(spark, steps):
    before, after = texts(steps[0]), texts(steps[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    model = quality.fit(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {i: quality.bag_scores(model, [(t or "").encode()])[0] for i, t in before.items()}
    assert after == {i: t for i, t in before.items() if scores[i] >= quality.THRESHOLD}
    assert sum((i in after) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)


def test_repeated_lines_go(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert set(before) == set(after)
    lines = [(i, k, line) for i, t in sorted(before.items()) for k, line in enumerate((t or "").split("\n"))]
    words = {line: b" ".join(line_dedup.normal_words(line.encode())) for _, _, line in lines}
    distinct = sorted({w for w in words.values() if len(w.split()) >= line_dedup.MIN_WORDS})
    prints = dict(zip(distinct, map(int, line_dedup.line_prints(distinct)[5])))
    linked = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 and line_dedup.edit_similarity(a, b, 0.8) >= 0.8
    groups = {m: min(members) for m, members in reachable(distinct, linked).items()}
    seen, kept = set(), {i: [] for i in before}
    for i, _, line in lines:
        group = groups.get(words[line])
        if group is None or group not in seen:
            kept[i].append(line)
        seen.add(group)
    assert after == {i: t if t is None else "\n".join(kept[i]) for i, t in before.items()}


def test_one_of_each_near_group_stays(steps):
    before, after = texts(steps[2]), texts(steps[3])
    prints = {i: plain_print(t) for i, t in before.items()}
    groups = reachable(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i in sorted(before):
        first.setdefault(min(groups[prints[i]]), i)
    assert after == {i: before[i] for i in first.values()}


def test_contaminated_documents_go(spark, steps):
    before, after = texts(steps[3]), texts(steps[4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_hits(list(before.items()), items) if r[5]}
    assert after == {i: t for i, t in before.items() if i not in bad} and bad


def test_the_mix_meets_its_targets(steps):
    before = {r.doc_id: r for r in steps[4].collect()}
    rows = steps[5].collect()
    sizes = {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    targets = brute_targets(sizes)
    assert {r.doc_id for r in rows} == set(before)
    taken = {}
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.taken == r.repeats * r["size"] and 0 <= r.repeats <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    longest = {s: max(r["size"] for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - t) <= longest[s] for s, t in targets.items())


def test_run_gives_the_rows_of_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1].collect()))


def test_odd_tables(spark, tmp_path, documents):
    """Nulls, empty texts, repeats and an empty table go through all stages."""
    rows = [(1, None), (2, ""), (2, ""), (3, "a b c d e f g h"), (None, "x y z"), (4, "word " * 3000)]
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "a b c"), (2, "")], BENCHMARK).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(*rows), documents((1, "a")).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()


def test_every_operator_is_registered():
    names = list(driver.queries())
    assert [n.split("_")[0] for n in names if re.match(r"op\d+_", n)] == [f"op{k}" for k in range(1, 14)] and "pipeline" in names
