"""Operators on documents against brute force, and on odd rows."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tickettide.llm import decontamination, line_dedup, mixing, simhash
from tickettide.llm.common import components, span_hashes

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [(901, None), (902, ""), (903, "   \n\t "), (904, "word"), (904, "word"), (None, "a b c d e f"), (905, "x" * 3000 + " " + "long text " * 4000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Distinct texts, exact copies, copies with a changed word, and odd rows."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        text = prose(rng, rng.randrange(3, 200))
        rows.append((i, text))
        if i % 3 == 0:
            rows.append((100 + i, text))
        if i % 4 == 0:
            parts = text.split()
            parts[len(parts) // 2] = "changed"
            rows.append((200 + i, " ".join(parts)))
    return rows + ODD


def plain_print(text):
    """The fingerprint as its contract words it."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes, linked):
    """Brute-force groups: node -> all nodes it reaches."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(parent)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return {n: groups[find(n)] for n in nodes}


@pytest.mark.parametrize("hot_rows", [20_000, 1])
def test_simhash_equals_brute_force(documents, clashing, corpus, hot_rows):
    prints = [(i, plain_print(t)) for i, t in corpus]
    groups = reachable({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for p, members in groups.items():
        least[p] = min((i for i, q in prints if q in members and i is not None), default=None)
    got = simhash.near_duplicates(clashing(documents(*corpus)), hot_rows=hot_rows).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == sorted(((i, p, least[p]) for i, p in prints), key=str)


def test_leading_bits_grow_with_the_fingerprints():
    widths = [simhash.lead_bits(n, 2) for n in (1, 9_000_000, 30_000_000, 10 ** 8, 10 ** 9, 10 ** 12)]
    assert widths[:2] == [16, 16] and widths == sorted(widths) and widths[-1] <= 40
    for n in (3 * 10 ** 7, 10 ** 9, 10 ** 11):
        bits = simhash.lead_bits(n, 2)
        assert n * len(simhash.masks(bits, 2)) / 2 ** bits <= simhash.HOT_ROWS < n * len(simhash.masks(bits - 1, 2)) / 2 ** (bits - 1)


def test_simhash_radius_balls(spark):
    """All links in clusters of random flips, also when every key is hot and blocks are tiny."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b for b in base}
    for b in base:
        for _ in range(25):
            prints.add(b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(1, 6))))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    groups = reachable(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    rows = spark.createDataFrame([(p,) for p in signed], "fp long")
    for hot_rows, bits in ((20_000, None), (2, None), (20_000, 17), (20_000, 20), (2, 21), (20_000, 30)):
        links = simhash.links(rows, hot_rows=hot_rows, bits=bits)
        assert all((r.src ^ r.dst).bit_count() <= 4 if (r.src ^ r.dst) >= 0 else ((r.src ^ r.dst) % 2**64).bit_count() <= 4 for r in links.collect())
        found = {r.node % 2**64: r.component % 2**64 for r in components(links, "test").collect()}
        for p, members in groups.items():
            assert len({found.get(m, m) for m in members}) == 1
        assert len({found.get(p, p) for p in prints}) == len({min(m) for m in groups.values()})


def test_keep_one(documents, corpus):
    rows = documents(*corpus)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in groups.items() if i is not None})
    assert ids.count(None) == 1
    assert simhash.keep_one(rows.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (101, 100)], "src long, dst long")
    assert {r.node: r.component for r in components(edges, "test").collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(edges.limit(0), "test").count() == 0


def test_equal_spans_hash_alike():
    import numpy as np

    data = np.frombuffer(b"abc xabc abd abc", np.uint8)
    hashes = span_hashes(data, np.array([0, 5, 9, 13]), np.array([3, 8, 12, 16]))
    assert hashes[0] == hashes[1] == hashes[3] != hashes[2]


BENCHMARK = "item_id long, text string"


def brute_hits(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_decontamination_equals_brute_force(spark, documents, clashing, corpus, block_words):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate((30, 14, 13, 12, 5, 1))] + [(7, None), (8, "..."), (None, prose(rng, 20)), (4, prose(rng, 15))]
    planted = [(300 + k, f"{prose(rng, 40)}, {t.upper()}! {prose(rng, 5)}") for k, t in items[:5]]
    planted += [(310, prose(rng, 400) + " " + items[2][1]), (310, items[0][1] + " " + items[0][1]), (None, items[1][1])]
    rows = corpus + planted
    table = spark.createDataFrame(items, BENCHMARK)
    docs = documents(*rows)
    got = decontamination.contamination(clashing(docs), table, block_words=block_words)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got.collect()), key=str) == brute_hits(rows, items)
    clean = decontamination.clean_documents(clashing(docs), table, block_words=block_words)
    # Each row goes or stays by its own text, whatever ids it shares.
    good = [i for i, t in rows if not brute_hits([(i, t)], items)[0][5]]
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted(good, key=str)
    assert clean.columns == clashing(docs).columns


def test_passages_are_cut_out(spark, documents):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = documents((1, f"Before, {item.title()}; after."), (2, "nothing here"), (3, None), (4, ""))
    got = {r.doc_id: r.text for r in decontamination.without_passages(docs, spark.createDataFrame([(1, item)], BENCHMARK)).collect()}
    assert got == {1: "Before, ; after.", 2: "nothing here", 3: None, 4: ""}
    none = spark.createDataFrame([], BENCHMARK)
    assert decontamination.without_passages(docs, none).count() == 4
    assert decontamination.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontamination.contamination(docs.limit(0), none).count() == 0


def test_line_dedup(documents, clashing):
    rng = random.Random(11)
    long = prose(rng, 60)
    near = long.replace(long.split()[30], "other")
    far = prose(rng, 60)
    rows = [(1, f"{far}\n{long}\nshort one"), (2, f"{near}\nshort one\n{prose(rng, 20)}"), (3, f"{long.upper()}, !\n"), (4, long), (4, long),
            (5, None), (6, ""), (7, "a\n\nb"), (None, far)]
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup_lines(clashing(documents(*rows))).collect()), key=str)
    kept2 = rows[1][1].split("\n", 1)[1]
    expected = {1: f"{long}\nshort one", 3: "", 5: None, 6: "", 7: "a\n\nb"}
    texts = {}
    for i, t, n in got:
        texts.setdefault(i, []).append(t)
        assert n == len(t or "")
    assert texts[None] == [far] and texts[4] == ["", ""]
    assert all(texts[i] == [t] for i, t in expected.items())
    assert texts[2] in ([kept2], [rows[1][1]])  # a changed word may move the SimHash farther than three bits
    assert line_dedup.dedup_lines(documents(*rows).limit(0)).count() == 0


def test_line_groups_equal_brute_force(documents):
    """Every pair within three bits and the edit similarity is connected, and nothing else."""
    rng = random.Random(2)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(12)]
    lines = list(base)
    for text in base:
        for _ in range(8):
            parts = text.split()
            for _ in range(rng.randrange(1, 4)):
                parts[rng.randrange(len(parts))] = rng.choice(WORDS)
            lines.append(" ".join(parts))
    lines = list(dict.fromkeys(lines))
    prints = {t: int(p) for t, p in zip(lines, line_dedup.line_prints([t.encode() for t in lines])[5])}
    linked = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 and line_dedup.edit_similarity(a.encode(), b.encode(), 0.8) >= 0.8
    groups = reachable(lines, linked)
    order = {t: i for i, t in enumerate(lines)}
    repeated = {order[t] for t in lines if order[t] != min(order[m] for m in groups[t])}
    docs = documents(*((i, t) for t, i in order.items()))
    for slice_lines in (4000, 2):
        got = line_dedup.repeated_lines(docs, slice_lines=slice_lines)
        assert {r.doc_id for r in got.collect()} == repeated and len(repeated) > 10


def test_many_prints_of_a_key_find_the_same_partners(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    number, masks = 0, np.array([m for _, m in line_dedup.block_keys()], np.uint64)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    prints = np.concatenate([base ^ np.uint64(1 << b) for b in (0, 20, 30, 45, 63)] + [base]) & ~masks[number]
    whole = line_dedup._with_partner(prints, number, masks)
    monkeypatch.setattr(line_dedup, "_TILE", 16)
    assert (line_dedup._with_partner(prints, number, masks) == whole).all() and whole.any()


def test_small_and_large_groups_find_the_same_partners(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    masks = np.array([m for _, m in line_dedup.block_keys()], np.uint64)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 3))) for _ in range(6))]))
    rows = sorted((k, int(p) & int(m), int(p)) for k, m in enumerate(masks) for p in prints)
    keys, at, values = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows], np.uint64)
    small = line_dedup._partners(keys, at, values, masks)
    monkeypatch.setattr(line_dedup, "_SMALL", 1)
    assert line_dedup._partners(keys, at, values, masks).tolist() == small.tolist()
    near = {int(p) for p in prints if any(0 < (int(p) ^ int(q)).bit_count() <= 3 for q in prints)}
    assert {int(values[i]) for i in small} == near and len(near) > 30


def test_edit_similarity():
    rng = random.Random(4)

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, before = [i, *row[1:]], row
            for j, b in enumerate(y, 1):
                row[j] = min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1)
        return 1 - row[-1] / max(len(x), len(y))

    for _ in range(300):
        x = [rng.choice("abc") for _ in range(rng.randrange(1, 15))]
        y = [c for c in x if rng.random() < 0.9] or ["a"]
        y.insert(rng.randrange(len(y) + 1), "z")
        want = plain(x, y)
        got = line_dedup.edit_similarity(" ".join(x).encode(), " ".join(y).encode(), 0.8)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_quotas_and_flow():
    targets = mixing.quotas({"a": 60, "b": 30, "c": 10}, {"a": 1, "b": 2, "c": 3})
    assert float(sum(targets.values())) == pytest.approx(100) and float(targets["c"]) == 30
    assert float(targets["b"]) == pytest.approx(2 * float(targets["a"]))
    # Tokens that two sources share go where the quota can't be met without repeats.
    flow = mixing.route([(("a",), 50), (("a", "b"), 50), (("b",), 10)], {"a": 60, "b": 40})
    assert flow[0, "a"] == 50 and flow[1, "a"] == 10 and flow.get((1, "b"), 0) + flow.get((2, "b"), 0) == 40
    flow = mixing.route([(("a", "b"), 10)], {"a": 40, "b": 0})
    assert flow == {(0, "a"): 30}


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    targets, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / whole > 3 * sizes[s]}
        targets.update({s: 3.0 * sizes[s] if s in above else left * weight[s] / whole for s in open_})
        if not above:
            break
        left -= sum(targets[s] for s in above)
        open_ -= above
    return targets


def test_mix(documents, clashing):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 80)), rng.choice(["b", "a", None, "c", "rare" if i % 50 == 0 else "a"])) for i in range(400)]
    rows += [(1, rows[1][1], rows[1][2]), (500, None, "empty"), (501, "", "a"), (None, "x y", "a")]
    docs = clashing(documents(*rows)).drop("size")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.taken in {r["size"] * k for k in range(4)} and r.pattern_size == sizes[r.sources[0]]
        assert r.quota == pytest.approx(targets[r.sources[0]])
        taken[r.sources[0]] = taken.get(r.sources[0], 0) + r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 40 or sizes[s] < 200
    again = sorted(((r.doc_id, r.taken) for r in mixing.mix(docs).collect()), key=str)
    assert again == sorted(((r.doc_id, r.taken) for r in got), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_of_overlapping_sources(documents):
    rng = random.Random(1)
    docs = documents(*((i, prose(rng, 10)) for i in range(90))).drop("source").withColumn(
        "sources", F.expr("CASE doc_id % 3 WHEN 0 THEN array('a') WHEN 1 THEN array('a', 'b', 'a') END"))
    got = mixing.mix(docs, weights={"a": 1, "b": 1}).collect()
    assert {tuple(r.sources) for r in got} == {("a",), ("a", "b"), (None,)}
    assert sum(r.taken for r in got) > 0


def test_rows_sharing_an_id_are_rows_of_their_own(spark, documents):
    """Shared and null ids: no row goes, and no line, because of another row with its id."""
    rng = random.Random(12)
    own = [prose(rng, 30) for _ in range(6)]
    kept = simhash.keep_one(documents((1, own[0]), (1, own[1]), (2, own[2]), (3, own[1]), (3, own[3]), (None, own[0]), (None, own[0])))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, own[0]), (1, own[1]), (2, own[2]), (3, own[3]), (None, own[0]), (None, own[0])], key=str)
    table = spark.createDataFrame([(1, own[4])], BENCHMARK)
    clean = decontamination.clean_documents(documents((None, own[0]), (None, own[4]), (None, None), (7, own[4]), (7, own[1])), table)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([(None, own[0]), (None, None), (7, own[1])], key=str)
    rows = [(1, own[0]), (2, own[0]), (2, own[1] + "\n" + own[2]), (None, own[3]), (4, own[3]), (5, own[3] + "\n" + own[5])]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(*rows)).collect()), key=str)
    assert got == sorted([(1, own[0]), (2, ""), (2, own[1] + "\n" + own[2]), (None, own[3]), (4, ""), (5, own[5])], key=str)


def test_a_row_without_an_id_breaks_no_link(documents):
    """A line that also stands in a row without an id is still linked to lines near it."""
    base = [f"word{i}" for i in range(100)]
    prints = {}
    for k in range(100):
        line = " ".join(base[:k] + [f"other{k}"] + base[k + 1:])
        prints[line] = int(line_dedup.line_prints([line.encode()])[5][0])
    first = " ".join(base)
    own = int(line_dedup.line_prints([first.encode()])[5][0])
    near = next(t for t, p in prints.items() if (own ^ p).bit_count() <= 3)
    for extra in ([], [(None, first)]):
        got = line_dedup.repeated_lines(documents((1, first), (2, near), *extra)).collect()
        assert 2 in {r.doc_id for r in got}


@pytest.mark.parametrize("n", [1, 2, 7, 63, 64, 65, 200])
def test_word_distance_equals_the_plain_table(n):
    rng = random.Random(n)
    for _ in range(30):
        x = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
        y = list(x)
        for _ in range(rng.randrange(1 + n // 4)):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.randrange(2)] = [rng.choice([b"a", b"d"])] * rng.randrange(2)
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            new = [i]
            for j, b in enumerate(y, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        assert line_dedup.word_distance(x, y) == line_dedup.word_distance(y, x) == row[-1]
        assert line_dedup.alike(x, y, 0.8) == (row[-1] <= int(0.2 * max(len(x), len(y)) + 1e-9))


def test_a_batch_is_cut_before_it_is_looked_at(spark, documents):
    """Texts go to the tasks once, and what a slice takes does not depend on the batch."""
    import tracemalloc

    import pyarrow as pa

    from tickettide.llm import quality
    from tickettide.llm.common import text_slices

    windows = decontamination.window_index(["a"], [b"some words of a benchmark item"], 13)
    batch = pa.array(["word " * 400, None] * 4000)
    tracemalloc.start()
    seen = [len(decontamination.hits(part, windows)[0]) for _, _, part in text_slices(batch, decontamination._BATCH_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(seen) == len(batch) and peak < 120 << 20
    docs = documents((1, "a b"), (2, None))
    benchmark = spark.createDataFrame([("x", "one two three")], "item_id string, text string")
    for rows in (decontamination.clean_documents(docs, benchmark), quality.score(docs, quality.start_model())):
        assert rows.count() == 2 and "bytes of the text" not in rows._jdf.queryExecution().toString()


def test_slots_tell_keys_and_values_apart():
    import numpy as np

    prints = np.random.default_rng(3).integers(0, 1 << 63, 500).astype(np.uint64)
    for number, mask in line_dedup.block_keys():
        slots, at = line_dedup._slots(prints, number), prints & np.uint64(mask)
        assert (slots >> line_dedup._SLOT_BITS == number).all()
        assert len(set(slots.tolist())) == len(set(at.tolist())) == len(set(zip(slots.tolist(), at.tolist())))
