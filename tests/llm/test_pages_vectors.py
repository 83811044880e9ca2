"""Archives, page text, vectors and token counts against brute force, round trips and odd rows."""

import base64
import gzip
import hashlib
import io
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickettide.llm import archives, html_text, token_counts, vptree
from tickettide.llm.common import work_path

PAGES = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 3])
def test_archive_round_trip(spark, clashing, least):
    rows = [(5, "http://a/x y", "same"), (3, "http://b", "same"), (3, "http://b", "same"), (9, None, None), (8, "ftp://c", ""), (7, "http://d\n", "é" * 9),
            (None, "http://e", "same"), (1, "http://f", "HTTP/1.1 200\r\n\r\nnot a head"), (2, "http://g", "<p>\r\n\r\nx</p>" * 5000)]
    got = archives.archive_round_trip(clashing(spark.createDataFrame(rows, PAGES)).repartition(3), least).collect()
    assert len(got) == len(rows)
    texts = {(i, sha(t), len((t or "").encode())) for i, _, t in rows}
    assert {(r.page_id, r.payload_digest, r.payload_bytes) for r in got} == texts
    by = {}
    for r in got:
        by.setdefault((r.payload_digest, r.payload_bytes), []).append(r)
    for (_, size), members in by.items():
        firsts = [r for r in members if r.record_type == "response"]
        assert all(r.refers_to is None for r in firsts)
        if size < least:
            assert len(firsts) == len(members)
            continue
        lowest = min(r.page_id for r in members if r.page_id is not None)
        assert [r.page_id for r in firsts] == [lowest]
        assert all(r.refers_to == lowest for r in members if r.record_type == "revisit")
    assert archives.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_convert(version):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nbody\n\nwith lines"
    file = archives.arc_head("x.arc", version) + archives.arc_record(version, "http://a b/c", "20031224", "text/html", block, "x.arc", 0)
    file += b"\n\n" + archives.arc_record(version, "dns:a", "20031224235959", "text/dns", b"1.2.3.4", "x.arc", 9)
    records = list(archives.read_arc(io.BytesIO(file)))
    assert [r["URL"] for r in records[1:]] == ["http://a b/c", "dns:a"] and records[1]["block"] == block
    warc = b"".join(archives.to_warc(r, "x.arc") for r in records)
    found = list(archives.read_warc(io.BytesIO(warc)))
    assert [h["warc-type"] for h, _ in found] == ["warcinfo", "response", "resource"]
    head, body = found[1]
    assert body == block and head["warc-date"] == "2003-12-24T00:00:00Z" and head["warc-target-uri"] == "http://a b/c"
    assert head["warc-payload-digest"] == "sha1:" + sha("body\n\nwith lines") and head["warc-record-id"].startswith("<urn:uuid:")
    assert found[2][0]["warc-date"] == "2003-12-24T23:59:59Z"
    revisit = archives.to_warc(records[1], "x.arc", {"id": "<urn:uuid:1>", "url": "http://o", "date": "2000-01-01T00:00:00Z"})
    (head, body), = archives.read_warc(io.BytesIO(revisit))
    assert head["warc-type"] == "revisit" and head["warc-refers-to"] == "<urn:uuid:1>" and body == block.partition(b"body")[0]


@pytest.mark.parametrize("broken", [b"http://a 0.0.0.0 1 t 5\nhello\n", b"filedesc://x 0 0 t 12\n3 0 x\nURL L\n\n", None])
def test_broken_arcs_are_errors(broken):
    whole = archives.arc_head("x", 1) + archives.arc_record(1, "http://a", "2003", "t", b"hello", "x", 0)
    with pytest.raises(archives.ArcError):
        list(archives.read_arc(io.BytesIO(whole[:-4] if broken is None else broken)))


def test_archives_roll_and_are_plain_files(spark):
    rows = spark.createDataFrame([(i, f"http://h/{i}", "x" * 1000) for i in range(50)], PAGES).coalesce(1)
    arcs = archives.write_arc(rows, work_path(spark, "test"), archive_bytes=10_000).collect()
    assert len(arcs) > 4 and sum(r.records for r in arcs) == 50 + len(arcs)
    with gzip.open(archives.open_file(arcs[1].archive, "rb")) as file:
        assert file.readline().endswith(b"\n") and b"2 0 tickettide" in file.readline()


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (["".join(rng.choice("abcdef"))] for _ in range(2))
        a = [rng.choice("abcdef") for _ in range(rng.randrange(15))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(15))]
        squeezed = lambda x: [c for i, c in enumerate(x) if i == 0 or c != x[i - 1]]
        found = sorted(html_text.shared_lines(a, b))
        runs = squeezed([a[i] for i in found])
        assert lcs(runs, b) == len(runs)
        shared_runs = len({sum(a[k] != a[k - 1] for k in range(1, i + 1)) for i in found})
        assert shared_runs == lcs(squeezed(a), squeezed(b))


def test_page_text(spark, clashing):
    article = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><article><h1>A &amp; B&nbsp;c</h1><p>one<b>two</b>\n three<p>four" \
              "<div class='comments'><p>no</div><form>no</form></article><footer>foot</footer><script>var x='<p>no</p>'</script></body></html>"
    plain = "<body><div>Shared menu line</div><p>Own text {0}</p><p>more {0} &lt;kept&gt;</p><div>Shared end line</div><div id='cookie-notice'>ok?</div></body>"
    rows = [(1, "http://a/x/1", article), (2, "http://a/y/1", plain.format("first")), (3, "http://a/y/2", plain.format("second")),
            (4, "http://b/z", plain.format("alone")), (5, None, None), (6, "", ""), (7, "http://c/1", "<p>copy</p><p>two</p>"), (8, "http://c/2", "<p>copy</p><p>two</p>"),
            (8, "http://c/2", "<p>copy</p><p>two</p>"), (None, "http://d", "a < b <a href='x>y'>c</a> <p"), (9, "http://e", "<div " + "\"'" * 2000)]
    got = html_text.extract(clashing(spark.createDataFrame(rows, PAGES)).coalesce(1)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert texts[1] == "A & B c\nonetwo three\nfour"
    assert texts[2] == "Own text first\nmore first <kept>" and texts[3] == "Own text second\nmore second <kept>"
    assert texts[4].startswith("Shared menu line\nOwn text alone")
    assert texts[5] == texts[6] == "" and texts[7] == texts[8] == "copy\ntwo"
    assert texts[None] == "a < b c <p"
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_differencing_chooses_among_marked_articles(spark):
    """An article that stands on the next page as well is none; a copy of the page tells nothing, and the page beside it is taken."""
    teaser = "<article><h2>Most read</h2><p>The same on every page</p></article>"
    page = "<body>" + teaser + "<article><h1>Title {0}</h1><p>A line of two articles</p><p>own {0}</p></article><p>outside {0}</p></body>"
    rows = [(1, "http://a/1", page.format("one")), (2, "http://a/2", page.format("two")), (3, "http://a/21", page.format("two")),
            (4, "http://a/22", page.format("two").replace("outside two", "advert")), (5, "http://b/1", page.format("alone"))]
    texts = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    own = "Title {0}\nA line of two articles\nown {0}"
    assert texts[1] == own.format("one") and texts[2] == texts[3] == own.format("two")
    assert texts[4] == texts[5].replace("alone", "two") == "Most read\nThe same on every page\n" + own.format("two")


@pytest.mark.parametrize("copies", [0, 9])
def test_pairs_do_not_depend_on_where_tasks_begin(spark, copies):
    page = "<p>menu {1}</p><p>own text of {0}</p><p>end {1}</p>"
    rows = [(i, f"http://a/{i // 7}/{i}", page.format(i, i % 7 // 2)) for i in range(60)]
    rows += [(100 + i, f"http://a/4/3{i}", page.format("a copy", 1)) for i in range(copies)] + [(None, "http://a/4/31", None), (7, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    got = []
    for parts in ("1", "3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(sorted(html_text.extract(pages).collect(), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert all("own text of" in r.text for r in got[0] if r.page_id and r.page_id != 7)


def test_page_text_equals_the_articles(spark):
    """On the test pages, whose articles hold headings and paragraphs only."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>|<br>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


def brute_nearest(rows, every, most):
    out = []
    usable = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = {(i, tuple(v)) for i, v in rows if i is not None and usable(v)}
    for i, q in rows:
        if i % every == 0:
            found = sorted((-float(np.dot(q, v)), j) for j, v in rows if j != i and len(v) == len(q))
            out += [(i, k + 1, j, round(-s, 9)) for k, (s, j) in enumerate(found[:most])]
    return sorted(out)


def test_nearest_vectors(spark, clashing):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 5)) * 3
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(size=5) * 0.3]) for i in range(240)]
    hot = [1.0, 2.0, 0.0, -1.0, 0.5]
    rows += [(1000 + i, hot) for i in range(120)] + [(20, rows[20][1]), (2000, None), (2020, [0.0] * 5), (2040, [float("nan")] * 5), (2060, [float("inf"), 1.0, 1.0, 1.0, 1.0]),
             (2080, [None, 1.0, 1.0, 1.0, 1.0]), (2100, []), (None, hot), (2120, [1.0, 2.0]), (2121, [3.0, 1.0])]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for shard_rows, block_rows in ((65_536, 32_768), (40, 7)):
        got = vptree.nearest(table, factor=1.0, shard_rows=shard_rows, block_rows=block_rows)
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()) == brute_nearest(rows, 20, 20)
    assert vptree.nearest(table.limit(0)).count() == 0


def test_recall_of_the_production_factor(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = total = 0
    found = {}
    for r in vptree.nearest(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, got in found.items():
        scores = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len(got & set(ids[np.argsort(-scores, kind="stable")[:20]]))
        total += 20
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * total


@pytest.mark.parametrize("leaf", [4, 64])
def test_factor_one_is_exact_and_a_tree_prunes(leaf):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)), 50, axis=0) + rng.normal(size=(2000, 8)) * 0.05
    x *= rng.uniform(0.5, 2, (2000, 1))
    queries = x[::40]
    _, scores = vptree.search(x, queries, 10, 1.0, leaf)
    assert np.allclose(scores, np.sort(queries @ x.T, axis=1)[:, ::-1][:, :10])
    points, length = vptree.lifted(x)
    tree = vptree.Tree(points, leaf)
    q = np.concatenate([queries * (length / np.linalg.norm(queries, axis=1))[:, None], np.zeros((len(queries), 1))], axis=1)
    lower = tree.bounds(q)
    for i, (rows, *_) in enumerate(tree.leaves):
        far = np.sqrt(((q[:, None] - points[rows][None]) ** 2).sum(axis=2)).min(axis=1)
        assert (lower[:, i] <= far + 1e-9).all()
    assert (lower > 0.5).any()


def encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    return tiktoken.Encoding("whole", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_counts_follow_edits():
    """Every count after random edits equals encoding the new text as a whole."""
    rng, count, encode = random.Random(3), token_counts.counter(), encoder()
    pieces = ["a", "b", "'", "l", "s", " ", "  ", "\n", "1", "é", "ß", "!", "re", "'ve", "\t", "word", " the"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))
        leaf = rng.choice([1, 2, 3, 8])
        tree = token_counts.Tree(token_counts.cut(text, count, leaf))
        for _ in range(3):
            first = rng.randrange(len(text) + 1)
            last, new = min(len(text), first + rng.choice([0, 0, 1, 5])), "".join(rng.choice(pieces) for _ in range(rng.choice([0, 0, 1, 3])))
            tree, after, _ = token_counts.edit(tree, text, first, last, new, count, leaf)
            text = text[:first] + new + text[last:]
            assert after == text and tree.total[0] == len(text) and tree.total[2] == len(encode(text))
            assert (tree.sums[1] == np.sum(tree.leaves(), axis=0)).all() if tree.leaves() else True


def test_an_edit_touches_little():
    count = token_counts.counter()
    text = "some plain words of a long text " * 5000
    tree = token_counts.Tree(token_counts.cut(text, count))
    _, _, again = token_counts.edit(tree, text, 50_000, 50_004, "other", count)
    assert again < 300


def test_edited_documents(spark, documents, clashing):
    encode = encoder()
    rows = [(1, "mail me@example.org or 10.0.0.1 now"), (2, "nothing"), (3, None), (4, ""), (5, "id 123456789012"), (5, "id 123456789012"), (None, "x@y.zz"), (6, "a@b.cc " * 3000)]
    got = token_counts.edited_counts(clashing(documents(*rows))).collect()
    import regex

    want = sorted(((i, len(encode(t or "")), len(encode(regex.sub(token_counts.PERSONAL, token_counts.MASK, t or "")))) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_before, r.n_tokens) for r in got), key=str) == want
    table = token_counts.with_trees(clashing(documents((1, "abc def"), (2, None), (3, "x"))))
    edits = table.drop("edits").withColumn("edits", F.expr("""CASE doc_id WHEN 1 THEN array(
        named_struct('first', 4L, 'last', 999L, 'new', CAST(NULL AS STRING)), named_struct('first', 0L, 'last', 0L, 'new', 'Z'))
        WHEN 2 THEN array(named_struct('first', 3L, 'last', 5L, 'new', 'new')) END"""))
    assert {r.doc_id: r.text for r in token_counts.apply_edits(edits).collect()} == {1: "Zabc ", 2: "new", 3: "x"}
    assert token_counts.edited_counts(documents((1, "a")).limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<!" * 500_000, "<p>" + "<" * 1_000_000, "<div class=x>" * 40_000 + "</span>" * 40_000 + "</b>" * 20_000,
    "<nav>" + "<div>" * 80_000 + "</nav>" * 3 + "</div>" * 80_000,
])
def test_a_megabyte_of_broken_markup_takes_seconds(page):
    start = time.process_time()
    html_text.page_lines(page)
    assert time.process_time() - start < 5


@pytest.mark.parametrize("page, text", [
    ("<p>one</p> two < three <b", ["one", "two < three <b"]), ("a<!-- never", ["a"]), ("<p>x</p>1 <a 2<!-- c <a 3", ["x", "1 <a 2"]),
    ("<nav><div>in</nav>out", ["in", "out"]), ("<nav><div>in</div></span>still</nav>out", ["in", "still", "out"]),
])
def test_what_follows_the_last_tag_is_text(page, text):
    assert [t for t, _, _ in html_text.page_lines(page)] == text


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_archives_are_converted_by_many_tasks(spark, threshold):
    """Whether the join with the revisits is by broadcast or not, its rows are dealt out anew."""
    pages = spark.createDataFrame([(i, f"http://h{i}/", f"<p>{i % 20}</p>") for i in range(60)], "page_id long, url string, html string").repartition(12)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        arcs = archives.write_arc(pages, work_path(spark, "arc"))
        warcs = archives.convert(arcs, work_path(spark, "warc"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert arcs.count() == 12 and len(warcs.inputFiles()) > 1
