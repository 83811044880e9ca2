"""Main text of pages by differencing each page with its nearest one by URL.

Pages are sorted by host and path over evenly sized blocks, so a host with a
third of all pages is spread over as many tasks as its rows need. Each page's
text lines are aligned, by longest common subsequence, with those of the
neighbour whose path shares the longest beginning and which is no copy of it,
and shared lines are deleted. Markup is further evidence: what stands in a menu,
header, footer, sidebar, notice, advert, form or comment goes as well. Of the
elements that mark an article those stay that keep a line of their own, with
all their lines, since two articles may share some; where a page has such an
element, what is outside of it goes. One shuffle of the pages; a task holds three
and the names of the exact copies of one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.llm.common import text_bytes

# Possessive, so that broken quotes cost one scan; a tag that they break ends at its first ">".
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
#: Fixed values of HTML: elements whose text is no text, elements without an end, and inline elements.
RAW = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "head", "select", "option", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements, roles and words of class or id names that hold no main text.
SIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
SIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies",
              "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "sidebar", "side", "menu", "menus", "nav", "navbar",
              "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "disqus", "share", "sharing", "social",
              "related", "widget", "login", "pagination", "pager", "toolbar"}
MAIN = {"article", "main"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _is_side(tag: str, own: dict[str, str]) -> bool:
    if tag in SIDE:
        return True
    if not own or tag in ("html", "body", *MAIN):
        return False
    words = set(re.split(r"[^a-z0-9]+", f"{own.get('class', '')} {own.get('id', '')}".lower()))
    hidden = "hidden" in own or re.search(r"display\s*:\s*none", own.get("style", "").lower())
    return bool(own.get("role", "").lower() in SIDE_ROLES or words & SIDE_WORDS or hidden)


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """The page's blocks of text in order as (text, article, in a side part).

    The article is the number, from 1, of the innermost element around the block
    that marks one, or 0.

    Character references are decoded, white space becomes single blanks; a block
    ends at every tag that is not inline. Comments, scripts and styles have no
    text. Unclosed elements end with the page, or with the element around them.
    """
    lines: list[tuple[str, int, bool]] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, side part, article; of those that matter and what nests in them
    opened: Counter[str] = Counter()  # how many of each tag are among them
    sides = marked = 0
    mains = [0]  # the numbers of the open articles
    buffer: list[str] = []
    state = (0, False)

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                lines.append((text, *state))

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        if at > last and not page.startswith("<!--", at):
            # Nothing after the last ">" is a tag; up to a comment it is text.
            comment = page.find("<!--", at)
            buffer.append(page[at : comment if comment >= 0 else end])
            at = comment if comment >= 0 else end
            continue
        token = _TOKEN.match(page, at)
        at = token.end()
        tag = token[2] or token[5]
        if tag is None:
            whole = token[0]
            if whole == "<" or not whole.startswith(("<!", "<?")):
                buffer.append(whole)
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img", "wbr"):
            buffer.append("" if tag == "wbr" else " ")
        rest = token[3] or token[6] or ""
        if token[1] or token[4]:
            if opened[tag]:
                while open_:
                    name, side, main = open_.pop()
                    opened[name] -= 1
                    sides -= side
                    if main:
                        mains.pop()
                    if name == tag:
                        break
                if (mains[-1], sides > 0) != state:
                    flush()
                    state = (mains[-1], sides > 0)
            continue
        if tag in VOID or rest.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            if tag in ("head", "noscript"):
                # A head ends with its end tag, or where the body begins.
                stop = re.compile(rf"</{tag}\s*>|(?=<body[\s>])" if tag == "head" else rf"</{tag}\s*>", re.I).search(page, at)
            else:
                stop = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        own = _attributes(rest)
        side, main = _is_side(tag, own), tag in MAIN or own.get("role", "").lower() == "main"
        if side or main or (open_ and tag not in ("p", "li", "b", "i")):
            open_.append((tag, side, main))
            opened[tag] += 1
            sides += side
            if main:
                marked += 1
                mains.append(marked)
            if (mains[-1], sides > 0) != state:
                flush()
                state = (mains[-1], sides > 0)
    flush()
    return lines


def shared_lines(own: list[str], other: list[str]) -> set[int]:
    """Places in `own` of the lines of a longest common subsequence with `other`.

    Runs of equal lines count as one, and share when the line is shared.
    """
    runs, first = [], []
    for i, line in enumerate(own):
        if not runs or line != runs[-1]:
            runs.append(line)
            first.append(i)
    first.append(len(own))
    places: dict[str, list[int]] = {}
    before = None
    for j, line in enumerate(other):
        if line != before:
            places.setdefault(line, []).append(j)
        before = line
    # The longest increasing run of matching places: last[k] ends one of k + 1 lines.
    last: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(runs):
        for j in reversed(places.get(line, ())):
            k = bisect_left(last, j)
            link = (i, links[k - 1] if k else None)
            if k == len(last):
                last.append(j)
                links.append(link)
            elif j < last[k]:
                last[k], links[k] = j, link
    found: set[int] = set()
    link = links[-1] if links else None
    while link:
        found.update(range(first[link[0]], first[link[0] + 1]))
        link = link[1]
    return found


def main_text(lines: list[tuple[str, int, bool]], others: list[list[tuple[str, int, bool]]]) -> tuple[str, int]:
    """The main text of a page given its nearest ones, nearest first, and how many lines are shared.

    Lines shared with the nearest page are deleted, and side parts. A marked
    article that keeps a line keeps all of them; one that keeps none goes, and so
    does what no article holds where the page has one. A page that shares its
    whole main part, the longest article or all that is no side part, is a copy
    and tells nothing: the next one is taken, and without any nothing is shared.
    """
    body = [(i, text, article) for i, (text, article, side) in enumerate(lines) if not side]
    articles: dict[int, int] = {}
    for _, text, article in body:
        if article:
            articles[article] = articles.get(article, 0) + len(text)
    longest = max(articles, key=articles.get) if articles else 0
    core = {i for i, _, article in body if article == longest}
    shared: set[int] = set()
    for other in others:
        found = shared_lines([t for t, _, _ in lines], [t for t, _, _ in other])
        if not core <= found:
            shared = found
            break
    own = [(i, text, article) for i, text, article in body if i not in shared]
    if articles:
        kept = {article for _, _, article in own if article}
        own = [(i, text, article) for i, text, article in body if article in kept]
    return "\n".join(text for _, text, _ in own), len(shared)


def host_of(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?(.*)$", 1), F.lit(""))


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


_ORDER = ("host", "path", "page_id", "print")


def _edges(stream):
    """Of the sorted rows of a task: the first, the first that differs from it in its print, and the same from the end."""
    first = second = last = other = None
    for batch in stream:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            first = first or row
            second = second or (row if row[3] != first[3] else None)
            if last and last[3] != row[3]:
                other = last
            last = row
    if first:
        rows = (first, second, other, last)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(4), pa.int32()), pa.array([r is not None for r in rows]),
             *(pa.array([r and r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["edge", "there", *_ORDER])


def _key(row: tuple) -> tuple:
    """A row's place in Spark's order, nulls first and texts by their bytes, for comparing here."""
    host, path, page_id, print_ = row
    return host.encode(), path.encode(), page_id is not None, page_id or 0, print_


def _blocks(names: DataFrame, parts: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """Where blocks begin, and which blocks need which rows of others beside their own.

    These are the last row before the block that is no copy of its first one,
    and the first row after it that is no copy of its last one.
    """
    edges = names.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(
        _edges, "edge int, there boolean, host string, path string, page_id long, print long")
    rows = edges.withColumn("task", F.spark_partition_id()).sort("task", "edge").collect()  # four a task
    ends = [[tuple(r[c] for c in _ORDER) if r["there"] else None for r in rows[i : i + 4]] for i in range(0, len(rows), 4)]
    guests: dict[tuple, list[int]] = {}
    for k, (first, _, _, last) in enumerate(ends):
        before = next((x for e in reversed(ends[:k]) for x in (e[3], e[2]) if x and x[3] != first[3]), None)
        after = next((x for e in ends[k + 1 :] for x in (e[0], e[1]) if x and x[3] != last[3]), None)
        for row in (before, after):
            if row:
                guests.setdefault(_key(row), []).append(k)
    return [_key(e[0]) for e in ends], guests


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared): the main text of every page.

    The nearest pages are those before and after it in the order of host, path
    and page_id, of the same host and not with the very same html; the one whose
    path agrees longer with the page's own is nearer, the one before at a tie.
    Where tasks begin and end makes no difference: the order is cut into blocks
    on the names alone, and a block gets the pages beside it as guests. A null
    html is empty, a null url has no host and is paired with others of its kind.
    Empty pages have an empty text. Repeated rows stay.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("html"))
    rows = rows.withColumns({"host": host_of(), "path": path_of(), "print": F.xxhash64("html")})
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["page_id", "url", "text", "n_chars", "n_lines", "n_shared"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    def made(before, lines, copies, after):
        """Rows of the copies of one page, given the pages before and after them."""
        texts: dict[tuple, tuple] = {}
        for page_id, url, host, path in copies:
            near = [(-_common(path, x[1]), k) for k, x in enumerate((before, after)) if x and x[0] == host]
            order = tuple(k for _, k in sorted(near))
            if order not in texts:
                texts[order] = main_text(lines, [(before, after)[k][2] for k in order])
            text, shared = texts[order]
            yield page_id, url, text, len(text), len(lines), shared

    def run(stream):
        before = last = lines = current = None
        copies, done, size = [], [], 0
        for batch in stream:
            for page_id, url, page, host, path, print_, guest in zip(*(c.to_pylist() for c in batch.columns)):
                if print_ != current:
                    after = (host, path, page_lines(page.decode("utf-8", "replace")))
                    for row in made(before, lines, copies, after):
                        done.append(row)
                        size += len(row[2])
                        if size > 1 << 20:
                            yield packed(done)
                            done, size = [], 0
                    before, lines, current, copies = last, after[2], print_, []
                last = (host, path, lines)
                if not guest:
                    copies.append((page_id, url, host, path))
        done += made(before, lines, copies, None)
        yield packed(done)

    begins, guests = _blocks(rows.select(*_ORDER), parts)

    @F.arrow_udf("array<int>")
    def block_of(host: pa.Array, path: pa.Array, page_id: pa.Array, print_: pa.Array) -> pa.Array:
        keys = [_key(row) for row in zip(*(c.to_pylist() for c in (host, path, page_id, print_)))]
        return pa.array([[max(0, bisect_right(begins, k) - 1), *(-1 - b for b in guests.get(k, ()))] for k in keys], pa.list_(pa.int32()))

    dealt = rows.withColumn("block", F.explode(block_of(*_ORDER))).withColumns(
        {"guest": F.col("block") < 0, "block": F.when(F.col("block") < 0, -1 - F.col("block")).otherwise(F.col("block"))})
    sorted_rows = dealt.repartitionById(parts, "block").sortWithinPartitions(*_ORDER).select(
        "page_id", "url", "html", "host", "path", "print", "guest")
    return sorted_rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long")
