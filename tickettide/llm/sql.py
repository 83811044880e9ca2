"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK_HITS = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), found AS (
  SELECT g.r, g.i, g.n, m.item FROM grams g JOIN windows m ON g.n = m.n AND g.gram = m.gram
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

# Base32 of the SHA-1's 160 bits, twenty bits (five hex digits) at a time.
_TWENTY = "CAST('0x' || substr(hex, {0}, 5) AS BIGINT)"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({_TWENTY.format(5 * k + 1)} >> {n}) & 31) AS INTEGER) + 1, 1)"
    for k in range(8) for n in (15, 10, 5, 0)
)

ARCHIVED_PAGES = f"""
WITH pages_ AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digests AS (
  SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
         min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id FROM pages_
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM digests
"""

NEAREST_VECTORS = """
WITH vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _pick(before: str, after: str, choice: str) -> str:
    """One more document per source, the first by `choice` of those that it allows."""
    where, order = choice.split(" BY ")
    return f"""
{after} AS (
  SELECT d.*, d.more OR coalesce(row_number() OVER (PARTITION BY src, (NOT more AND size > 0 AND ({where}))
                                                    ORDER BY {order}) = 1 AND NOT more AND size > 0 AND ({where}), false) AS chosen,
  FROM (SELECT *, rest - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY src) AS gap FROM {before}) d
), {after}_ AS (SELECT * EXCLUDE (more, chosen, gap), chosen AS more FROM {after})"""


_LARGEST = "size <= gap BY size DESC, turn DESC, doc_id DESC, r DESC"

SOURCE_MIX = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn
  FROM documents
), sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS total,
         CAST(1 + (row_number() OVER (ORDER BY src IS NULL, src) - 1) % 3 AS BIGINT) AS weight FROM docs GROUP BY src
), filled AS (
  SELECT *, sum(total) OVER () - coalesce(sum(3 * total) OVER ranked, 0) AS left_,
         sum(weight) OVER () - coalesce(sum(weight) OVER ranked, 0) AS weights
  FROM sources
  WINDOW ranked AS (ORDER BY 3.0 * total / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, left_ * weight > 3 * total * weights AS above FROM filled
), level AS (
  SELECT (SELECT sum(total) FROM sources) - coalesce(sum(CASE WHEN above THEN 3 * total END), 0) AS left_over,
         sum(CASE WHEN above THEN 0 ELSE weight END) AS open_weight
  FROM capped
), targets AS (
  SELECT src, total, CASE WHEN above THEN CAST(3 * total AS DOUBLE)
                          ELSE CAST(left_over * weight AS DOUBLE) / CAST(open_weight AS DOUBLE) END AS target
  FROM capped, level
), sent AS (
  SELECT *, least(CAST(round_even(target, 0) AS BIGINT), 3 * total) AS sent FROM targets
), plan AS (
  SELECT *, CASE WHEN total > 0 THEN sent // total ELSE 0 END AS times, CASE WHEN total > 0 THEN sent % total ELSE 0 END AS rest FROM sent
), d0 AS (
  SELECT r, doc_id, d.src, size, turn, total, target, times, rest,
         rest > 0 AND sum(size) OVER (PARTITION BY d.src ORDER BY turn, doc_id NULLS FIRST, size, r) <= rest AS more
  FROM docs d JOIN plan p ON d.src IS NOT DISTINCT FROM p.src
),""" + _pick("d0", "d1", _LARGEST) + "," + _pick("d1_", "d2", _LARGEST) + "," + _pick("d2_", "d3", _LARGEST) + "," + _pick(
    "d3_", "d4", "gap > 0 AND size < 2 * gap BY size, turn, doc_id, r") + """
SELECT doc_id, size, total AS source_size, target,
       CAST(CASE WHEN size > 0 THEN (times + CASE WHEN more THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken
FROM d4_
"""

# CRC-32 of an id's decimal digits: a byte at a time, eight shifts a byte.
_CRC_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


def _crc32(identifier: str) -> str:
    digits = f"[CAST(ord(d) AS BIGINT) FOR d IN string_split(CAST({identifier} AS VARCHAR), '')]"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: {_CRC_BYTE}), 4294967295)"


def _encoded(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_encoded, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _levels(name: str, leaves: str) -> str:
    """Every level of every tree: sixteen neighbours become one node while a tree has several."""
    return f"""{name} AS (
  SELECT 0 AS level, tree, i, node FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, i // 16, sha256(string_agg(node, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY level, tree, i // 16
), {name}_around AS (
  SELECT *, coalesce(string_agg(node, '') OVER (PARTITION BY level, tree, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (PARTITION BY level, tree, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r,
         count(*) OVER (PARTITION BY level, tree) AS n
  FROM {name}
)"""


DATASET_MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS i
  FROM (SELECT row_number() OVER () AS id, doc_id, source, {_encoded('source')} AS tree, {_leaf('text')} AS node,
               CASE WHEN {_crc32('doc_id')} % 5 = 0 THEN {_leaf(_LOWER.format('text'))} END AS changed FROM documents)
), {_levels('inner_', 'leaves')}, subroots AS (
  SELECT 'all' AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, node, own
  FROM (SELECT u.tree AS own, u.node, s.source FROM inner__around u
        JOIN (SELECT tree, any_value(source) AS source FROM leaves GROUP BY tree) s USING (tree) WHERE n = 1)
), {_levels('outer_', 'subroots')}, paths AS (
  SELECT v.id, level, l, r FROM leaves v JOIN inner__around u ON u.tree = v.tree AND u.n > 1 AND u.i = v.i // CAST(pow(16, level) AS BIGINT)
  UNION ALL
  SELECT v.id, 1000 + level, l, r FROM leaves v JOIN subroots s ON s.own = v.tree
  JOIN outer__around u ON u.n > 1 AND u.i = s.i // CAST(pow(16, level) AS BIGINT)
), ways AS (
  SELECT id, list(l || '|' || r ORDER BY level) AS way, string_agg(l || r, '' ORDER BY level) AS beside FROM paths GROUP BY id
), folded AS (
  SELECT v.doc_id, v.node AS leaf, s.node AS subroot, (SELECT node FROM outer__around WHERE n = 1) AS root,
         sha256(coalesce(beside, '')) AS proof_sha256,
         list_reduce(list_concat([coalesce(changed, v.node)], coalesce(way, [])),
                     lambda h, w: sha256(split_part(w, '|', 1) || h || split_part(w, '|', 2))) AS folded_root
  FROM leaves v JOIN subroots s ON s.own = v.tree LEFT JOIN ways USING (id)
)
SELECT *, folded_root = root AS verified FROM folded
"""

CONVERSATION_TRIE = f"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM said)
), pieces AS (
  SELECT c.conv_id, 0 AS part, p, role, text FROM convs c JOIN said s ON s.conv_id = c.base AND p <= h
  UNION ALL
  SELECT c.conv_id, 1 AS part, p, role, text FROM convs c JOIN said s ON s.conv_id = c.conv_id AND p > h
), rebuilt AS (
  SELECT conv_id, coalesce(turns, []) AS turns FROM convs LEFT JOIN (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, p) AS turns FROM pieces GROUP BY conv_id) USING (conv_id)
), prefixes AS (
  SELECT conv_id, d, len(turns) AS n, turns[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN d = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
  FROM prefixes GROUP BY d, prefix
), children AS (
  SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), figures AS (
  SELECT v.*, coalesce(c.n, 0) AS n_children,
         CASE WHEN v.d > 0 THEN (n_convs - 1) * octet_length(encode(v.prefix[v.d].text)) ELSE 0 END AS saved
  FROM nodes v LEFT JOIN children c ON c.d = v.d AND c.prefix = v.prefix
), below AS (
  SELECT k AS d, prefix[1:k] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM figures) GROUP BY 1, 2
)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM figures f JOIN below b ON b.d = f.d AND b.prefix = f.prefix
LEFT JOIN nodes u ON u.d = f.d - 1 AND u.prefix = f.prefix[1:f.d - 1]
"""

STATEMENTS = {
    "op5_source_mixing": SOURCE_MIX,
    "op1_warc_from_arc": ARCHIVED_PAGES,
    "op7_vantage_point_search": NEAREST_VECTORS,
    "op2_benchmark_decontamination": BENCHMARK_HITS,
    "op12_conversation_prefix_trie": CONVERSATION_TRIE,
    "op13_merkle_manifest": DATASET_MANIFEST,
}
