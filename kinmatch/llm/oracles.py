"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(first_id, page_id) AS refers_to FROM f
"""

# DuckDB has no CRC-32: the table of the reflected polynomial is made by its eight shifts, then applied byte by byte.
SHARDING = """
WITH poly AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crc_table
  FROM range(256) AS r(i)
),
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size FROM documents),
hexed AS (SELECT doc_id, size, hex(encode(t)) AS h FROM d),
summed AS (
  SELECT doc_id, size,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(size - 8), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::UBIGINT[]),
      lambda c, b: xor(crc_table[(xor(c, b) & 255)::BIGINT + 1], c >> 8)) AS c
  FROM hexed, poly
),
placed AS (
  SELECT doc_id, size, xor(c, 4294967295::UBIGINT)::BIGINT AS text_crc32,
    coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte,
    sum(size) OVER ()::BIGINT AS total
  FROM summed
),
shards AS (SELECT *, (start_byte * 24 // total)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard, start_byte
FROM shards
"""

# Every pattern is written out once more; windows are scored one by one.
_FIND = """
SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'kind': {kind}, 'text': m[i], 'value': v[i],
  'start': coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT}}), lambda s: {keep}) AS spans
FROM (SELECT doc_id, regexp_extract_all(t, p) AS m, regexp_extract_all(t, p, {group}) AS v, string_split_regex(t, p) AS gaps FROM d, (SELECT {pattern} AS p))
"""
_ASSIGN = """'([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_EXAMPLE = "'(?i)example|sample|dummy|placeholder|changeme'"
# What is left of a run around its parts, each up to a '=' or '/', that hold example words.
_LEFT = f"""CASE WHEN regexp_matches(s.text, {_EXAMPLE}) THEN list_filter(list_transform(string_split(array_to_string(
    list_transform(regexp_extract_all(s.text, '[^=/]*[=/]|[^=/]+'), lambda p: CASE WHEN regexp_matches(p, {_EXAMPLE}) THEN ' ' ELSE p END), ''), ' '),
    lambda p: regexp_replace(p, '[=/]+$', '')), lambda p: length(p) >= 20) ELSE [s.text] END"""
_KEY_LIKE = f"""len(list_filter({_LEFT}, lambda r: regexp_matches(r, '[A-Za-z]') AND (regexp_matches(r, '[0-9]') OR (regexp_matches(r, '[a-z]') AND regexp_matches(r, '[A-Z]')))
 AND NOT regexp_matches(r, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
 AND NOT regexp_matches(r, '^([A-Z]?[a-z]{{3,}}[0-9]{{0,4}}[/_=-]?)+$') AND NOT regexp_matches(r, '^([A-Z]?[a-z]{{2,}}[/_=-]?)+$')
 AND list_max(list_transform(range(1, length(r) - 18), lambda k: list_aggregate(string_split(substr(r, k, 20), ''), 'entropy')))
   >= CASE WHEN regexp_matches(r, '^[A-Za-z]+$') THEN 3.7 WHEN regexp_matches(r, '^[A-Za-z+/_=-]+$') THEN 3.85
     WHEN regexp_matches(r, '^[0-9a-fA-F]+$') THEN 2.9 WHEN regexp_matches(r, '^[A-Za-z0-9]+$') THEN 3.6 ELSE 3.8 END)) > 0"""
_PARTS = (
    _FIND.format(kind=0, group=2, pattern=_ASSIGN, keep="length(s.value) >= 6"),
    _FIND.format(kind=1, group=0, pattern="'AKIA[A-Z0-9]+'", keep="length(s.text) >= 20"),
    _FIND.format(kind=2, group=0, pattern="'[0-9a-f]+'", keep="length(s.text) >= 24"),
    _FIND.format(kind=3, group=0, pattern="'[A-Za-z0-9+/_=-]{20,}'", keep=_KEY_LIKE),
)
SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, unnest(spans) AS s FROM ({" UNION ALL ".join(_PARTS)})),
base AS (SELECT doc_id, s.kind AS k, s.start AS a, s.start + length(s.text) AS b FROM found WHERE s.kind < 3),
more AS (SELECT doc_id, 3 AS k, s.start AS a, s.start + length(s.text) AS b FROM found WHERE s.kind = 3),
bases AS (SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY a, k, b) AS spans FROM base GROUP BY doc_id),
reached AS (
  SELECT more.*, list_reduce(list_prepend({{'a': a, 'b': a}}, coalesce(bases.spans, [])), lambda r, x: CASE WHEN x.a <= r.b THEN {{'a': r.a, 'b': greatest(r.b, x.b)}} ELSE r END).b AS reach
  FROM more LEFT JOIN bases USING (doc_id)
),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, k, a, b FROM reached WHERE reach < b),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || a || ':' || b AS x FROM spans)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy,
  sha256(coalesce(string_agg(x, ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""


LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, line, i, coalesce(r.first_id <> k.doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# Each tree is a list of nodes per level, made from the level below; a proof looks its siblings up in the lists.
MERKLE = """
WITH RECURSIVE poly AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crc_table
  FROM range(256) AS r(i)
),
d AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
      lambda c, b: xor(crc_table[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) % 7 = 0 AS hit
  FROM documents, poly
),
h AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || tail) AS tampered FROM d
),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM h),
low AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY spot) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM low WHERE len(nodes) > 1
),
subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(nodes) = 1),
high AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM high WHERE len(nodes) > 1
),
steps AS (
  SELECT doc_id, leaf, level AS step, spot >> level AS node, nodes FROM p JOIN low ON p.lang IS NOT DISTINCT FROM low.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, leaf, 1000 + level, place >> level, nodes FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang, high WHERE len(nodes) > 1
),
paths AS (
  SELECT doc_id, leaf, list(CASE WHEN node % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(node, 1) + 1], '') ORDER BY step) AS path FROM steps GROUP BY doc_id, leaf
),
told AS (
  SELECT p.doc_id, p.leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, coalesce(path, []) AS path, tampered
  FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang LEFT JOIN paths ON p.doc_id IS NOT DISTINCT FROM paths.doc_id AND p.leaf = paths.leaf
),
folded AS (
  SELECT *, list_reduce(list_prepend(tampered, path), lambda f, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || f ELSE f || s[2:] END)) AS folded_root FROM told
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def statements() -> dict[str, str]:
    return {"op3_secret_scan": SECRET_SCAN, "op4_exact_dedup": EXACT_DEDUP, "op9_warc": WARC, "op10_sharding": SHARDING, "op11_line_dedup": LINE_DEDUP, "op12_merkle_manifest": MERKLE}
