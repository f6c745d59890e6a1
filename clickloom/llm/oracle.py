"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_DIGEST = "'sha256:' || sha256({0})"
_URN = "'<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) || '>'"


def _urn(parts: str) -> str:
    return _URN.replace("h,", f"md5({parts}),")


def _unescape(x: str) -> str:
    """The entities that the test pages hold."""
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_BLOCKS = "address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
_ELEMENT = "<{0}\\b[^>]*>.*?(?:</{0}\\s*>|\\z)"
_DROPPED = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(_ELEMENT.format(x) for x in ("script", "style", "noscript", "template", "title"))

_WARC = f"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS page,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
           || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) AS source_header
  FROM pages
), response AS (
  SELECT *, {_urn("'response' || chr(10) || page_id || chr(10) || target_uri")} AS refers_to,
         {_DIGEST.format("page")} AS source_payload_digest,
         {_DIGEST.format("source_header || chr(13) || chr(10) || page")} AS source_block_digest,
         trim(regexp_replace(regexp_replace({_unescape(f"regexp_replace(regexp_replace(regexp_replace(page, '{_DROPPED}', '', 'g'), '(?i)</?(?:{_BLOCKS})\\b[^>]*(?:>|\\z)', chr(10), 'g'), '<[/!?a-zA-Z][^>]*(?:>|\\z)', '', 'g')")},
           '[\\t\\v\\f\\r ]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS text
  FROM source
), made AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, text AS block FROM response
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields',
         'title: ' || trim({_unescape("regexp_replace(regexp_extract(page, '(?is)<title\\b[^>]*>(.*?)(?:</title\\s*>|\\z)', 1), '\\s+', ' ', 'g')")}) || chr(13) || chr(10)
      || 'language: ' || lower(regexp_extract(page, '(?i)<html\\b[^>]*?\\blang\\s*=\\s*"?([A-Za-z0-9-]+)', 1)) || chr(13) || chr(10)
      || 'http-status: 200' || chr(13) || chr(10)
      || 'payload-digest: ' || source_payload_digest || chr(13) || chr(10)
      || 'text-length: ' || length(text) || chr(13) || chr(10)
      || coalesce(array_to_string(list_transform(regexp_extract_all(page, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1),
           lambda x: 'outlink: ' || {_unescape("x")} || chr(13) || chr(10)), ''), '')
  FROM response
)
SELECT page_id, record_type, {_urn("record_type || chr(10) || refers_to")} AS record_id, refers_to, target_uri,
       '2024-01-01T00:00:00Z' AS warc_date, content_type, CAST(octet_length(encode(block)) AS BIGINT) AS content_length,
       {_DIGEST.format("block")} AS block_digest, source_payload_digest, source_block_digest, source_header, block
FROM made"""

_NEIGHBOURS = """
WITH usable AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _crc32(x: str) -> str:
    """Unsigned crc32 of a number's decimal text, bit by bit."""
    byte = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    digits = f"list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), lambda crc, b: {byte}), 4294967295)"


def _levels(name: str, count: int) -> str:
    """From table ``name`` (tree, i, h): tables ``name``_0 .. of the nodes of every
    level, with the joined hashes of the siblings on either side (alone: 1 if
    the level has this node only, which then is the tree's root)."""
    out, source = "", name
    for k in range(count + 1):
        out += f""", {name}_{k} AS MATERIALIZED (
  SELECT tree, i, h, count(*) OVER (PARTITION BY tree) = 1 AS alone,
         coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h, 1) OVER w, '') AS l, coalesce(lead(h, 1) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS r
  FROM {source} WINDOW w AS (PARTITION BY tree, i // 3 ORDER BY i)
), {name}_{k}_up AS MATERIALIZED (
  SELECT tree, i // 3 AS i, CASE WHEN any_value(alone) THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}_{k} GROUP BY tree, i // 3
)"""
        source = f"{name}_{k}_up"
    return out


def _fold(name: str, count: int, source: str, key: str) -> str:
    """Attach proof and folded hash to the rows of ``source`` (.., i, proof, fold)."""
    out = ""
    for k in range(count + 1):
        out += f""", {name}_on_{k} AS (
  SELECT x.* REPLACE (x.i // 3 AS i, CASE WHEN p.alone THEN x.proof ELSE x.proof || p.l || p.r END AS proof,
                      CASE WHEN p.alone THEN x.fold ELSE sha256(p.l || x.fold || p.r) END AS fold)
  FROM {source} x JOIN {name}_{k} p ON p.tree = x.{key} AND p.i = x.i
)"""
        source = f"{name}_on_{k}"
    return out


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: Levels of the unrolled trees: up to 3 ** 13 documents a source, 3 ** 8 sources.
_DOCUMENT_LEVELS, _SOURCE_LEVELS = 13, 8

_MERKLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {_LEAF.format("text")} AS leaf,
         {_LEAF.format(f"CASE WHEN {_crc32('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS fold
  FROM documents
), docs AS MATERIALIZED (
  SELECT *, '' AS proof, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed
){_levels("docs", _DOCUMENT_LEVELS)}, subs AS MATERIALIZED (
  SELECT '' AS tree, tree AS source, h, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM docs_{_DOCUMENT_LEVELS}_up
){_levels("subs", _SOURCE_LEVELS)}{_fold("docs", _DOCUMENT_LEVELS, "docs", "tree")}, crossed AS (
  SELECT x.* REPLACE (s.i AS i), s.subroot, '' AS crown FROM docs_on_{_DOCUMENT_LEVELS} x JOIN subs s ON s.source = x.tree
){_fold("subs", _SOURCE_LEVELS, "crossed", "crown")}
SELECT doc_id, leaf, subroot, h.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h.h AS verified
FROM subs_on_{_SOURCE_LEVELS}, subs_{_SOURCE_LEVELS}_up h
"""

_TRIE = f"""
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS (
  SELECT o.c, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(o.turns, h + 1, len(o.turns))) AS turns
  FROM (SELECT *, {_crc32("c")} % 6 AS h FROM own) o LEFT JOIN own b ON b.c = o.c - o.c % 100
), members AS MATERIALIZED (
  SELECT c, turns, CAST(d AS BIGINT) AS d, md5(CAST(to_json(list_slice(turns, 1, d)) AS VARCHAR)) AS key,
         CASE WHEN d > 0 THEN md5(CAST(to_json(list_slice(turns, 1, d - 1)) AS VARCHAR)) END AS parent
  FROM built, unnest(generate_series(0, len(turns))) g(d)
), nodes AS MATERIALIZED (
  SELECT min(c) AS conv_id, d AS depth, key, any_value(parent) AS parent, count(*) AS n_convs,
         coalesce(length(any_value(turns[d].t)), 0) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(turns) = d), '')) AS ends_sha256
  FROM members GROUP BY d, key
), placed AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes x WHERE x.depth = n.depth + 1 AND x.parent = n.key) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.parent
), sums AS (
  SELECT m.d AS depth, m.key, CAST(sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
         CAST(sum((u.n_convs - 1) * u.chars) AS BIGINT) AS saved_tokens
  FROM placed u JOIN members m ON m.c = u.conv_id AND m.d <= u.depth GROUP BY m.d, m.key
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM placed JOIN sums USING (depth, key)"""

SQL: dict[str, str] = {"op8_neighbours": _NEIGHBOURS, "op10_warc_derivatives": _WARC, "op11_trie": _TRIE, "op13_merkle": _MERKLE}
