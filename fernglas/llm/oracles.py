"""DuckDB SQL of the queries whose whole result SQL can express, over whole tables."""

#: Exact join by prefixes: texts that reach the similarity share one of the rarest shingles of each.
OP4_MINHASH = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), frequency AS (
  SELECT g, count(*) AS f FROM shingles GROUP BY g
), ranked AS (
  SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r FROM shingles JOIN frequency USING (g)
), prefixes AS (
  SELECT doc_id, n, g FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b
  FROM prefixes x JOIN prefixes y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
), common AS (
  SELECT a, b, len(x.s) + len(y.s) AS both_sizes, len(list_intersect(x.s, y.s)) AS shared
  FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
), links AS (
  SELECT a, b FROM common WHERE 100 * shared >= 80 * (both_sizes - shared)
  UNION ALL
  SELECT b, a FROM common WHERE 100 * shared >= 80 * (both_sizes - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least_ids AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_ids USING (doc_id)
"""

#: Every pair of query and candidate.
OP5_ANN = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Five hexadecimal digits of the SHA-1 are four of its base32 form.
OP6_WARC = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS p, sha1(encode(coalesce(html, ''))) AS h FROM pages
), firsts AS (
  SELECT page_id, octet_length(p) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last_id FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM firsts
"""

#: All windows of 400 bytes, counted by their digests; a text is in hexadecimal, two characters a byte, and in pieces.
OP11_REPEATS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pieces AS (
  SELECT rid, n, base, substr(x, CAST(2 * base + 1 AS bigint), 2846) AS piece FROM (SELECT rid, n, x, unnest(range(0, n - 399, 1024)) AS base FROM docs WHERE n >= 400)
), windows AS (
  SELECT rid, base + k AS s, md5(substr(piece, CAST(2 * k + 1 AS bigint), 800)) AS h FROM (SELECT rid, base, piece, unnest(range(0, least(1024, n - 399 - base))) AS k FROM pieces)
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), matched AS (
  SELECT rid, s, coalesce(s > lag(s) OVER (PARTITION BY rid ORDER BY s) + 400, true) AS fresh FROM windows JOIN repeated USING (h)
), spans AS (
  SELECT rid, min(s) AS start, max(s) + 400 AS stop FROM (SELECT rid, s, sum(CAST(fresh AS integer)) OVER (PARTITION BY rid ORDER BY s) AS span FROM matched) GROUP BY rid, span
), cuts AS (
  SELECT rid, start, stop, coalesce(lag(stop) OVER (PARTITION BY rid ORDER BY start), 0) AS since FROM spans
), removed AS (
  SELECT rid, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS last,
    list(struct_pack(since := since, start := start) ORDER BY start) AS kept
  FROM cuts GROUP BY rid
)
SELECT doc_id, CAST(n AS bigint) AS n_bytes, CAST(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(kept, lambda p: substr(x, CAST(2 * p.since + 1 AS bigint), CAST(2 * (p.start - p.since) AS bigint))), '') || substr(x, CAST(2 * last + 1 AS bigint)), x))) AS kept_sha256
FROM docs LEFT JOIN removed USING (rid)
"""

#: Levels by recursion; the lowest bit of a CRC-32 from its polynomial, 3988292384.
OP13_MANIFEST = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
    list_transform(range(1, length(CAST(doc_id AS varchar)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS varchar), CAST(i AS integer), 1)) AS bigint)) AS bytes
  FROM documents
), told AS (
  SELECT *, list_reduce(list_prepend(4294967295, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS crc,
    coalesce(strlen(CAST(doc_id AS varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS varchar)) || ':' || n_chars, '-') AS head
  FROM docs
), hashed AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered
  FROM told
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed
), nodes AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3, n
), subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n
), steps AS (
  SELECT rid, level AS k, string_agg(digest, '' ORDER BY x.pos) FILTER (x.pos < l.pos // CAST(pow(3, level) AS bigint)) AS before, string_agg(digest, '' ORDER BY x.pos) FILTER (x.pos > l.pos // CAST(pow(3, level) AS bigint)) AS after
  FROM leaves l JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.pos // 3 = l.pos // CAST(pow(3, level + 1) AS bigint) GROUP BY rid, level, l.pos
  UNION ALL
  SELECT rid, 100 + level, string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < s.pos // CAST(pow(3, level) AS bigint)), string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > s.pos // CAST(pow(3, level) AS bigint))
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops x ON x.n > 1 AND x.pos // 3 = s.pos // CAST(pow(3, level + 1) AS bigint) GROUP BY rid, level, s.pos
), paths AS (
  SELECT rid, list(struct_pack(b := coalesce(before, ''), a := coalesce(after, ''), h := '') ORDER BY k) AS path FROM steps GROUP BY rid
), found AS (
  SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, coalesce(path, []) AS path, coalesce(tampered, leaf) AS now
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN paths USING (rid)
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.b || p.a), '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(b := '', a := '', h := now), path), lambda x, p: struct_pack(b := '', a := '', h := sha256(p.b || x.h || p.a))).h AS folded_root
  FROM found
)
SELECT *, folded_root = root AS verified FROM folded
"""

ORACLES = {"op4_minhash": OP4_MINHASH, "op5_ann": OP5_ANN, "op6_warc": OP6_WARC, "op11_repeats": OP11_REPEATS, "op13_manifest": OP13_MANIFEST}
