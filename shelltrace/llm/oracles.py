"""The queries of this package in SQL for DuckDB, where SQL can express them."""

_WORDS = r"""
regexp_extract_all(
    translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
"""

OP2 = f"""
WITH item AS (
  SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
        FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents
), size AS (
  SELECT DISTINCT len(win) AS n FROM win
), spot AS (
  SELECT r, n, s, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, size)
), found AS (
  SELECT r, s, n, item_id FROM spot JOIN win USING (win)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM found))
  GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found
        WHERE item_id IS NOT NULL)
  GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_BLANK = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

OP8 = f"""
WITH doc AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text, string_split(text, chr(10)) AS ls
  FROM documents
), line AS (
  SELECT r, p, ls[p] AS raw, trim(ls[p], {_BLANK}) AS l,
         len(regexp_extract_all(ls[p], '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS p FROM doc)
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY r ORDER BY p) AS e FROM line WHERE n > 0
), frame AS (
  SELECT r, min(p) OVER d AS f, max(p) OVER d AS t, sum(n) OVER d AS n, list(l) OVER d AS c
  FROM (SELECT *, e - n AS b FROM placed)
  WINDOW d AS (PARTITION BY r ORDER BY b RANGE BETWEEN 0 FOLLOWING AND 49 FOLLOWING)
  UNION
  SELECT r, min(p) OVER u, max(p) OVER u, sum(n) OVER u, list(l) OVER u
  FROM placed
  WINDOW u AS (PARTITION BY r ORDER BY e RANGE BETWEEN 49 PRECEDING AND 0 FOLLOWING)
), later AS (
  SELECT r, f, t FROM (
    SELECT r, f, t, row_number() OVER (PARTITION BY c ORDER BY r, f) AS k
    FROM frame WHERE n >= 50)
  WHERE k > 1
), dead AS (
  SELECT DISTINCT r, unnest(range(f, t + 1)) AS p FROM later
), kept AS (
  SELECT r, count(p2) AS n_deleted, string_agg(raw, chr(10) ORDER BY p) FILTER (p2 IS NULL) AS text
  FROM (SELECT line.r, line.p, raw, dead.p AS p2
        FROM line LEFT JOIN dead ON line.r = dead.r AND line.p = dead.p)
  GROUP BY r
)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       CASE WHEN doc.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM doc LEFT JOIN kept USING (r)
"""

OP3 = r"""
WITH rest AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u
  FROM pages
), part AS (
  SELECT page_id,
         translate(regexp_extract(u, '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/')
      THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/')
      THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM part)
"""

OP10 = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS p,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n
  FROM pages
), first AS (
  SELECT *, min(page_id) OVER (PARTITION BY p) AS f FROM page
)
SELECT page_id, n AS payload_bytes, sha256(p) AS payload_digest,
       CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
FROM first
"""

#: CRC-32 by its polynomial; words are few, so it is worked out once for each.
OP11 = f"""
WITH crc_byte AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents
), goal AS (
  SELECT {_WORDS.format("text")} AS w FROM benchmark
), spelt AS (
  SELECT w, list_transform(regexp_extract_all(hex(w), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b
  FROM (SELECT unnest(w) AS w FROM doc UNION SELECT unnest(w) FROM goal)
), named AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], b),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelt, crc_byte
), held AS (
  SELECT r, bucket FROM (SELECT r, unnest(w) AS w FROM doc) JOIN named USING (w)
), s AS (
  SELECT bucket, count(*) AS s FROM held GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t
  FROM (SELECT unnest(w) AS w FROM goal) JOIN named USING (w) GROUP BY bucket
), size AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + 10000) AS DOUBLE)
                                      / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), size
), worth AS (
  SELECT r, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM held JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5)::DOUBLE
           / 4294967296))) AS BIGINT) AS score
  FROM doc LEFT JOIN worth USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k,
         count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank
FROM placed
"""

OP13 = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents
), item AS (
  SELECT row_number() OVER () AS q, item_id, {_WORDS.format("text")} AS w FROM benchmark
), asked AS (
  SELECT q, t, count(*) AS qtf FROM (SELECT q, unnest(w) AS t FROM item) GROUP BY q, t
), size AS (
  SELECT count(*) AS n, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS l FROM doc WHERE len(w) > 0
), post AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM doc)
  WHERE t IN (SELECT t FROM asked) GROUP BY r, t
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM post GROUP BY t), size
), impact AS (
  SELECT r, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n) // l)) AS x
  FROM post JOIN doc USING (r), size
), scored AS (
  SELECT q, r, CAST(sum(qtf * w * x) AS BIGINT) AS score
  FROM asked JOIN weight USING (t) JOIN impact USING (t) GROUP BY q, r
), placed AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank
  FROM scored JOIN doc USING (r) JOIN item USING (q) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

ORACLES = {
    "op2_decontaminate": OP2,
    "op3_url_filter": OP3,
    "op10_warc": OP10,
    "op8_line_dedup": OP8,
    "op11_importance": OP11,
    "op13_lexical_search": OP13,
}
