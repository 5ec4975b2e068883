"""DuckDB twins of the queries that SQL can express."""

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP5 = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORM}) AS s FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep, count(*) OVER (PARTITION BY s) AS c FROM d
)
SELECT doc_id, keep AS keep_id, c AS group_size, doc_id = keep AS kept, s AS text_sha256 FROM k
"""

OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, lower(sha1(b)) AS h FROM p),
r AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS rep FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = rep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> rep THEN rep END AS refers_to
FROM r
"""

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
gone AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, w, coalesce(len(ps), 0) AS n,
    CASE WHEN ps IS NULL THEN w ELSE [w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(ps, p)] END AS kw
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(w) AS n_words, n AS n_removed, sha256(array_to_string(kw, ' ')) AS kept_sha256 FROM kept
"""

OP9 = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN string_split(text, chr(10)) END AS w FROM documents),
s AS (
  SELECT doc_id, i, 2 AS n, w[i] || chr(10) || w[i + 1] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)
  UNION ALL
  SELECT doc_id, i, 1, w[i] FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE len(regexp_extract_all(w[i], '[^\x20\x09-\x0D]+')) >= 8
),
k AS (SELECT doc_id, i, n, md5(t) AS h FROM s WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
r AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, h ORDER BY doc_id, i) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM r WHERE nth > 1),
gone AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, w, coalesce(len(ps), 0) AS n,
    CASE WHEN ps IS NULL THEN w ELSE [w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(ps, p)] END AS kw
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, coalesce(len(w), 0) AS n_lines, n AS n_removed, sha256(coalesce(array_to_string(kw, chr(10)), '')) AS kept_sha256 FROM kept
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL = {"op5_exact_dedup": OP5, "op6_substring_dedup": OP6, "op8_warc": OP8, "op9_line_dedup": OP9, "op10_near_dedup": OP10}
