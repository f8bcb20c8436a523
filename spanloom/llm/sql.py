"""The queries of this subpackage restated in SQL, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {}

SQL["op10_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
           GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT doc_id, i, line, coalesce(doc_id <> first, false) AS gone
           FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM judged GROUP BY doc_id"""

SQL["op6_digest_index"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""

SQL["op1_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
named AS (
  SELECT page_id, host, path, length(html) < 1000 AS thin,
         regexp_replace(host, '^(www|m)\.', '') ||
         regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') AS canonical
  FROM cut),
listed AS (SELECT DISTINCT canonical FROM named WHERE thin AND host <> ''),
rules(rule, rhost, rpath, rverdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits AS (
  SELECT page_id, rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n
  FROM named, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN rverdict
            WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block'
            ELSE 'allow' END AS verdict
FROM named LEFT JOIN (SELECT page_id, rule, rverdict FROM fits WHERE n = 1) USING (page_id)"""

SQL["op3_token_rollup"] = r"""
WITH kept AS (SELECT *, coalesce(lang, '') <> 'en' AS foreign_ FROM documents
              WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
counted AS (
  SELECT source, lang, CASE WHEN foreign_ THEN 'pieces-1' ELSE 'words-1' END AS tokenizer,
         CASE WHEN foreign_ THEN len(regexp_extract_all(coalesce(text, ''),
           '[A-Za-z0-9]+|[^\x00-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]'))
         ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS n,
         length(coalesce(text, '')) AS c
  FROM kept)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens,
       sum(c)::BIGINT AS n_chars
FROM counted GROUP BY source, lang, tokenizer"""


SQL["op11_minhash"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN sizes a ON a.doc_id = x.doc_id JOIN sizes b ON b.doc_id = y.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
LEFT JOIN sizes USING (doc_id)"""

SQL["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
f AS (
  SELECT part, doc_id, (len(w) < 200)::INT AS fa, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS fb,
         (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT AS fc,
         regexp_matches(t, '[#$%&*|]')::INT AS fd, (doc_id > first)::INT AS fe
  FROM d JOIN firsts USING (t)),
counted AS (
  SELECT part, fa, fb, fc, fd, fe, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good,
         count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
judged AS (
  SELECT part, o, i, n, good, toxic,
         string_agg(CASE WHEN hit = 1 THEN letter ELSE '' END, '') OVER w AS gone_before, hit, nfail
  FROM (SELECT part, o, i, n, good, toxic, fa + fb + fc + fd + fe AS nfail, substr(o, i, 1) AS letter,
               CASE substr(o, i, 1) WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd
                                    ELSE fe END AS hit, fa, fb, fc, fd, fe
        FROM counted, orders, range(1, 6) AS r(i))
  WINDOW w AS (PARTITION BY part, o, fa, fb, fc, fd, fe ORDER BY i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, coalesce(gone_before, '') <> '' AS gone FROM judged),
steps AS (
  SELECT part, o AS filter_order, i::INT AS step,
         coalesce(sum(n) FILTER (WHERE NOT gone AND hit = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND hit = 1), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND hit = 1), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE hit = 1 AND nfail = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND hit = 1), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit = 1), 0)::BIGINT AS toxic_lost
  FROM marked GROUP BY part, o, i)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley
FROM steps"""


def _vector_codes(rounds: int = 2) -> str:
    """Each round is a table of entries (p, e, c): part, index and components."""
    near = """
near{r} AS (
  SELECT vec_id, v.p, v.x, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1),
           lambda i: (x[i] - c[i]) * (x[i] - c[i]))), e := e)) AS best
  FROM v JOIN book{r} b ON b.p = v.p GROUP BY vec_id, v.p, v.x)"""
    move = """
sums{r} AS (
  SELECT p, e, j, (sum(y) - ((sum(y) % count(*) + count(*)) % count(*))) // count(*) AS y
  FROM (SELECT p, best.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM near{r})
  GROUP BY p, e, j),
book{n} AS (
  SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{r} b
  LEFT JOIN (SELECT p, e, list(y::BIGINT ORDER BY j) AS c FROM sums{r} GROUP BY p, e) s
  ON s.p = b.p AND s.e = b.e)"""
    parts = [near.format(r=r) + "," + move.format(r=r, n=r + 1) + "," for r in range(rounds)]
    return f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (
  SELECT vec_id, p, q[p * len(q) // 16 + 1:(p + 1) * len(q) // 16] AS x
  FROM whole, range(16) AS r(p)),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole
        ORDER BY vec_id LIMIT 64),
book0 AS (SELECT p, e, x AS c FROM v JOIN ids USING (vec_id)),
{"".join(parts)}{near.format(r=rounds)},
told AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code,
         sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       h AS codebooks_sha256
FROM told JOIN whole USING (vec_id), books"""


SQL["op13_vector_codes"] = _vector_codes()
