"""DuckDB SQL of the operators that SQL can express, written from the
contracts and not from the Spark code."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0 * CAST(x AS DOUBLE))) AS f
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.f, c.f) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

OP3 = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (
  SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) AS place FROM split),
keyed AS (
  SELECT *, {_LOWER.format(f"trim(body, {_BLANK})")} AS key FROM line),
held AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT keyed.*, held.key IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP4 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (
  SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM d),
w AS (
  SELECT doc_id, unnest(range(n_bytes - 199)) AS i, h FROM n WHERE n_bytes >= 200),
k AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM w),
again AS (
  SELECT m FROM k GROUP BY m HAVING count(*) > 1),
hit AS (
  SELECT doc_id, i FROM k SEMI JOIN again USING (m)),
edge AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens
  FROM hit),
isle AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM edge),
span AS (
  SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM isle GROUP BY doc_id, g),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM span WINDOW o AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL
  SELECT n.doc_id, coalesce(max(span.b), 0), any_value(n.n_bytes)
  FROM n LEFT JOIN span USING (doc_id) GROUP BY n.doc_id),
kept AS (
  SELECT gap.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h, sum(b - a) AS n_kept
  FROM gap JOIN n USING (doc_id) GROUP BY gap.doc_id),
c AS (
  SELECT doc_id, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT n.doc_id, n_bytes, CAST(n_bytes - n_kept AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP7 = f"""
WITH n AS (
  SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS body FROM documents),
g AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM n JOIN g USING (body)
"""

OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')]
    ELSE [] END) AS shingle
  FROM w),
n AS (
  SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n_shingles + q.n_shingles - c)),
both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = other)
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
           "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")
#: kind, pattern, part that must be long enough, its least length
_SECRETS = [
    ("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1), ("forge", "gh[pousr]_[A-Za-z0-9]{36,255}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1),
    ("url", "[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.%+-]{1,64}@", 0, 1),
]
_SECRET_ARMS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(t, '{pattern}') AS gaps, "
    f"regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS held "
    f"FROM d WHERE regexp_matches(t, '{pattern}')"
    for rank, (kind, pattern, group, least) in enumerate(_SECRETS))

OP13 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_SECRET_ARMS}),
l AS (
  SELECT doc_id, kind, rank, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, held, least FROM m),
p AS (
  SELECT doc_id, kind, rank, hits[i] AS hit,
    CAST(sum(length(gaps[i])) OVER w + coalesce(sum(length(hits[i])) OVER before, 0) AS BIGINT) AS start,
    length(held[i]) >= least AS ok
  FROM l
  WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING),
    before AS (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (
  SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || (start + length(hit)) AS span FROM p WHERE ok)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""

# DuckDB has no crc32: a table of the polynomial's remainders, folded over the
# bytes. Its levenshtein counts bytes, so U+00C0..U+00FF become ASCII
# characters that lower-cased words do not use.
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_ONE_BYTE = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[:63] + " "

OP11 = f"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
run AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\u00C0-\u00FF]+')) AS w
  FROM documents),
per AS MATERIALIZED (
  SELECT w, concat(doc_id, ':') || w AS s, count(*) AS k FROM run GROUP BY ALL),
hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(s))),
      lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM per, tab),
changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k
  FROM hashed),
vocab AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n, length(word) AS len, translate(word, '{_LATIN}', '{_ONE_BYTE}') AS flat
  FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM vocab a JOIN vocab b
  ON b.len BETWEEN a.len - 1 AND a.len + 1 AND levenshtein(a.flat, b.flat) = 1),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word),
judged AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
    CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM vocab LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at FROM judged
  UNION ALL
  SELECT chain.word, judged.form FROM chain JOIN judged ON judged.word = chain.at WHERE judged.form IS NOT NULL)
SELECT judged.word, judged.form, chain.at AS root, judged.n, judged.n_near, judged.form_n
FROM judged JOIN chain USING (word) JOIN judged e ON e.word = chain.at AND e.form IS NULL
"""
