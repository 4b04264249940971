"""DuckDB SQL for the queries of this package that SQL can state on whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
spans AS (
  SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM spans GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 100),
inside AS (
  SELECT lang, part, max(a) AS longest FROM (
    SELECT lang, a, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, m - s + 2)]) AS part
    FROM found, (SELECT unnest([2, 3, 4]) AS s) WHERE s < m) GROUP BY ALL),
cuts AS (
  SELECT f.lang, f.phrase, f.a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM found f LEFT JOIN inside i ON f.lang = i.lang AND f.phrase = i.part, (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE k < f.m AND NOT coalesce(100 * i.longest >= 100 * f.a, FALSE)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, s.n,
    ((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp
    JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
WHERE rank <= 2000"""

# The table of crc32, and the bytes of a text of letters (one byte, or two that begin with C3).
_CRC_STEP = "list_reduce([x FOR x IN [b] || [0, 1, 2, 3, 4, 5, 6, 7]], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"

OP12 = rf"""
WITH RECURSIVE crc AS (
  SELECT list({_CRC_STEP} ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT named, run, n, hex(encode(named)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || [('0x' || x[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(length(x) // 2)],
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS h FROM bytes, crc),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
without AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
way AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM way w JOIN forms f ON f.word = w.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.at AS root FROM forms f JOIN way w ON w.word = f.word AND w.next IS NULL"""
