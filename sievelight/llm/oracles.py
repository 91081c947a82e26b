"""SQL that gives the rows of the operators that SQL can express: links by shared shingles, resampling, phrases, shards."""

from __future__ import annotations

#: Links by counting shared shingles of different sets, and what they reach.
NEAR = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
rows AS MATERIALIZED (SELECT id, n, unnest(s) AS x FROM classes),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM rows a JOIN rows b ON a.x = b.x AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached(id, other) AS (SELECT id, id FROM classes UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other),
named AS (SELECT s, min(other) AS found FROM classes JOIN reached USING (id) GROUP BY s)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(found, doc_id) AS component_id, doc_id = coalesce(found, doc_id) AS kept FROM sets LEFT JOIN named ON named.s = sets.s
"""

#: The CRC-32's table, made from its polynomial, as a list of 256 steps.
_TABLE = "crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i)))"


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; `t` is the table's list."""
    of = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce({of}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT))"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Buckets by the checksum of each different feature, then sums over the documents' features.
RESAMPLE = rf"""
WITH {_TABLE},
w AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
rows AS MATERIALIZED (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w),
feature AS MATERIALIZED (SELECT x, {_crc("x")} % 10000 AS bucket FROM (SELECT DISTINCT x FROM rows), crc_table),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM rows JOIN feature USING (x) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n)::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n)::DOUBLE + 10000)))) AS g FROM n),
weights AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM rows JOIN feature USING (x) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scores AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN weights USING (r) WHERE side = 0),
placed AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id, n_features) END AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM scores WHERE words >= 20) // 100 THEN place END AS rank FROM placed
"""

#: All phrases counted, each cut scored in 128-bit whole numbers, phrases inside longer ones dropped.
PHRASES = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM w),
f AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS v, count(*) AS a FROM g GROUP BY lang, phrase),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(v) = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE len(v) > 1 AND a >= 10),
cuts AS (SELECT lang, phrase, a, v, unnest(range(1, len(v))) AS k FROM c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * cuts.a * cuts.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score FROM cuts
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.v[1:k], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.v[k + 1:len(cuts.v)], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
whole AS (SELECT best.* FROM best WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = best.lang AND len(v) = 3 AND 100 * c.a >= 50 * best.a AND best.phrase IN (v[1] || ' ' || v[2], v[2] || ' ' || v[3])))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM whole) JOIN n USING (lang) WHERE rank <= 2000
"""


def _digest(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


#: Rows numbered by a hash, six rounds over two digits, walked on while they are beyond the last number.
SHARDS = f"""
WITH RECURSIVE {_TABLE},
sized AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {_digest("coalesce(doc_id::VARCHAR, '')", "size", "text_crc32")}, doc_id NULLS FIRST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM sized),
sides AS MATERIALIZED (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT DISTINCT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM numbered)),
walk(number, x, l, r, i) AS (SELECT number, number, number // b, number % b, 0 FROM numbered JOIN sides USING (n)
  UNION ALL SELECT number, CASE WHEN i = 5 THEN l * b + (r + {_digest("13", "i", "l")}) % b ELSE x END, CASE WHEN i % 2 = 0 THEN (l + {_digest("13", "i", "r")}) % a ELSE l END,
    CASE WHEN i % 2 = 1 THEN (r + {_digest("13", "i", "l")}) % b ELSE r END, CASE WHEN i < 5 THEN i + 1 WHEN l * b + (r + {_digest("13", "i", "l")}) % b >= n THEN 0 ELSE 6 END FROM walk, sides WHERE i < 6),
placed AS (SELECT number, x FROM walk WHERE i = 6)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 24 AS INTEGER) AS shard, x // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM numbered JOIN placed USING (number)
"""
