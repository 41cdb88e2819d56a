"""DuckDB SQL for the queries that SQL can express."""

#: The same mix by plain window functions.
OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents
), k AS (SELECT *, length(bin(size + 1)) - 1 AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight,
         2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS goal
  FROM s
), l AS (
  SELECT *, (goal - coalesce(sum(most) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level,
         row_number() OVER (ORDER BY most / weight, source NULLS FIRST, source_size) AS rn
  FROM w WINDOW up AS (ORDER BY most / weight, source NULLS FIRST, source_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(most, coalesce(arg_min(level, rn) FILTER (WHERE NOT level * weight > most) OVER () * weight, most)) AS target FROM l
), c AS (SELECT source, class, CAST(sum(size) AS DOUBLE) AS words FROM k GROUP BY source, class HAVING sum(size) > 0),
cw AS (
  SELECT c.source, c.class, c.words, t.target, pow(c.class + 1.0::DOUBLE, 0.5::DOUBLE) * c.words AS weight, 2.0::DOUBLE * c.words AS most
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), cl AS (
  SELECT *, (target - coalesce(sum(most) OVER up, 0)) / (sum(weight) OVER (PARTITION BY source) - coalesce(sum(weight) OVER up, 0)) AS level,
         row_number() OVER (PARTITION BY source ORDER BY most / weight, class) AS rn
  FROM cw WINDOW up AS (PARTITION BY source ORDER BY most / weight, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ce AS (
  SELECT *, least(most, coalesce(arg_min(level, rn) FILTER (WHERE NOT level * weight > most) OVER (PARTITION BY source) * weight, most)) / words AS e FROM cl
), cp AS (SELECT *, floor(e + 1e-12) AS whole, greatest(0.0::DOUBLE, e - floor(e + 1e-12)) AS p FROM ce),
cs AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source) AS "left" FROM cp),
r AS (
  SELECT k.*, cs.whole, cs.p, cs."left", CASE WHEN cs.p > 0 THEN k.u / (1 - k.u) * (1 - cs.p) / cs.p END AS rank
  FROM k LEFT JOIN cs ON k.source IS NOT DISTINCT FROM cs.source AND k.class = cs.class
), o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM r
), b AS (
  SELECT source, min(abs(upto - "left")) AS miss, min("left") AS "left" FROM o WHERE rank IS NOT NULL AND "left" > 0 GROUP BY source
), e AS (
  SELECT o.source, min(upto) AS stop FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source
  WHERE rank IS NOT NULL AND abs(o.upto - b."left") = b.miss AND b.miss <= b."left" GROUP BY o.source
)
SELECT o.doc_id, o.size, t.source_size, t.target,
       CAST(coalesce(o.whole, 0) + CASE WHEN o.rank IS NOT NULL AND o.upto <= e.stop THEN 1 ELSE 0 END AS BIGINT) AS copies,
       o.size * CAST(coalesce(o.whole, 0) + CASE WHEN o.rank IS NOT NULL AND o.upto <= e.stop THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""

#: Subtree sums by pairing every node with all nodes above it; crc32 is written out.
OP13 = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, list(t ORDER BY pos) AS turns FROM own GROUP BY conv_id),
h AS (
  SELECT *, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
           lambda x, d: list_reduce(list_concat([xor(x, d)], range(8)), lambda y, i: xor(y >> 1, 3988292384::BIGINT * (y & 1))))) % 9 AS h
  FROM c
), r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), coalesce(list_slice(h.turns, h.h + 1, len(h.turns)), [])) AS turns
  FROM h LEFT JOIN c AS b ON b.conv_id = h.base
), m AS (SELECT conv_id, len(turns) AS total, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
k AS (SELECT conv_id, total, depth, list_slice(turns, 1, depth) AS path, coalesce(strlen(turns[depth].text), 0) AS bytes FROM m),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256
  FROM k GROUP BY path, depth
), kids AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
up AS (SELECT list_slice(path, 1, above) AS path, n_children, own FROM (SELECT *, unnest(range(depth + 1)) AS above FROM f)),
s AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM up GROUP BY path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN f AS p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = list_slice(f.path, 1, f.depth - 1)
"""

#: Each source against each other one of its language, and against the language.
OP11 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT lang, source, unnest(list_distinct(terms)) AS term, terms FROM (
  SELECT lang, source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM d)),
w AS (SELECT lang, source, term, CAST(len(list_filter(terms, lambda x: x = term)) AS BIGINT) AS n FROM t),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // CAST(gn.total + 5 * v.v AS HUGEINT) AS BIGINT) AS p
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term
), q AS (
  SELECT lang, term, CAST(1 + (1000000000 * CAST(s + 5 AS HUGEINT)) // CAST(ln.total + 5 * v.v AS HUGEINT) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS s FROM c GROUP BY ALL) JOIN ln USING (lang) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM every WHERE part = 'pair' OR rank <= 50
"""

#: All pairs that share an n-gram, counted, and reachability by labels that spread.
OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS grams FROM d
), k AS (SELECT grams, min(doc_id) AS name, len(grams) AS n FROM (SELECT doc_id, list_sort(grams) AS grams FROM s) WHERE len(grams) > 0 GROUP BY grams),
g AS (SELECT name, n, unnest(grams) AS gram FROM k),
p AS (
  SELECT a.name AS u, b.name AS v FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.name < b.name
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.name, b.name, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT DISTINCT u AS a, u AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
c AS (SELECT a AS name, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(c.root, k.name, s.doc_id) AS component_id
FROM s LEFT JOIN k ON k.grams = list_sort(s.grams) LEFT JOIN c ON c.name = k.name
"""

#: Windows as joined words; a word is covered if a repeated window begins at most twelve words before it.
OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
b AS (SELECT doc_id, p AS start FROM s JOIN f USING (g) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
c AS (SELECT x.doc_id, p, word, coalesce(p - max(start) OVER (PARTITION BY x.doc_id ORDER BY p) <= 12, false) AS gone FROM x LEFT JOIN b ON b.doc_id = x.doc_id AND start = p),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: Every window of 200 bytes by the MD5 of its hexadecimal digits.
OP9 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (SELECT doc_id, c, substr(h, 2 * c + 1, 10398) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 5000)) AS c FROM d)),
s AS (SELECT doc_id, c + p AS p, md5(substr(part, 2 * p + 1, 400)) AS g FROM (SELECT doc_id, c, part, unnest(range(0, least(5000, len(part) // 2 - 199))) AS p FROM l WHERE len(part) >= 400)),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
b AS (SELECT doc_id, p FROM s SEMI JOIN f USING (g)),
n AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 200, true) AS begins FROM b),
i AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n) GROUP BY doc_id, run),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM i),
k AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
