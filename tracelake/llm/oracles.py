"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: The words of ``documents.text`` as a list, for DuckDB.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
windows AS (SELECT s.doc_id, s.p, md5(array_to_string(w.ws[s.p : s.p + 49], ' ')) AS h FROM starts s JOIN w USING (doc_id)),
firsts AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
hits AS (SELECT DISTINCT doc_id, p FROM windows JOIN firsts USING (h) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hits),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept_text, count(*) AS n FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT s.doc_id, array_to_string(w.ws[s.p : s.p + 4], ' ') AS g FROM starts s JOIN w USING (doc_id)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT c.x, c.y FROM c JOIN n a ON a.doc_id = c.x JOIN n b ON b.doc_id = c.y WHERE 100 * c.c >= 75 * (a.n + b.n - c.c)),
e AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS r FROM e UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r),
low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.doc_id = w.doc_id
"""


OP4 = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS p FROM d WHERE len(ws) >= 8),
wins AS (SELECT s.doc_id, s.p, array_to_string(d.ws[s.p : s.p + 7], ' ') AS g FROM starts s JOIN d USING (doc_id)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM rep) GROUP BY doc_id),
raw AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d),
ln AS (SELECT doc_id, host, t, l, trim(regexp_replace(lower(l), '[\x09-\x0D\x20]+', ' ', 'g')) AS k, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY doc_id),
often AS (SELECT host, k FROM ln GROUP BY host, k HAVING count(DISTINCT doc_id) > 20),
cut AS (SELECT ln.doc_id, sum(ln.n) AS n FROM ln JOIN often o ON ln.host IS NOT DISTINCT FROM o.host AND ln.k = o.k GROUP BY ln.doc_id),
m AS (SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(d.ws, '')) AS BIGINT) AS word_chars,
  CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(d.ws) - coalesce(cut.n, 0) AS BIGINT) AS n_left
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN cut USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT *, NOT (base_failed OR (n_words > n_left AND (n_left < 20 OR n_left < 0.3 * n_words))) AS kept FROM b
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || coalesce(text, ''))), 1, 9) AS BIGINT) AS h FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
w AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM b),
l AS (SELECT *, 2.0 * s AS cap, 1.5 * sum(s) OVER () AS budget, sum(w) OVER () AS all_w,
  coalesce(sum(2.0 * s) OVER (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
  coalesce(sum(w) OVER (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped_w FROM w),
t AS (SELECT source, s, CAST(least(cap, w * max((budget - stopped) / (all_w - stopped_w)) OVER ()) AS DOUBLE) AS target FROM l),
k AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS copies FROM t),
leaf AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
upto AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM leaf),
e AS (SELECT k.source, k.s, k.target, k.copies, k.target - k.copies * k.s AS budget, u.h, u.n, u.upto FROM k JOIN upto u ON k.source IS NOT DISTINCT FROM u.source),
edge AS (SELECT source, s, target, copies, budget, coalesce(min(h) FILTER (upto >= budget), max(h)) AS h FROM e GROUP BY ALL),
lim AS (SELECT edge.*, e.n, edge.budget - (e.upto - e.n) AS rest FROM edge JOIN e ON edge.source IS NOT DISTINCT FROM e.source AND edge.h = e.h)
SELECT d.doc_id, d.size, lim.s AS source_size, lim.target,
  CAST(d.size * (lim.copies + CASE WHEN d.h < lim.h + CASE WHEN abs(lim.n - lim.rest) < abs(lim.rest) THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN lim ON d.source IS NOT DISTINCT FROM lim.source
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM d),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, m),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bs FROM l v JOIN l w ON w.b <> v.b JOIN l x ON x.b NOT IN (v.b, w.b) JOIN l y ON y.b NOT IN (v.b, w.b, x.b) JOIN l z ON z.b NOT IN (v.b, w.b, x.b, y.b)),
s AS (SELECT filter_order, step, bs[step] AS bit, CAST(coalesce(list_sum(bs[1 : step - 1]), 0) AS INTEGER) AS gone FROM o, (SELECT unnest(range(1, 6)) AS step))
SELECT p.part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (m & (bit | gone) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (m & bit <> 0 AND m & gone = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (m & bit <> 0 AND m & gone <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (m = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(g) FILTER (m & bit <> 0 AND m & gone = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(x) FILTER (m & bit <> 0 AND m & gone = 0), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(n * 120 // greatest(bit_count(m), 1)) FILTER (m & bit <> 0), 0) AS BIGINT) AS shapley
FROM (SELECT DISTINCT part FROM c) p, s LEFT JOIN c ON c.part = p.part GROUP BY p.part, filter_order, step
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total FROM grp g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v) AS p
  FROM tot t JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // ((SELECT sum(total) FROM tot WHERE tot.lang = p.lang) + 5 * (SELECT v.v FROM v WHERE v.lang = p.lang)) AS q FROM p GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
every AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM terms)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op4_quality_rules": OP4, "op8_top_k_search": OP8, "op9_ngram_jaccard_join": OP9, "op10_mix_to_weights": OP10, "op12_filter_audit": OP12, "op13_source_divergence": OP13}
