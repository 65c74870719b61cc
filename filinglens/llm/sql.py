"""DuckDB SQL with the same rows as the registered queries, for the operators that SQL can express."""

from __future__ import annotations

WORD_LIST = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LINE_DEDUP = """
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
n AS (SELECT doc_id, line_no, trim(lower(regexp_replace(line, '\\s+', ' ', 'g'))) AS norm FROM l),
d AS (SELECT norm, min(doc_id * 1000000 + line_no) AS f FROM n WHERE norm <> '' GROUP BY norm),
s AS (SELECT f, list_sort(list_distinct(CASE WHEN length(norm) <= 5 THEN [hash(norm)] ELSE [hash(substr(norm, i, 5)) for i in range(1, length(norm) - 3)] END)) AS gs FROM d),
q AS (SELECT g, count(*) AS m FROM (SELECT unnest(gs) AS g FROM s) GROUP BY g HAVING count(*) > 1),
r AS (SELECT f, g, k, row_number() OVER (PARTITION BY f ORDER BY coalesce(m, 1), g) AS o, m FROM (SELECT f, unnest(gs) AS g, len(gs) AS k FROM s) LEFT JOIN q USING (g)),
h AS (SELECT f, g, k FROM r WHERE o <= k - ceil(0.8 * k) + 1 AND m > 1),
p AS (SELECT DISTINCT a.f AS a, b.f AS b FROM h a JOIN h b ON a.g = b.g AND a.f < b.f AND a.k >= 0.8 * b.k AND b.k >= 0.8 * a.k),
e AS (SELECT a, b FROM (SELECT a, b, len(x.gs) + len(y.gs) AS total, len(list_intersect(x.gs, y.gs)) AS n FROM p JOIN s x ON x.f = a JOIN s y ON y.f = b) WHERE n >= 0.8 * (total - n) - 1e-9),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT a AS node, a AS root FROM g UNION SELECT g.b, t.root FROM t JOIN g ON g.a = t.node WHERE t.root < g.b),
z AS (SELECT node, min(root) AS root FROM t GROUP BY node)
SELECT n.doc_id, CAST(n.line_no AS INTEGER) AS line_no, coalesce(z.root, d.f) // 1000000 AS head_id, CAST(coalesce(z.root, d.f) % 1000000 AS INTEGER) AS head_line, coalesce(z.root, d.f) = n.doc_id * 1000000 + n.line_no AS keep
FROM n JOIN d USING (norm) LEFT JOIN z ON z.node = d.f
"""

NGRAM_JOIN = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END)) AS g FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN c u ON u.doc_id = a JOIN c v ON v.doc_id = b WHERE n >= 0.8 * (u.k + v.k - n) - 1e-9),
t AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node WHERE t.root < e.b),
z AS (SELECT node, min(root) AS root FROM t GROUP BY node),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, coalesce(least(root, doc_id), doc_id) AS class_id, coalesce(n, 0) AS n_links FROM documents LEFT JOIN z ON z.node = doc_id LEFT JOIN l ON l.a = doc_id
"""

MIXING = """
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS BIGINT) AS n,
 CAST(('0x' || substr(md5('mix-1|' || doc_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u, text FROM documents),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY source),
g AS (SELECT sum(tokens)::DOUBLE AS t, count(*) AS k, ln(max(tokens)::DOUBLE / min(tokens)) AS spread FROM s WHERE tokens > 0),
x AS (SELECT list(ln(tokens / t)) AS xs, any_value(t) AS t, any_value(0.9::DOUBLE * ln(k)) AS goal, any_value(spread) AS spread FROM s, g WHERE tokens > 0),
b AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
 SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (SELECT b.*, (lo + hi) / 2 AS mid,
 ln(list_sum([exp(v * (lo + hi) / 2) for v in xs])) - list_sum([exp(v * (lo + hi) / 2) * v * (lo + hi) / 2 for v in xs]) / list_sum([exp(v * (lo + hi) / 2) for v in xs]) >= goal AS ok FROM b, x WHERE step < 40 AND hi - lo >= 1e-8)),
a AS (SELECT round(least(1.0, greatest(CASE WHEN ln(list_sum([exp(v) for v in xs])) - list_sum([exp(v) * v for v in xs]) / list_sum([exp(v) for v in xs]) >= goal THEN 1.0 ELSE (SELECT lo FROM b ORDER BY step DESC LIMIT 1) END,
 CASE WHEN spread = 0 THEN 0 ELSE greatest(0, 1 - ln(4.0::DOUBLE) / spread) END)), 6) AS alpha, t FROM x),
r AS (SELECT source, tokens, exp(ln(tokens / t) * alpha) AS raw FROM s, a WHERE tokens > 0),
m AS (SELECT sum(raw) AS z, max(tokens / raw) AS most FROM r),
q AS (SELECT source, tokens, CAST(floor(raw / z * (z * most) + 1e-3) AS BIGINT) AS target FROM r, m),
k AS (SELECT d.*, coalesce(sum(n) OVER (PARTITION BY source ORDER BY u, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
c AS (SELECT doc_id, source, n, CASE WHEN tokens IS NULL THEN 1 ELSE target // tokens + CASE WHEN before < target % tokens THEN 1 ELSE 0 END END AS times FROM k LEFT JOIN q USING (source))
SELECT doc_id, source, n AS n_tokens, CAST(unnest(range(0, CAST(times AS BIGINT))) AS INTEGER) AS epoch FROM c
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({WORD_LIST.format('text')}, []) AS w FROM documents), b AS (SELECT item_id, {WORD_LIST.format('text')} AS w FROM benchmark),
i AS (SELECT item_id, unnest([array_to_string(w[i:i+9], ' ') for i in range(1, len(w) - 8)]) AS win, 10 AS n FROM b WHERE len(w) >= 10 UNION SELECT item_id, array_to_string(w, ' '), len(w) FROM b WHERE len(w) BETWEEN 1 AND 9),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i)),
h AS (SELECT p.doc_id, p.pos, p.n, i.item_id FROM p JOIN i ON i.n = p.n AND i.win = array_to_string(p.w[p.pos:p.pos + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS x FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SHARDING = """
WITH t AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) for i in range(0, 256)] AS tab),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
 CAST(('0x' || substr(md5('shard-1|' || doc_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents),
c AS (SELECT doc_id, source, size, u, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT) for i in range(0, size - 1)]),
 lambda v, b: xor(v >> 8, tab[(xor(v, b) & 255) + 1]))) AS text_crc32 FROM d, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, doc_id, text_crc32) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * k + 1)::DOUBLE / (2 * n)::DOUBLE, coalesce(source, ''), doc_id, k) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * 8 // total AS INTEGER) AS shard, CAST(pos - ((pos * 8 // total) * total + 7) // 8 AS BIGINT) AS slot,
 CAST(NULL AS INTEGER) AS grown_shard, source FROM p
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, list_concat([x || chr(10) for x in p[1:len(p) - 1]], [x for x in p[len(p):len(p)] if x <> '']) AS u,
 [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(0, 4)] AS h FROM d),
c AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM x
"""

DIVERGENCE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT lang, term, sum(n) AS n FROM o GROUP BY lang, term HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM t GROUP BY lang),
c AS (SELECT o.lang, o.source, term, o.n FROM o JOIN t USING (lang, term)),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)
 LEFT JOIN (SELECT lang, v FROM l) USING (lang)),
p AS (SELECT g.lang, g.source, t.term, c.n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS BIGINT) AS p, CAST(1 + 1000000000 * (t.n + 1) // (l.n + l.v) AS BIGINT) AS q
 FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT lang, x.source, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y USING (lang) LEFT JOIN a USING (lang) WHERE x.source <> y.source AND (a.source IS NULL OR (a.source = x.source AND a.item = y.source))),
e AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM e)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM b
UNION ALL SELECT lang, source, 'term' AS part, item, value, rank FROM f WHERE rank <= 200
"""

SQL = {
    "op1_line_dedup": LINE_DEDUP,
    "op2_ngram_jaccard_join": NGRAM_JOIN,
    "op4_mixing": MIXING,
    "op6_decontamination": DECONTAMINATION,
    "op7_sharding": SHARDING,
    "op9_warc": WARC,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_source_divergence": DIVERGENCE,
}
