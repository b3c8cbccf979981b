"""DuckDB statements for the registered queries that SQL can express.

They compare everything with everything, on tables small enough for that.
"""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({text}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

_OP1 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS p
         FROM (SELECT win.doc_id, i, unnest(range(0, 50)) AS j FROM win JOIN least USING (h) WHERE m < win.doc_id)),
word AS (SELECT doc_id, i, ws[i] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REACH = """
reach(a, b) AS (SELECT {id}, {id} FROM {nodes} UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
"""

_OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
         JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
         GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
{_REACH.format(id="doc_id", nodes="w")},
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON w.doc_id = c.doc_id LEFT JOIN n ON w.doc_id = n.doc_id
"""

_OP6 = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT vec_id, v FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(v, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM good),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id <> y.vec_id AND len(x.u) = len(y.u)
         WHERE list_dot_product(x.u, y.u) >= 0.9),
{_REACH.format(id="vec_id", nodes="e")},
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

_OP3 = """
WITH r AS (SELECT 'pages-' || CAST(CAST(floor(page_id / 500) AS BIGINT) AS VARCHAR) || '.warc' AS file, page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages WHERE page_id IS NOT NULL),
p AS (SELECT *, CAST(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(rec) AS BIGINT) AS "offset" FROM r),
a AS (SELECT file, "offset", rec FROM p WHERE page_id % 79 <> 5),
b AS (SELECT file, "offset", CASE WHEN page_id % 97 = 13 THEN 'WARC/1.1' || substr(rec, 9) WHEN page_id % 89 = 7 THEN substr(rec, 1, 60) ELSE rec END AS rec
      FROM p WHERE page_id % 83 <> 11)
SELECT coalesce(a.file, b.file) AS file, coalesce(a."offset", b."offset") AS "offset",
       CASE WHEN b.rec IS NULL THEN 'missing' WHEN a.rec IS NULL THEN 'extra' ELSE 'corrupt' END AS kind,
       CAST(strlen(a.rec) AS BIGINT) AS length_a, CAST(strlen(b.rec) AS BIGINT) AS length_b, sha256(a.rec) AS digest_a, sha256(b.rec) AS digest_b
FROM a FULL JOIN b ON a.file = b.file AND a."offset" = b."offset"
WHERE a.rec IS DISTINCT FROM b.rec
"""

_OP9 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
tok AS (SELECT doc_id, i, ws[i] AS x, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
u AS (SELECT x, count(*) AS c FROM tok GROUP BY 1), ud AS (SELECT doc_id, x, count(*) AS c FROM tok GROUP BY 1, 2),
b AS (SELECT p, x, count(*) AS c FROM tok WHERE p IS NOT NULL GROUP BY 1, 2),
bd AS (SELECT doc_id, p, x, count(*) AS c FROM tok WHERE p IS NOT NULL GROUP BY 1, 2, 3),
total AS (SELECT count(*) AS n FROM tok),
s AS (SELECT tok.doc_id, tok.p, u.c - ud.c AS cu, coalesce(b.c - bd.c, 0) AS cb, pu.c - pud.c AS cp, n - len(ws) AS rest
      FROM tok JOIN w USING (doc_id) CROSS JOIN total JOIN u ON u.x = tok.x JOIN ud ON ud.doc_id = tok.doc_id AND ud.x = tok.x
      LEFT JOIN b ON b.p = tok.p AND b.x = tok.x LEFT JOIN bd ON bd.doc_id = tok.doc_id AND bd.p = tok.p AND bd.x = tok.x
      LEFT JOIN u pu ON pu.x = tok.p LEFT JOIN ud pud ON pud.doc_id = tok.doc_id AND pud.x = tok.p),
l AS (SELECT doc_id, CASE WHEN cb > 0 THEN 2 WHEN cu > 0 THEN 1 ELSE 0 END AS lev,
      CASE WHEN cb > 0 THEN ln(cb / cp) WHEN cu > 0 AND p IS NOT NULL THEN ln(CAST(0.4 AS DOUBLE) * (cu / rest)) WHEN cu > 0 THEN ln(cu / rest)
           WHEN p IS NOT NULL THEN ln(CAST(0.4 AS DOUBLE) * CAST(0.4 AS DOUBLE) * (1 / (rest + 1))) ELSE ln(CAST(0.4 AS DOUBLE) * (1 / (rest + 1))) END AS v FROM s),
d AS (SELECT doc_id, CAST(sum(CAST(round(v * 1000000) AS BIGINT)) AS BIGINT) AS m, count(*) FILTER (lev = 0) AS n0,
      count(*) FILTER (lev = 1) AS n1, count(*) FILTER (lev = 2) AS n2 FROM l GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(m, 0) AS log_score_micro, m / 1e6::DOUBLE / len(ws) AS mean_log,
       coalesce(n0, 0) AS n_unseen, coalesce(n1, 0) AS n_unigram, coalesce(n2, 0) AS n_bigram
FROM w LEFT JOIN d ON w.doc_id = d.doc_id
"""


# crc32 of a list of bytes: its table is computed by eight shifts of each byte.
_CRC = """
crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
        CAST(b AS BIGINT)) AS c FROM (SELECT unnest(range(0, 256)) AS b)))
"""
# UTF-8 bytes of text whose letters are ASCII or U+00C0-U+00FF.
_BYTES = "flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))"

_OP11 = f"""
WITH RECURSIVE {_CRC},
run AS (SELECT doc_id, r, count(*) AS n FROM (
          SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS r FROM documents)
        WHERE length(r) >= 6 GROUP BY 1, 2),
h AS (SELECT r, n, xor(list_reduce({_BYTES.format(x="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")},
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM run, crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM h)
      WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS same, substr(word, 1, i - 1) || substr(word, i + 1) AS less
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.same = b.same AND a.word <> b.word
         UNION SELECT w.word, gap.word, gap.n FROM w JOIN gap ON w.word = gap.less UNION SELECT gap.word, w.word, w.n FROM w JOIN gap ON w.word = gap.less),
best AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * w.n THEN other END AS form, CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n
      FROM w LEFT JOIN best ON w.word = best.word AND k = 1),
walk(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN f ON walk.root = f.word WHERE form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(root, step) FROM walk WHERE walk.word = f.word) AS root, n, n_near, form_n FROM f
"""

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2) USING (lang, source)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 1)::HUGEINT) // (n + v) AS p
      FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(c) + 1)::HUGEINT) // ((SELECT sum(n) FROM g WHERE g.lang = p.lang) + (SELECT v FROM v WHERE v.lang = p.lang)) AS q
      FROM p GROUP BY 1, 2),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
         GROUP BY 1, 2, 3),
term AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS k FROM every)
WHERE part = 'pair' OR k <= 200
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op3_warc_fixity": _OP3, "op5_hyperminhash": _OP5, "op6_hnsw": _OP6, "op9_backoff_lm": _OP9,
            "op11_spelling_variants": _OP11, "op12_source_divergence": _OP12, "op13_exact_dedup": _OP13}
