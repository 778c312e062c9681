"""DuckDB SQL of the queries that SQL expresses."""

from __future__ import annotations

from inkwell.llm.license_scan import templates
from inkwell.llm.merkle_manifest import oracle as merkle_sql
from inkwell.llm.url_filter import ORACLE_SQL as URL_FILTER

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x20\x09-\x0D]+'"

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLDED}, {WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.a),
c AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.a LEFT JOIN n ON d.doc_id = n.doc_id
"""

BACKOFF = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, {WORDS}) AS ws FROM documents),
t AS (SELECT doc_id, i, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) q WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w), c2 AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= 2), total AS (SELECT count(*) AS n FROM t),
x AS (SELECT t.doc_id, CASE WHEN c3.c >= 2 THEN ln(c3.c / uv.c) WHEN vw.c >= 2 THEN ln(vw.c / cv.c) + CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4) END
  ELSE ln(cw.c / total.n) + ln(0.4) * least(t.i, 2) END AS s
  FROM t JOIN c1 cw ON t.w = cw.w CROSS JOIN total LEFT JOIN c1 cv ON t.v = cv.w LEFT JOIN c2 vw ON t.v = vw.v AND t.w = vw.w
  LEFT JOIN c2 uv ON t.u = uv.v AND t.v = uv.w LEFT JOIN c3 ON t.u = c3.u AND t.v = c3.v AND t.w = c3.w),
g AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM x GROUP BY doc_id)
SELECT documents.doc_id, coalesce(g.n, 0) AS n_tokens, round(coalesce(g.s, 0), 4) AS log_score, round(g.s / g.n, 6) AS mean_log_score FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id
"""

VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, r) AS (SELECT vec_id, vec_id FROM e UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.a),
c AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""

RULES = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) q WHERE regexp_matches(line, {WORDS}) GROUP BY doc_id),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) > 2) q),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k CROSS JOIN (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT t.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM t LEFT JOIN l ON t.doc_id = l.doc_id LEFT JOIN r ON t.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count_if(base_failed) AS k FROM f GROUP BY host),
p AS (SELECT sum(k) / sum(n) AS mean, avg((k / n) * (k / n)) AS m2, avg(k / n) AS m1, avg(1 / n) AS inv FROM h),
q AS (SELECT mean, CASE WHEN m2 - m1 * m1 - mean * (1 - mean) * inv > 0 THEN greatest(mean * (1 - mean) / (m2 - m1 * m1 - mean * (1 - mean) * inv) - 1, 1.0) ELSE 1e6 END AS strength FROM p),
z AS (SELECT host, (k + mean * strength) / (n + strength) >= 0.6 AS refused FROM h CROSS JOIN q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT refused AS kept FROM f JOIN z ON f.host = z.host
"""


def license_templates() -> str:
    """VALUES of (t, base, label, words, key_at, key_n)."""
    return ",\n".join(f"({t}, {e['base']}, '{e['label']}', [{', '.join(map(repr, e['words']))}], {e['key_at']}, {len(e['key'])})" for t, e in enumerate(templates()))


LICENSES = rf"""
WITH tpl(t, base, label, words, key_at, key_n) AS (VALUES {license_templates()}),
d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
tw AS (SELECT t, base, label, key_at, key_n, len(words) AS n, unnest(words) AS w, unnest(range(len(words))) AS o FROM tpl),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM tok WHERE w IN (SELECT w FROM tw) GROUP BY w),
ranked AS (SELECT tw.*, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), o) AS r FROM tw LEFT JOIN df ON tw.w = df.w WHERE o >= key_at AND o < key_at + key_n),
starts AS (SELECT tok.doc_id, ranked.t, tok.i - ranked.o AS start FROM tok JOIN ranked ON tok.w = ranked.w WHERE r <= 2 GROUP BY ALL HAVING count(DISTINCT r) = 2),
placed AS (SELECT s.doc_id, s.t, s.start, tw.base, tw.label, tw.n, tw.key_n, CASE WHEN tok.w = tw.w THEN 1 ELSE 0 END AS hit, CASE WHEN tok.w = tw.w AND tw.o >= tw.key_at AND tw.o < tw.key_at + tw.key_n THEN 1 ELSE 0 END AS key_hit
  FROM starts s JOIN tw ON s.t = tw.t LEFT JOIN tok ON tok.doc_id = s.doc_id AND tok.i = s.start + tw.o),
judged AS (SELECT doc_id, start, base, label, sum(hit) / n AS cover, sum(key_hit) = key_n AS key FROM placed GROUP BY doc_id, t, start, base, label, n, key_n),
found AS (SELECT doc_id, count(CASE WHEN base AND key THEN 1 END) AS n_base, min(CASE WHEN base AND key THEN start END)::BIGINT AS first_word, max(CASE WHEN base AND key THEN start END)::BIGINT AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base AND key)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE key AND (base OR cover >= 0.75))), ',') AS labels, max(cover) AS score FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN found ON d.doc_id = found.doc_id
"""

SUFFIX = r"""
WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT doc_id, i, doc_id * 1000000000 + i AS pos, md5_number(substring(h, 2 * i + 1, 200)) AS x
  FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS i FROM b) q),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, pos > min(pos) OVER (PARTITION BY x) AS again FROM s) q WHERE again),
k AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER p + 100 OR lag(i) OVER p IS NULL THEN 1 ELSE 0 END AS fresh FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k) q GROUP BY doc_id, run),
g AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS begins, list(z ORDER BY a) AS ends FROM r GROUP BY doc_id)
SELECT b.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN begins IS NULL THEN h ELSE list_reduce(list_transform(range(1, len(begins) + 2), lambda j:
    substring(h, CASE WHEN j = 1 THEN 1 ELSE 2 * ends[j - 1] + 1 END, 2 * (CASE WHEN j > len(begins) THEN len(h) // 2 ELSE begins[j] END - CASE WHEN j = 1 THEN 0 ELSE ends[j - 1] END))), lambda u, v: u || v) END)) AS kept_sha256
FROM b LEFT JOIN g ON b.doc_id = g.doc_id
"""

MERKLE = merkle_sql()

ORACLES = {
    "op2_license_scan": LICENSES,
    "op1_minhash_dedup": MINHASH,
    "op5_url_filter": URL_FILTER,
    "op6_backoff_lm": BACKOFF,
    "op8_vector_dedup": VECTORS,
    "op10_quality_rules": RULES,
    "op12_merkle_manifest": MERKLE,
    "op13_suffix_dedup": SUFFIX,
}
