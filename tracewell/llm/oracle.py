"""SQL (DuckDB) for the queries that it can express: plain counting and comparing, by other ways than the operators'.

Components are closures of the link relation. Words are maximal runs of ASCII letters and digits and of all that is not ASCII.
"""

from __future__ import annotations

_UPPER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all({_UPPER}, '{_WORD}') AS w FROM {table}"


#: Links of nodes a and b (both ways), to one row per node with the smallest node it reaches.
_CLOSED = """, reach(a, b) AS (SELECT DISTINCT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

OP2 = (
    """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v), f AS (SELECT * FROM u WHERE n > 0),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95)"""
    + _CLOSED
    + """, n AS (SELECT a, count(*) AS k FROM link GROUP BY a)
    SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id <= coalesce(l.b, vec_id) AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id"""
)

OP6 = (
    f"""WITH RECURSIVE d AS ({_words("documents", "doc_id")}), c AS (SELECT min(doc_id) AS a, w, count(*) AS copies FROM d WHERE len(w) > 0 GROUP BY w),
    s AS (SELECT a, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM c),
    n AS (SELECT a, count(*) AS n FROM s GROUP BY a), k AS (SELECT x.a, y.a AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.a <> y.a GROUP BY x.a, y.a),
    link AS (SELECT k.a, k.b FROM k JOIN n p ON p.a = k.a JOIN n q ON q.a = k.b WHERE k >= 0.8 * (p.n + q.n - k) - 1e-9)"""
    + _CLOSED
    + """, m AS (SELECT l.a, sum(c.copies)::BIGINT AS k FROM link l JOIN c ON c.a = l.b GROUP BY l.a)
    SELECT d.doc_id, coalesce(c.a, d.doc_id) AS class_id, coalesce(m.k, 0) + coalesce(c.copies, 1) - 1 AS n_links, least(coalesce(c.a, d.doc_id), coalesce(t.b, d.doc_id)) AS component_id,
      d.doc_id = least(coalesce(c.a, d.doc_id), coalesce(t.b, d.doc_id)) AS kept FROM d LEFT JOIN c ON c.w = d.w AND len(d.w) > 0 LEFT JOIN m ON m.a = c.a LEFT JOIN least t ON t.a = c.a"""
)

OP8 = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS raw FROM l),
    t AS (SELECT doc_id, i, raw, trim(raw, ' ') AS s FROM r), e AS (SELECT s, min((doc_id, i)) AS first, length(s) AS n FROM t WHERE regexp_matches(s, '[^\t-\r ]') GROUP BY s),
    k AS (SELECT *, unnest([n, n - 1]) AS m FROM e WHERE n >= 16), h AS (SELECT *, unnest([s[1:m // 2] || '<', '>' || right(s, m - m // 2)]) AS part FROM k),
    c AS (SELECT DISTINCT a.s, b.s AS o FROM h a JOIN h b ON a.m = b.m AND a.part = b.part AND a.first > b.first AND least(a.n, b.n) = a.m),
    p AS (SELECT s, o, coalesce(list_position(list_transform(range(1, least(length(s), length(o)) + 1), lambda i: s[i] = o[i]), false), least(length(s), length(o)) + 1) AS p FROM c),
    near AS (SELECT DISTINCT s FROM p WHERE (length(s) = length(o) AND s[p + 1:] = o[p + 1:]) OR (length(s) = length(o) + 1 AND s[p + 1:] = o[p:]) OR (length(s) + 1 = length(o) AND s[p:] = o[p + 1:])),
    g AS (SELECT t.doc_id, t.i, t.raw, e.s IS NOT NULL AND (n.s IS NOT NULL OR (t.doc_id, t.i) > e.first) AS gone FROM t LEFT JOIN e ON e.s = t.s LEFT JOIN near n ON n.s = t.s),
    q AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id"""

OP10 = f"""WITH d AS ({_words("documents", "doc_id")}), b AS ({_words("benchmark", "item_id")}),
    v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
    z AS (SELECT DISTINCT n FROM v), g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM d, z WHERE len(w) >= n),
    h AS (SELECT doc_id, i, g.n, item_id FROM g JOIN v ON v.n = g.n AND v.s = g.s),
    p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP1 = f"""WITH d AS ({_words("documents", "doc_id")}), g AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(coalesce(quality, 0)) = 1 AND max(coalesce(toxic, 0)) <> 1),
    t AS (SELECT doc_id, unnest(w) AS w, unnest(list_prepend('', w[1:len(w) - 1])) AS v, doc_id IN (SELECT doc_id FROM g) AS good FROM d WHERE len(w) > 0),
    one AS (SELECT w, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS r FROM t GROUP BY w), two AS (SELECT v, w, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS r FROM t GROUP BY v, w),
    first AS (SELECT count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS r FROM t WHERE v = ''), n AS (SELECT sum(g) AS g, sum(r) AS r, count(*) AS v FROM one),
    mine AS (SELECT doc_id, w, count(*) AS k FROM t GROUP BY ALL), pairs AS (SELECT doc_id, v, w, count(*) AS k FROM t GROUP BY ALL), size AS (SELECT doc_id, count(*) AS k FROM t GROUP BY doc_id),
    c AS (SELECT t.doc_id, good, z.k AS size, mw.k AS kw, mb.k AS kb, CASE WHEN t.v = '' THEN 1 ELSE mv.k END AS kv, ow.g AS gw, ow.r AS rw, tw.g AS gb, tw.r AS rb, CASE WHEN t.v = '' THEN f.g ELSE ov.g END AS gv, CASE WHEN t.v = '' THEN f.r ELSE ov.r END AS rv, n.g AS gn, n.r AS rn, n.v AS nv
      FROM t JOIN size z USING (doc_id) JOIN mine mw ON mw.doc_id = t.doc_id AND mw.w = t.w LEFT JOIN mine mv ON mv.doc_id = t.doc_id AND mv.w = t.v JOIN pairs mb ON mb.doc_id = t.doc_id AND mb.v = t.v AND mb.w = t.w
      JOIN one ow ON ow.w = t.w LEFT JOIN one ov ON ov.w = t.v JOIN two tw ON tw.v = t.v AND tw.w = t.w, first f, n),
    p AS (SELECT doc_id, good::INT AS a, (NOT good)::INT AS b, * EXCLUDE (doc_id, good) FROM c),
    l AS (SELECT doc_id, -ln((gb - a * kb + 8 * ((gw - a * kw + 1) / (gn - a * size + nv))) / (gv - a * kv + 8)) AS lt, -ln((rb - b * kb + 8 * ((rw - b * kw + 1) / (rn - b * size + nv))) / (rv - b * kv + 8)) AS lb FROM p),
    s AS (SELECT doc_id, count(*) AS n_tokens, avg(lt) AS ce_target, avg(lb) AS ce_background FROM l GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(ce_target, 8) AS ce_target, round(ce_background, 8) AS ce_background, round(ce_target - ce_background, 8) AS score FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""

#: Texts as hexadecimal digits: two a byte.
OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    x AS (SELECT doc_id, n, h, unnest(range(0, (n - 50) // 1000 + 1)) * 1000 AS base FROM d WHERE n >= 50), c AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 2098) AS h FROM x),
    w AS (SELECT doc_id, base + i AS i, hash(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, base, h, unnest(range(0, least(1000, n - 49 - base))) AS i FROM c)), m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
    g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (s) WHERE doc_id > first),
    r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g), p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
    q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM p),
    k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

SQL = {"op5_suffix_dedup": OP5, "op1_lm_scoring": OP1, "op2_embedding_dedup": OP2, "op6_ngram_join": OP6, "op8_line_dedup": OP8, "op10_decontamination": OP10}
