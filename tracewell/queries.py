"""Queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.config import CFG
from tracewell.functions import udfs
from tracewell.functions.lexicons import DERIVATIONS, ENDINGS, FUNCTION_WORDS
from tracewell.operators import anchors, diagnose, evaluate, grams, inference, scoring, verify, words
from tracewell.operators.keep import kept, spread
from tracewell.plans import align as plan
from tracewell.plans import variants
from tracewell.plans.variants import VARIANTS

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the alignment as SQL --------------------------------------------------------------------

_FUNC = ", ".join(f"'{w}'" for w in sorted(FUNCTION_WORDS))
_GRAMS = "list_concat(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)), list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4)))".format
_SENTS = r"""
WITH turns AS (SELECT conv_id AS pair_id, CASE role WHEN 'user' THEN 'source' WHEN 'assistant' THEN 'claim' END AS side, turn AS ord,
                      string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS l
               FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL),
parts AS (SELECT pair_id, side, ord, generate_subscripts(l, 1) AS pos, trim(unnest(l), ' ') AS text FROM turns),
sents AS (SELECT pair_id, side, row_number() OVER (PARTITION BY pair_id, side ORDER BY ord, pos) - 1 AS idx, text FROM parts WHERE text <> '')"""
_WORDED = (
    _SENTS
    + rf""",
told AS (SELECT pair_id, side, idx, list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w, i: {{'tok': lower(w), 'pos': i - 1}}),
           lambda x: regexp_full_match(x.tok, '[0-9]+') OR (length(x.tok) > 2 AND x.tok NOT IN ({_FUNC}))) AS t FROM sents),
tokens AS (SELECT pair_id, side, idx, generate_subscripts(t, 1) - 1 AS ord, unnest(t) AS x FROM told)"""
)
_VECTORS = (
    _WORDED
    + rf""",
plain AS (SELECT pair_id, side, idx, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_ ]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS t FROM sents),
prep AS (SELECT pair_id, side, idx, ' ' || t || ' ' AS t FROM plain WHERE t <> ''),
grams AS (SELECT pair_id, side, idx, unnest({_GRAMS("t")}) AS gram FROM prep),
counts AS (SELECT pair_id, side, idx, gram, count(*) AS tf FROM grams GROUP BY ALL),
df AS (SELECT pair_id, gram, count(*) AS df FROM counts GROUP BY ALL),
n AS (SELECT pair_id, count(*) AS n FROM sents GROUP BY ALL),
raw AS (SELECT c.*, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM counts c JOIN df USING (pair_id, gram) JOIN n USING (pair_id)),
vec AS (SELECT pair_id, side, idx, gram, w / sqrt(sum(w * w) OVER (PARTITION BY pair_id, side, idx)) AS w FROM raw),
joined AS (SELECT pair_id, side, idx, ' ' || array_to_string(list_transform(t, lambda x: x.tok), ' ') || ' ' AS t FROM told WHERE len(t) > 0),
content AS (SELECT DISTINCT pair_id, side, idx, unnest({_GRAMS("t")}) AS gram FROM joined),
bundle AS (SELECT coalesce(v.pair_id, c.pair_id) AS pair_id, coalesce(v.side, c.side) AS side, coalesce(v.idx, c.idx) AS idx, coalesce(v.gram, c.gram) AS gram, w, c.gram IS NOT NULL AS content
           FROM vec v FULL JOIN content c ON v.pair_id = c.pair_id AND v.side = c.side AND v.idx = c.idx AND v.gram = c.gram)"""
)
_SCORED = (
    _VECTORS
    + rf""",
hits AS (SELECT c.pair_id, c.idx AS ci, s.idx AS si, sum(c.w * s.w) AS lex, sum(c.w) FILTER (c.content AND s.content) AS wa, sum(s.w) FILTER (c.content AND s.content) AS wb, count(*) FILTER (c.content AND s.content) AS shared
         FROM bundle c JOIN bundle s ON c.pair_id = s.pair_id AND c.gram = s.gram AND c.side = 'claim' AND s.side = 'source' GROUP BY ALL),
totals AS (SELECT pair_id, side, idx, sum(w) FILTER (content) AS total, count(*) FILTER (content) AS n_content FROM bundle GROUP BY ALL),
near AS (SELECT h.pair_id, ci, si FROM hits h JOIN totals t ON t.pair_id = h.pair_id AND t.side = 'claim' AND t.idx = h.ci WHERE shared / greatest(n_content, 1) >= 0.10),
spelt AS (SELECT DISTINCT pair_id, side, x.tok AS tok FROM tokens),
spelt_grams AS (SELECT pair_id, side, tok, len(g) AS m, unnest(g) AS gram FROM (SELECT pair_id, side, tok, list_distinct({_GRAMS("(' ' || tok || ' ')")}) AS g FROM spelt)),
likely AS (SELECT s.pair_id, s.tok AS st, c.tok AS ct, count(*) AS k FROM spelt_grams s JOIN spelt_grams c ON s.pair_id = c.pair_id AND s.gram = c.gram AND s.side = 'source' AND c.side = 'claim'
         GROUP BY s.pair_id, s.tok, c.tok, s.m HAVING count(*) / s.m >= 0.6),
met AS (SELECT n.pair_id, n.ci, n.si, s.ord AS so, s.x.pos AS sp, c.x.pos AS cp, row_number() OVER (PARTITION BY n.pair_id, n.ci, n.si, s.ord ORDER BY k DESC, c.ord) AS r
        FROM near n JOIN tokens s ON s.pair_id = n.pair_id AND s.side = 'source' AND s.idx = n.si JOIN likely l ON l.pair_id = n.pair_id AND l.st = s.x.tok
        JOIN tokens c ON c.pair_id = n.pair_id AND c.side = 'claim' AND c.idx = n.ci AND c.x.tok = l.ct),
hit AS (SELECT * FROM met WHERE r = 1),
n_hits AS (SELECT pair_id, ci, si, count(*) AS h FROM hit GROUP BY ALL),
two AS (SELECT a.pair_id, a.ci, a.si, count(*) AS ges, count(*) FILTER (abs(a.sp - b.sp) <= 8) AS nah FROM hit a JOIN hit b ON a.pair_id = b.pair_id AND a.ci = b.ci AND a.si = b.si AND a.so < b.so AND abs(a.cp - b.cp) <= 8 GROUP BY ALL),
coloc AS (SELECT pair_id, ci, si, nah / ges * least(1.0, h / 5) AS k FROM two JOIN n_hits USING (pair_id, ci, si)),
scored AS (SELECT c.pair_id, c.idx AS ci, s.idx AS si, coalesce(lex, 0) AS lex, coalesce(wa / tc.total, 0) AS a, coalesce(wb / ts.total, 0) AS b, coalesce(k, 0) AS k, s.text LIKE '%?' AS question
           FROM sents c JOIN sents s ON c.pair_id = s.pair_id AND c.side = 'claim' AND s.side = 'source'
           LEFT JOIN hits h ON h.pair_id = c.pair_id AND h.ci = c.idx AND h.si = s.idx
           LEFT JOIN coloc o ON o.pair_id = c.pair_id AND o.ci = c.idx AND o.si = s.idx
           LEFT JOIN totals tc ON tc.pair_id = c.pair_id AND tc.side = 'claim' AND tc.idx = c.idx
           LEFT JOIN totals ts ON ts.pair_id = c.pair_id AND ts.side = 'source' AND ts.idx = s.idx),
cov AS (SELECT *, least(1.0, a * (0.75 + 0.25 * least(1.0, b / 0.30)) + 0.30 * k) AS cov FROM scored)"""
)
_FUSED = (
    _SCORED
    + """,
sizes AS (SELECT pair_id, greatest(count(*) FILTER (side = 'claim') - 1, 1) AS m, greatest(count(*) FILTER (side = 'source') - 1, 1) AS n FROM sents GROUP BY ALL),
fused AS (SELECT *, least(1.0, (0.28 * cov + 0.20 * lex + 0.12 * (1 - abs(si / n - ci / m))) / 0.60) * CASE WHEN question THEN 0.55 ELSE 1 END AS fused FROM cov JOIN sizes USING (pair_id)),
ranked AS (SELECT *, row_number() OVER w AS rank, max(fused) OVER (PARTITION BY pair_id, ci) AS s1 FROM fused WINDOW w AS (PARTITION BY pair_id, ci ORDER BY round(fused, 9) DESC, si)),
best AS (SELECT pair_id, ci, max(si) FILTER (rank = 1) AS si, max(fused) FILTER (rank = 1) AS top, max(fused) FILTER (rank = 2) AS s2, max(lex) FILTER (rank = 1) AS lex, max(cov) FILTER (rank = 1) AS cov,
                coalesce(list(si ORDER BY rank) FILTER (rank > 1 AND fused >= greatest(0.60, s1 - 0.07)), []) AS near FROM ranked GROUP BY ALL),
c0 AS (SELECT b.*, CASE WHEN top >= 0.44 THEN 'direkt' ELSE 'keine_quelle' END AS relation, CASE WHEN top >= 0.44 THEN [si] ELSE [] END AS srcs, CASE WHEN top >= 0.60 THEN near ELSE [] END AS redundant,
              top >= 0.44 AND top < 0.60 AS below, length(s.text) AS len, []::DOUBLE[] AS gains FROM best b JOIN sents s ON s.pair_id = b.pair_id AND s.side = 'claim' AND s.idx = b.ci)"""
)


def _rounds(last: str, rounds: int) -> str:
    """The greedy cover as SQL: each round adds the source that explains most of what is left."""
    out = rf""",
cg AS (SELECT pair_id, idx AS ci, gram, w / sum(w) OVER (PARTITION BY pair_id, idx) AS share FROM bundle WHERE side = 'claim' AND content AND w IS NOT NULL),
sg AS (SELECT pair_id, idx AS si, gram FROM bundle WHERE side = 'source' AND content),
tg AS (SELECT pair_id, idx AS ci, ord, unnest(list_distinct({_GRAMS("(' ' || x.tok || ' ')")})) AS gram FROM tokens WHERE side = 'claim')"""
    for k in range(1, rounds + 1):
        out += f""",
o{k} AS (SELECT * FROM {last} WHERE relation <> 'keine_quelle' AND len >= 55 AND len(srcs) < 3),
h{k} AS (SELECT DISTINCT e.pair_id, e.ci, sg.gram FROM (SELECT pair_id, ci, unnest(srcs) AS si FROM o{k}) e JOIN sg USING (pair_id, si)),
g{k} AS (SELECT r.pair_id, r.ci, sg.si, r.gram, r.share FROM cg r JOIN o{k} USING (pair_id, ci) LEFT JOIN h{k} h ON h.pair_id = r.pair_id AND h.ci = r.ci AND h.gram = r.gram
         JOIN sg ON sg.pair_id = r.pair_id AND sg.gram = r.gram WHERE h.gram IS NULL),
a{k} AS (SELECT pair_id, ci, si, sum(share) AS gain FROM g{k} GROUP BY ALL),
w{k} AS (SELECT pair_id, ci, si, count(*) AS carriers FROM (SELECT pair_id, ci, si, ord, sum(share) AS s FROM g{k} JOIN tg USING (pair_id, ci, gram) GROUP BY ALL) WHERE s > 0.01 GROUP BY ALL),
d{k} AS (SELECT a.*, carriers, list_min(list_transform(list_concat(srcs, redundant), lambda s: abs(s - a.si))) AS d, list_min(list_transform(srcs, lambda s: abs(s - a.si))) AS ds
         FROM a{k} a JOIN w{k} USING (pair_id, ci, si) JOIN o{k} USING (pair_id, ci) JOIN scored q ON q.pair_id = a.pair_id AND q.ci = a.ci AND q.si = a.si
         WHERE NOT question AND NOT list_contains(srcs, a.si) AND NOT list_contains(redundant, a.si)),
b{k} AS (SELECT * FROM d{k} WHERE gain >= CASE WHEN d <= 2 THEN 0.10 ELSE 0.22 END AND carriers >= CASE WHEN ds <= 2 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY pair_id, ci ORDER BY round(gain, 9) DESC, si) = 1),
c{k} AS (SELECT c.* REPLACE (CASE WHEN b.si IS NULL THEN srcs ELSE list_append(srcs, b.si) END AS srcs, CASE WHEN b.si IS NULL THEN gains ELSE list_append(gains, b.gain) END AS gains)
         FROM {last} c LEFT JOIN b{k} b ON b.pair_id = c.pair_id AND b.ci = c.ci)"""
        last = f"c{k}"
    return out


_COVERED = _FUSED + _rounds("c0", 2)
_DECIDED = (
    _COVERED
    + """,
related AS (SELECT * REPLACE (CASE WHEN relation = 'direkt' AND len(srcs) > 1 THEN 'aggregiert' ELSE relation END AS relation), list_concat(srcs, list_filter(redundant, lambda s: NOT list_contains(srcs, s))) AS sources FROM c2),
sides AS (SELECT r.pair_id, r.ci, max(fused) FILTER (list_contains(sources, f.si)) AS i, max(fused) FILTER (NOT list_contains(sources, f.si)) AS o FROM related r JOIN fused f ON f.pair_id = r.pair_id AND f.ci = r.ci GROUP BY ALL),
margined AS (SELECT r.*, round(greatest(0, CASE WHEN relation = 'keine_quelle' THEN top - coalesce(s2, 0) ELSE i - coalesce(o, 0) END), 2) AS margin FROM related r JOIN sides USING (pair_id, ci)),
held AS (SELECT pair_id, ci, sum(share) AS cov_total FROM (SELECT DISTINCT e.pair_id, e.ci, cg.gram, cg.share FROM (SELECT pair_id, ci, unnest(sources) AS si FROM related) e JOIN sg USING (pair_id, si) JOIN cg ON cg.pair_id = e.pair_id AND cg.ci = e.ci AND cg.gram = sg.gram) GROUP BY ALL),
done AS (SELECT m.*, coalesce(cov_total, 0) AS cov_total,
    round(CASE WHEN relation = 'keine_quelle' THEN least(0.97, 0.55 + (0.44 - top) * 2.2)
          ELSE greatest(0.05, least(0.98, greatest(0, least(1, coalesce(cov_total, 0))) * (0.85 + 0.15 * least(1, margin / 0.15)))) END, 2) AS confidence
    FROM margined m LEFT JOIN held USING (pair_id, ci))"""
)


@query(_SENTS + " SELECT pair_id, side, idx, text FROM sents")
def sentences(spark, sf_dir):
    """T5 over plain marks (the scanner's own sentences: ``document_sentences``)."""
    return grams.sentences(plan.turns(table(spark, sf_dir, "conversations")))


@query(_VECTORS + " SELECT pair_id, side, idx, count(w) AS n_grams, round(sum(w), 6) AS weight, count(*) FILTER (content) AS n_content, round(coalesce(sum(w) FILTER (content), 0), 6) AS content_weight FROM bundle GROUP BY ALL")
def tfidf_vectors(spark, sf_dir):
    """Vectors and which of their grams are content."""
    s = grams.sentences(plan.turns(table(spark, sf_dir, "conversations")))
    v = grams.tfidf(grams.gram_counts(s), s).groupBy(*grams.UNIT)
    own = F.when(F.col("content"), F.col("w"))
    return v.agg(F.count("w").alias("n_grams"), F.round(F.sum("w"), 6).alias("weight"), F.count(F.when(F.col("content"), 1)).alias("n_content"), F.round(F.coalesce(F.sum(own), F.lit(0.0)), 6).alias("content_weight"))


_FLOOR = _VECTORS.replace("ln((1 + n) / (1 + df)) + 1", "greatest(1.5, ln((1 + n) / (1 + df)) + 1)")


@query(_FLOOR + " SELECT pair_id, side, idx, round(sum(w), 6) AS weight, round(max(w), 6) AS most FROM vec GROUP BY ALL")
def tfidf_floor(spark, sf_dir):
    """V3: the same vectors with a least idf, which changes the weights of common grams."""
    s = grams.sentences(plan.turns(table(spark, sf_dir, "conversations")))
    v = grams.tfidf(grams.gram_counts(s), s, replace(CFG, idf_floor=1.5)).filter("w is not null")
    return v.groupBy(*grams.UNIT).agg(F.round(F.sum("w"), 6).alias("weight"), F.round(F.max("w"), 6).alias("most"))


@query(_WORDED + " SELECT pair_id, side, idx, ord, x.tok AS tok, x.pos AS pos FROM tokens")
def sentence_words(spark, sf_dir):
    """Content words with their place among all words."""
    return grams.words(grams.sentences(plan.turns(table(spark, sf_dir, "conversations"))))


@query(_SCORED + " SELECT pair_id, ci, si, round(lex, 6) AS lex, round(a, 6) AS a, round(b, 6) AS b, round(k, 6) AS k, round(cov, 6) AS cov FROM cov")
def pair_scores(spark, sf_dir):
    """Cosine, coverage over content grams both ways, co-locality."""
    _, _, s = plan.scored(plan.turns(table(spark, sf_dir, "conversations")))
    return s.select("pair_id", "ci", "si", *(F.round(c, 6).alias(c) for c in ("lex", "a", "b", "k", "cov")))


@query(_FUSED + """ SELECT pair_id, ci, si, round(top, 6) AS top, round(s2, 6) AS s2, relation, array_to_string(srcs, ',') AS srcs, array_to_string(redundant, ',') AS redundant, below,
    CASE WHEN top < 0.44 AND top >= 0.264 THEN si END AS candidate FROM c0""")
def primary_sources(spark, sf_dir):
    """Fusion, ranking, the first source with its equals, the candidate that just misses."""
    sents, _, s = plan.scored(plan.turns(table(spark, sf_dir, "conversations")))
    p = scoring.primary(scoring.fused(s, sents))
    return p.select("pair_id", "ci", "si", F.round("top", 6).alias("top"), F.round("s2", 6).alias("s2"), "relation", *(F.array_join(c, ",").alias(c) for c in ("srcs", "redundant")), "below", "candidate")


@query(_DECIDED + """ SELECT pair_id, ci, CASE WHEN relation <> 'keine_quelle' THEN si END AS si, round(top, 6) AS top, round(lex, 6) AS lex, round(cov, 6) AS cov, margin, relation, array_to_string(sources, ',') AS sources,
    array_to_string(list_transform(gains, lambda g: printf('%.4f', g)), ',') AS gains, round(cov_total, 6) AS cov_total, confidence, below AND cov_total < 0.60 AS weak FROM done""")
def align(spark, sf_dir):
    """The native plan: V1-V9, R2-R6, R8-R10, J14 over plain sentences (scanners and models: ``traced_conversations``)."""
    out = plan.align(plan.turns(table(spark, sf_dir, "conversations")))
    si = F.when(F.col("relation") != "keine_quelle", F.col("si"))
    gains = F.array_join(F.transform("gains", lambda g: F.format_string("%.4f", g["gain"])), ",")
    return out.select("pair_id", "ci", si.alias("si"), *(F.round(c, 6).alias(c) for c in ("top", "lex", "cov")), "margin", "relation", F.array_join("sources", ",").alias("sources"), gains.alias("gains"), F.round("cov_total", 6).alias("cov_total"), "confidence", "weak")


@query(
    """WITH p AS (SELECT a.label AS pair_id, a.vec_id AS ci, b.vec_id AS si,
      list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
      / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS cos
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY cos) - 1 AS k, count(*) OVER (PARTITION BY pair_id) AS n, max(cos) OVER (PARTITION BY pair_id) AS hi FROM p),
    s AS (SELECT *, max(CASE WHEN k = floor(0.10 * (n - 1)) THEN cos END) OVER (PARTITION BY pair_id) AS lo FROM r),
    t AS (SELECT *, CASE WHEN hi > lo THEN greatest(0, least(1, (cos - lo) / (hi - lo))) ELSE 0 END AS scaled FROM s),
    q AS (SELECT *, row_number() OVER (PARTITION BY ci ORDER BY round(cos, 9) DESC, si) AS rank FROM t)
    SELECT pair_id, ci, si, rank, round(cos, 6) AS cos, round(scaled, 6) AS scaled FROM q WHERE rank <= 3"""
)
def dense_rescaled(spark, sf_dir):
    """V5, V12 (given vectors), V13, R3: three nearest vectors of the same label, rescaled."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("label").alias("pair_id"), F.col("vec_id").alias("ci"), F.col("embedding").alias("ea")), e.select(F.col("label").alias("pair_id"), F.col("vec_id").alias("si"), F.col("embedding").alias("eb"))
    p = a.join(b, "pair_id").filter("ci != si").select("pair_id", "ci", "si", scoring.cosine("ea", "eb").alias("cos"))
    s = scoring.rescaled(p, "cos")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("ci").orderBy(F.round("cos", 9).desc(), "si"))).filter("rank <= 3")
    return s.select("pair_id", "ci", "si", "rank", F.round("cos", 6).alias("cos"), F.round("scaled", 6).alias("scaled"))


_NEG = r"nicht|nichts|kein[\p{L}\p{N}_]*|nie|niemals|niemand|ohne|weder|kaum|nirgend[\p{L}\p{N}_]*|aufgehoben|abgesagt|gestrichen"


@query(rf"""WITH t AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ' AS t, text, length(text) - length(translate(text, '„«‚', '')) AS up, length(text) - length(translate(text, '“”»‘"', '')) AS down
      FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, regexp_matches(t, ' ({_NEG}) ') AS negated, up - down AS quote_balance, up + down > 0 AS quoted,
    substr(sha256(text), 1, 16) AS hash, CASE WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 1000 / 1000 < 0.5 THEN 'test' ELSE 'dev' END AS split FROM t""")
def text_features(spark, sf_dir):
    """E17, E18, E21, A9 (split)."""
    d = evaluate.hash_split(table(spark, sf_dir, "documents").filter("text is not null"), "text", 0.5)
    less = lambda marks: F.length("text") - F.length(F.translate("text", marks, ""))
    up, down = less("„«‚"), less('“”»‘"')
    return d.select("doc_id", inference.negated(F.col("text")).alias("negated"), (up - down).alias("quote_balance"), (up + down > 0).alias("quoted"), "hash", "split")


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents)
    SELECT doc_id, count(*) AS n_content, count(DISTINCT w) AS n_distinct FROM w WHERE regexp_full_match(w, '[0-9]+') OR (length(w) > 2 AND w NOT IN ({_FUNC})) GROUP BY doc_id""")
def content_tokens(spark, sf_dir):
    """T13 over whole documents."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(grams.content_tokens(F.col("text"))).alias("w"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_content"), F.countDistinct("w.tok").alias("n_distinct"))


_CODES = r"[A-ZÄÖÜ]{2,}|[A-Za-zÄÖÜäöü]+[0-9]+|[0-9]+[A-Za-zÄÖÜäöü]+"


@query(rf"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[-–/\s]')) AS p FROM documents),
    c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(p, '{_CODES}')) AS code FROM p)
    SELECT code, count(*) AS n_docs, min(doc_id) AS first_doc FROM c GROUP BY code""")
def code_index(spark, sf_dir):
    """E9 without chains (they are in ``code_findings``)."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(verify.codes_of(F.col("text"))).alias("code"))
    return c.groupBy("code").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(r"""WITH w AS (SELECT doc_id, 0 AS part, unnest(l) AS w, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS l FROM documents)
      UNION ALL SELECT doc_id, 1, unnest(l), generate_subscripts(l, 1) FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[-–/]', ' ', 'g'), '[\p{L}\p{N}_]+') AS l FROM documents)),
    f AS (SELECT doc_id, lower(w) AS low, w AS spelling, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY part, place) AS k FROM w)
    SELECT doc_id, count(*) AS n_words, substr(sha256(string_agg(low || '=' || spelling, ',' ORDER BY low)), 1, 16) AS digest FROM f WHERE k = 1 GROUP BY doc_id""".replace("\\\\", "\\"))
def token_index(spark, sf_dir):
    """The words of every document with their first spelling."""
    # whole texts are dealt out, not their words
    t = verify.token_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), "text").repartition("pair_id"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "spelling"))), lambda x: F.concat(x["low"], F.lit("="), x["spelling"])), ",")
    return t.groupBy(F.col("pair_id").alias("doc_id")).agg(F.count("*").alias("n_words"), F.substring(F.sha2(listed, 256), 1, 16).alias("digest"))


_RULED = """WITH r AS (SELECT d.doc_id, d.lang, l.quality = 1 AS gold, d.n_chars >= 1000 AS run, d.n_chars / (d.n_chars + 1000.0) AS score, l.quality, l.toxic
    FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.n_chars IS NOT NULL)"""


def _ruled(spark, sf_dir) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").filter("quality is not null")
    j = d.filter("n_chars is not null").join(lab, "doc_id")
    return j.select("doc_id", "lang", (F.col("quality") == 1).alias("gold"), (F.col("n_chars") >= 1000).alias("run"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"), "quality", "toxic")


@query(_RULED + """, c AS (SELECT count(*) FILTER (gold AND run) AS tp, count(*) FILTER (NOT gold AND run) AS fp, count(*) FILTER (gold AND NOT run) AS fn, count(*) FILTER (NOT gold AND NOT run) AS tn FROM r)
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c""")
def rule_two_by_two(spark, sf_dir):
    """A4: a length rule against the quality labels."""
    return evaluate.two_by_two(_ruled(spark, sf_dir), "gold", "run")


@query(_RULED + " SELECT gold, run, count(*) AS n FROM r GROUP BY ALL")
def rule_confusion(spark, sf_dir):
    """A5."""
    return evaluate.confusion(_ruled(spark, sf_dir), "gold", "run")


@query(_RULED + """ SELECT threshold, count(*) FILTER (score >= threshold AND gold) AS kept, count(*) FILTER (score >= threshold AND NOT gold) AS wrong,
    count(*) FILTER (score < threshold AND gold) AS dropped, count(*) FILTER (score < threshold AND NOT gold) AS right
    FROM r, (SELECT unnest([0.25, 0.5, 0.75, 0.9])::DOUBLE AS threshold) GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    """A11."""
    return evaluate.sweep(_ruled(spark, sf_dir), "score", "gold", [0.25, 0.5, 0.75, 0.9])


@query(_RULED + """ SELECT lang, count(*) AS n, sum(CASE WHEN gold = run THEN 1 ELSE 0 END) AS agreed, round(avg(score), 6) AS mean_score, round(min(score), 6) AS lo, round(max(score), 6) AS hi FROM r GROUP BY lang""")
def rule_by_language(spark, sf_dir):
    """Counts and spreads by group."""
    r = _ruled(spark, sf_dir)
    return r.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("gold") == F.col("run")).cast("long")).alias("agreed"), *(F.round(f("score"), 6).alias(n) for f, n in ((F.avg, "mean_score"), (F.min, "lo"), (F.max, "hi"))))


@query(_RULED + """, f AS (SELECT unnest(['low', 'toxic', 'other']) AS flag),
    g AS (SELECT flag, CASE flag WHEN 'low' THEN quality = 0 WHEN 'toxic' THEN coalesce(toxic = 1, false) ELSE false END AS gold, CASE flag WHEN 'low' THEN NOT run WHEN 'toxic' THEN score > 0.9 ELSE false END AS hit FROM r, f)
    SELECT flag, count(*) FILTER (gold AND hit) AS tp, count(*) FILTER (NOT gold AND hit) AS fp, count(*) FILTER (gold AND NOT hit) AS fn FROM g GROUP BY flag""")
def rule_flags(spark, sf_dir):
    """Counts per flag of length rules against the labels."""
    names = lambda **c: F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in c.items())), lambda x: x.isNotNull())
    r = _ruled(spark, sf_dir)
    r = r.select(names(low=F.col("quality") == 0, toxic=F.col("toxic") == 1).alias("gold_flags"), names(low=~F.col("run"), toxic=F.col("score") > 0.9).alias("run_flags"))
    return evaluate.flag_counts(r, ["low", "toxic", "other"])


@query(_RULED + """, e AS (SELECT doc_id, CASE WHEN gold AND NOT run THEN 'missed' WHEN run AND NOT gold THEN 'false' END AS error FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY error ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY error) AS n FROM e WHERE error IS NOT NULL)
    SELECT error, k, n, doc_id FROM k WHERE k <= 10""")
def rule_errors(spark, sf_dir):
    """The first ten errors of each class, and how many there are."""
    gold, run = F.col("gold"), F.col("run")
    return evaluate.error_listing(_ruled(spark, sf_dir), {"missed": gold & ~run, "false": run & ~gold}, ["doc_id"], 10).select("error", "k", "n", "doc_id")


@query(_RULED + """, t AS (SELECT threshold::VARCHAR AS run, count(*) FILTER (score >= threshold AND gold) AS kept, count(*) FILTER (score >= threshold) AS given, count(*) FILTER (gold) AS gold
      FROM r, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold) GROUP BY ALL),
    v AS (SELECT run, CASE WHEN given > 0 THEN kept / given ELSE 0 END AS cip, CASE WHEN gold > 0 THEN kept / gold ELSE 0 END AS cir FROM t)
    SELECT v.run, round(v.cip, 6) AS cip, round(v.cir, 6) AS cir, round(v.cip - b.cip, 6) AS d_cip, round(v.cir - b.cir, 6) AS d_cir FROM v, v b WHERE b.run = '0.25'""")
def run_comparison(spark, sf_dir):
    """Precision and recall of each threshold against those of the first."""
    s = evaluate.sweep(_ruled(spark, sf_dir), "score", "gold", [0.25, 0.5, 0.75])
    kept, wrong, dropped = F.col("kept"), F.col("wrong"), F.col("dropped")
    runs = s.select(F.col("threshold").cast("string").alias("run"), evaluate.ratio(kept, kept + wrong).alias("cip"), evaluate.ratio(kept, kept + dropped).alias("cir"))
    out = evaluate.compared(runs, "0.25", ["cip", "cir"])
    return out.select("run", *(F.round(c, 6).alias(c) for c in ("cip", "cir", "d_cip", "d_cir")))


_HEADED = """, placed AS (SELECT pair_id, idx AS si, text, CASE WHEN idx % 4 = 0 THEN 'heading' ELSE 'body' END AS block FROM sents WHERE side = 'source'),
    asked AS (SELECT pair_id, ci, relation, sources FROM done)"""


@query(_DECIDED + _HEADED + """, wanted AS (SELECT pair_id, ci, unnest(sources) AS si FROM asked
      UNION SELECT a.pair_id, a.ci, p.si FROM asked a JOIN placed p ON p.pair_id = a.pair_id AND p.block = 'heading' AND p.si < coalesce(list_min(sources), 2147483647)
      UNION SELECT a.pair_id, a.ci, b.si FROM asked a JOIN (SELECT pair_id, min(si) AS si FROM placed WHERE block = 'body' GROUP BY ALL) b USING (pair_id))
    SELECT w.pair_id, w.ci, string_agg(p.text, ' ' ORDER BY p.si) AS premise FROM wanted w JOIN placed p USING (pair_id, si) GROUP BY ALL""")
def claim_premises(spark, sf_dir):
    """headings before the first source (every fourth sentence counts as one), the first body sentence and all sources."""
    sents, vectors, scores = plan.scored(plan.turns(table(spark, sf_dir, "conversations")))
    decided = plan.decided(sents, vectors, scoring.fused(scores, sents))
    block = F.when(F.col("idx") % 4 == 0, "heading").otherwise("body")
    return inference.premises(decided, sents.filter("side = 'source'").select("pair_id", F.col("idx").alias("si"), "text", block.alias("block")))


@query("""WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id, a.turn, max(u.turn) AS source_turn FROM a LEFT JOIN u ON u.conv_id = a.conv_id AND u.turn <= a.turn GROUP BY ALL""")
def asof_source(spark, sf_dir):
    """The entry that each claim begins in, by one window instead of a range join; user turns are the entries."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("start"), "role")
    claims, entries = c.filter("role = 'assistant'"), c.filter("role = 'user'").select("pair_id", "start", F.col("start").alias("satz"))
    return evaluate.placed(claims, entries).select(F.col("pair_id").alias("conv_id"), F.col("start").alias("turn"), F.col("satz").alias("source_turn")).distinct()


# quantities of a part as claims (returned lines) and sources (all other lines)
_NUM = """WITH num AS (SELECT l_partkey AS pair_id, CASE l_returnflag WHEN 'R' THEN 'claim' ELSE 'source' END AS side, l_orderkey * 8 + l_linenumber AS idx, l_suppkey AS ord,
      ['zahl', 'geld', 'prozent', 'datum'][l_linenumber % 4 + 1] AS type, CASE WHEN l_suppkey % 7 > 1 THEN l_quantity::DECIMAL(38, 6) END AS value,
      CASE l_suppkey % 7 WHEN 0 THEN l_quantity::INT || ':' || l_linenumber WHEN 1 THEN l_quantity::INT || '-' || (l_quantity::INT + l_linenumber) END AS form FROM lineitem),
    c AS (SELECT * FROM num WHERE side = 'claim'), s AS (SELECT * FROM num WHERE side = 'source'),
    hits AS (SELECT DISTINCT c.pair_id, c.idx AS ci, c.ord, s.idx AS si FROM c JOIN s ON c.pair_id = s.pair_id
      AND (c.form = s.form OR (c.form IS NULL AND s.form IS NULL AND c.value = s.value AND (c.type = s.type OR c.type = 'zahl' OR s.type = 'zahl')))),
    good AS (SELECT h.* FROM hits h JOIN c ON c.pair_id = h.pair_id AND c.idx = h.ci AND c.ord = h.ord WHERE c.type <> 'zahl' OR c.form IS NOT NULL OR c.value >= 10)"""


def _numbers(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("zahl", "geld", "prozent", "datum"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    whole, k = F.col("l_quantity").cast("int"), F.col("l_suppkey") % 7
    form = F.when(k == 0, F.concat(whole.cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))).when(k == 1, F.concat(whole.cast("string"), F.lit("-"), (whole + F.col("l_linenumber")).cast("string")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pair_id"), F.when(F.col("l_returnflag") == "R", "claim").otherwise("source").alias("side"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("idx"),
        F.col("l_suppkey").alias("ord"), kind.alias("type"), F.when(k > 1, F.col("l_quantity").cast("decimal(38,6)")).alias("value"), form.alias("form"),
    )


@query(_NUM + """, v AS (SELECT *, count(*) OVER (PARTITION BY pair_id, ci, ord) AS n FROM good)
    SELECT pair_id, ci, si, round(least(0.38, sum(CASE WHEN n = 1 THEN 0.30 WHEN n <= 3 THEN 0.12 ELSE 0 END))::DOUBLE, 6) AS anchor FROM v GROUP BY ALL""")
def anchor_hits(spark, sf_dir):
    """Equal quantities of fitting types that may serve as anchors, and the bonus they earn."""
    return anchors.anchor_bonus(anchors.anchor_hits(_numbers(spark, sf_dir))).select("pair_id", "ci", "si", F.round("anchor", 6).alias("anchor"))


_NAMES = """WITH names AS (SELECT p_size AS pair_id, CASE WHEN p_type < 'M' THEN 'claim' ELSE 'source' END AS side, p_partkey AS idx, 0 AS ord,
      CASE WHEN p_brand LIKE '%2' THEN 'Dr. ' || split_part(p_name, ' ', 2) WHEN p_brand LIKE '%1' THEN split_part(p_name, ' ', 1) || '-' || p_name || ' ' || p_brand ELSE p_name END AS name FROM part),
    words AS (SELECT *, list_distinct(list_filter(list_transform(regexp_split_to_array(trim(name), '[-\\s]+'), lambda x: trim(lower(x), '.,;:')), lambda x: length(x) > 1 AND x <> 'dr')) AS w FROM names),
    hits AS (SELECT DISTINCT c.pair_id, c.idx AS ci, c.ord, s.idx AS si FROM words c JOIN words s ON c.pair_id = s.pair_id AND c.side = 'claim' AND s.side = 'source' AND len(list_intersect(c.w, s.w)) = least(len(c.w), len(s.w)))"""


def _part_names(spark, sf_dir) -> DataFrame:
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.when(F.col("p_brand").endswith("2"), F.concat(F.lit("Dr. "), second)).when(F.col("p_brand").endswith("1"), F.concat(first, F.lit("-"), "p_name", F.lit(" "), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("pair_id"), F.when(F.col("p_type") < "M", "claim").otherwise("source").alias("side"), F.col("p_partkey").alias("idx"), F.lit(0).alias("ord"), name.alias("name"))


@query(_NAMES + """, v AS (SELECT *, count(*) OVER (PARTITION BY pair_id, ci, ord) AS n FROM hits)
    SELECT pair_id, ci, si, round(sum(CASE n WHEN 1 THEN 0.20 WHEN 2 THEN 0.10 ELSE 0 END)::DOUBLE, 6) AS anchor FROM v GROUP BY ALL""")
def name_anchors(spark, sf_dir):
    """Names that hold all words of another, and the bonus of rare ones."""
    none = anchors.number_hits(_numbers(spark, sf_dir).limit(0)).select(F.col("pair_id").cast("int").alias("pair_id"), "ci", "ord", "si")
    return anchors.anchor_bonus(none, anchors.name_hits(_part_names(spark, sf_dir))).select("pair_id", "ci", "si", F.round("anchor", 6).alias("anchor"))


@query(_NAMES + """, t AS (SELECT DISTINCT p_size AS pair_id, unnest(regexp_extract_all(lower(p_type || ' ' || p_brand), '[\\p{L}\\p{N}_]+')) AS word FROM part),
    k AS (SELECT c.pair_id, c.idx AS ci, c.name, EXISTS (SELECT 1 FROM hits h WHERE h.pair_id = c.pair_id AND h.ci = c.idx) AS hit,
      len(list_filter(c.w, lambda x: NOT list_contains(o.words, x))) = 0 AS told FROM words c JOIN (SELECT pair_id, list(word) AS words FROM t GROUP BY ALL) o USING (pair_id) WHERE c.side = 'claim')
    SELECT pair_id, ci, name, CASE WHEN hit OR told THEN 'match' ELSE 'unbelegt' END AS status FROM k""")
def name_status(spark, sf_dir):
    """names that some source name matches, or whose words all stand in the source's text."""
    text = table(spark, sf_dir, "part").select(F.col("p_size").alias("pair_id"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    return anchors.known_names(_part_names(spark, sf_dir), text).select("pair_id", "ci", "name", "status")


_CHECKED = _NUM + """, chosen AS (SELECT c.pair_id, c.idx AS ci, s.idx AS si FROM c JOIN s ON c.pair_id = s.pair_id AND c.ord % 5 = s.ord % 5),
    lines AS (SELECT DISTINCT l_partkey AS pair_id, l_orderkey * 8 + l_linenumber AS si, l_suppkey % 6 AS paragraph FROM lineitem WHERE l_returnflag <> 'R'),
    near AS (SELECT DISTINCT a.pair_id, a.ci, m.si FROM chosen a JOIN lines l USING (pair_id, si) JOIN lines m ON m.pair_id = l.pair_id AND m.paragraph = l.paragraph)"""
_NEAREST = _CHECKED + """, missing AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.pair_id = c.pair_id AND h.ci = c.idx AND h.ord = c.ord)),
    far AS (SELECT m.pair_id, m.idx AS ci, m.ord, s.idx AS si, s.ord AS so, CASE WHEN n.si IS NULL THEN 1 ELSE 0 END AS far,
      CASE WHEN m.form IS NULL AND s.form IS NULL THEN abs(m.value - s.value)::DOUBLE
           WHEN contains(m.form, ':') AND contains(s.form, ':') THEN abs(split_part(m.form, ':', 1)::DOUBLE - split_part(s.form, ':', 1)::DOUBLE) + abs(split_part(m.form, ':', 2)::DOUBLE - split_part(s.form, ':', 2)::DOUBLE)
           WHEN contains(m.form, '-') AND contains(s.form, '-') THEN abs(split_part(m.form, '-', 1)::DOUBLE - split_part(s.form, '-', 1)::DOUBLE) + abs(split_part(m.form, '-', 2)::DOUBLE - split_part(s.form, '-', 2)::DOUBLE) END AS d
      FROM missing m JOIN s ON m.pair_id = s.pair_id AND m.type = s.type LEFT JOIN near n ON n.pair_id = m.pair_id AND n.ci = m.idx AND n.si = s.idx),
    nearest AS (SELECT * FROM far QUALIFY far = min(far) OVER (PARTITION BY pair_id, ci, ord) AND d IS NOT NULL),
    one AS (SELECT * FROM nearest QUALIFY row_number() OVER (PARTITION BY pair_id, ci, ord ORDER BY d, si, so) = 1),
    checked AS (SELECT c.pair_id, c.idx AS ci, c.ord, CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.pair_id = c.pair_id AND h.ci = c.idx AND h.ord = c.ord) THEN 'match'
       WHEN o.si IS NOT NULL AND EXISTS (SELECT 1 FROM chosen x WHERE x.pair_id = c.pair_id AND x.ci = c.idx) THEN 'konflikt' ELSE 'unbelegt' END AS status, o.si, o.so AS found
       FROM c LEFT JOIN one o ON o.pair_id = c.pair_id AND o.ci = c.idx AND o.ord = c.ord)"""


def _chosen(numbers: DataFrame) -> DataFrame:
    """Claims with the sources whose supplier fits, as the SQL above has them."""
    c, s = (numbers.filter(F.col("side") == x).select("pair_id", F.col("idx").alias(i), (F.col("ord") % 5).alias("k")).distinct() for x, i in (("claim", "ci"), ("source", "si")))
    return c.join(s, ["pair_id", "k"]).groupBy("pair_id", "ci").agg(F.collect_set("si").alias("sources"))


def _lines(numbers: DataFrame) -> DataFrame:
    return numbers.select("pair_id", "side", "idx", (F.col("ord") % 6).alias("paragraph")).distinct()


@query(_CHECKED + " SELECT pair_id, ci, count(*) AS n, sum(si) AS total FROM near GROUP BY ALL")
def near_sets(spark, sf_dir):
    """The sentences of the paragraphs of a claim's sources."""
    n = _numbers(spark, sf_dir)
    return verify.near_set(_chosen(n), _lines(n)).distinct().groupBy("pair_id", "ci").agg(F.count("*").alias("n"), F.sum("si").alias("total"))


@query(_NEAREST + " SELECT pair_id, ci, ord, status, CASE WHEN status = 'konflikt' THEN si END AS si, CASE WHEN status = 'konflikt' THEN found END AS found FROM checked")
def number_status(spark, sf_dir):
    """Matches, conflicts with the nearest comparable quantity, near sentences first, and what is not found."""
    n = _numbers(spark, sf_dir)
    chosen = _chosen(n)
    return verify.checked_numbers(n, verify.near_set(chosen, _lines(n)).distinct(), chosen)


@query(_NEAREST + " SELECT pair_id, ci, concat_ws(',', CASE WHEN bool_or(status = 'konflikt') THEN 'zahlkonflikt' END, CASE WHEN bool_or(status = 'unbelegt') THEN 'zahl_unbelegt' END) AS flags FROM checked GROUP BY ALL")
def number_flags(spark, sf_dir):
    """the flags of a claim's quantities."""
    n = _numbers(spark, sf_dir)
    chosen = _chosen(n)
    return verify.number_flags(verify.checked_numbers(n, verify.near_set(chosen, _lines(n)).distinct(), chosen)).select("pair_id", "ci", F.array_join("flags", ",").alias("flags"))


@query(_NUM + """, first AS (SELECT pair_id, min(idx) AS si FROM s GROUP BY ALL), claims AS (SELECT DISTINCT c.pair_id, c.idx AS ci, f.si FROM c JOIN first f USING (pair_id)),
    alone AS (SELECT pair_id, ci, ord, min(si) AS hit FROM good GROUP BY ALL HAVING count(*) = 1),
    held AS (SELECT DISTINCT pair_id, coalesce('=' || form, value::VARCHAR) AS key FROM s JOIN first f USING (pair_id) WHERE s.idx = f.si),
    extra AS (SELECT k.pair_id, k.ci, list_sort(list_distinct(list(o.hit))) AS e FROM alone o JOIN claims k USING (pair_id, ci) JOIN c ON c.pair_id = o.pair_id AND c.idx = o.ci AND c.ord = o.ord
       WHERE o.hit <> k.si AND NOT EXISTS (SELECT 1 FROM held h WHERE h.pair_id = c.pair_id AND h.key = coalesce('=' || c.form, c.value::VARCHAR)) GROUP BY ALL)
    SELECT k.pair_id, k.ci, array_to_string(list_concat([k.si], coalesce(e, [])), ',') AS srcs FROM claims k LEFT JOIN extra USING (pair_id, ci)""")
def complementary_anchors(spark, sf_dir):
    """The only sentences of anchors whose value no source has, for claims that have the first sentence as source."""
    n = _numbers(spark, sf_dir)
    first = n.filter("side = 'source'").groupBy("pair_id").agg(F.min("idx").alias("si"))
    claims = n.filter("side = 'claim'").select("pair_id", F.col("idx").alias("ci")).distinct().join(first, "pair_id")
    claims = claims.select("pair_id", "ci", F.array("si").alias("srcs"), F.lit("direkt").alias("relation"))
    return anchors.complement(claims, n, anchors.anchor_hits(n)).select("pair_id", "ci", F.array_join("srcs", ",").alias("srcs"))


@query("""WITH p AS (SELECT l_orderkey AS pair_id, l_linenumber AS ci, l_discount * 10 AS e, l_tax * 12 AS c, 0.3::DOUBLE AS n, l_quantity / 50 AS top, l_extendedprice / 100000 AS lex,
      CASE WHEN l_returnflag = 'A' THEN 'keine_quelle' ELSE 'direkt' END AS relation, l_linestatus = 'O' AS negation_differs, l_linenumber % 2 = 0 AS protected, l_quantity % 5 = 0 AS numbers FROM lineitem),
    d AS (SELECT *, relation = 'direkt' AS asks, c >= 0.55 AND c - e >= 0.25 AS contra FROM p),
    k AS (SELECT *, asks AND NOT contra AND e < 0.60 AND n >= e AND n >= c AND NOT numbers AND NOT protected AS shifted FROM d)
    SELECT pair_id, ci, CASE WHEN shifted THEN 'bedeutung_verschoben' ELSE relation END AS relation,
    concat_ws(',', CASE WHEN numbers THEN 'zahlkonflikt' END, CASE WHEN asks AND contra AND (negation_differs OR top < 0.75) THEN 'nli_widerspruch' END,
      CASE WHEN asks AND contra AND NOT (negation_differs OR top < 0.75) THEN 'signale_uneinig' END, CASE WHEN shifted THEN 'bedeutung_verschoben' END, CASE WHEN asks AND c >= 0.90 AND lex >= 0.92 THEN 'widerspruch_wortgleich' END) AS flags FROM k""")
def nli_decision(spark, sf_dir):
    """F8: relation and flags after inference; the probabilities are columns of lineitem."""
    none = F.array().cast("array<string>")
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("ci"), (F.col("l_discount") * 10).alias("e"), (F.col("l_tax") * 12).alias("c"), F.lit(0.3).alias("n"),
        (F.col("l_quantity") / 50).alias("top"), (F.col("l_extendedprice") / 100000).alias("lex"), F.when(F.col("l_returnflag") == "A", "keine_quelle").otherwise("direkt").alias("relation"),
        (F.col("l_linestatus") == "O").alias("negation_differs"), (F.col("l_linenumber") % 2 == 0).alias("protected"), F.when(F.col("l_quantity") % 5 == 0, F.array(F.lit("zahlkonflikt"))).otherwise(none).alias("flags"),
    )
    return inference.after_nli(p).select("pair_id", "ci", "relation", F.array_join("flags", ",").alias("flags"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, [l_discount * 8, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 14 END] AS v FROM lineitem),
    k AS (SELECT *, list_transform(list_filter(v, lambda x: x IS NOT NULL), lambda x: greatest(0, least(1, x)) ** 3) AS k FROM v)
    SELECT l_orderkey, l_linenumber, round((list_sum(k) / len(k)) ** (1 / 3.0), 5) AS mean FROM k""")
def power_means(spark, sf_dir):
    """The cubic mean of two clamped signals, one of which may be missing."""
    li = table(spark, sf_dir, "lineitem")
    mean = scoring.power_mean([F.col("l_discount") * 8, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 14)], 3)
    return li.select("l_orderkey", "l_linenumber", F.round(mean, 5).alias("mean"))


_JUDGED = """WITH c AS (SELECT l_orderkey AS pair_id, l_linenumber % 3 AS satz, [l_suppkey % 5, l_partkey % 5] AS sources, [l_returnflag] AS flags, ['direkt', 'aggregiert', 'keine_quelle'][(l_quantity % 3)::INT + 1] AS relation FROM lineitem),
    s AS (SELECT pair_id, satz, list_sort(list_distinct(flatten(list(sources)))) AS sources, list_sort(list_distinct(flatten(list(flags)))) AS flags,
          arg_max(relation, list_position(['direkt', 'aggregiert', 'inferiert', 'bedeutung_verschoben', 'keine_quelle'], relation)) AS relation FROM c GROUP BY ALL)"""


def _judged(spark, sf_dir) -> DataFrame:
    relation = F.element_at(F.array(*map(F.lit, ("direkt", "aggregiert", "keine_quelle"))), (F.col("l_quantity") % 3).cast("int") + 1)
    li = table(spark, sf_dir, "lineitem")
    return evaluate.per_sentence(li.select(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") % 3).alias("satz"), F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5).alias("sources"), F.array("l_returnflag").alias("flags"), relation.alias("relation")))


@query(_JUDGED + " SELECT pair_id, satz, array_to_string(sources, ',') AS sources, array_to_string(flags, ',') AS flags, relation FROM s")
def sentence_claims(spark, sf_dir):
    """A1: the claims of a sentence as one row; the gravest relation wins."""
    return _judged(spark, sf_dir).select("pair_id", "satz", F.array_join("sources", ",").alias("sources"), F.array_join("flags", ",").alias("flags"), "relation")


@query(_JUDGED + """, k AS (SELECT len(list_intersect(sources, [o_custkey % 5, (o_custkey + 1) % 5])) AS hit, len(sources) AS given, len(list_intersect(sources, [o_custkey % 5])) AS found, 1 AS gold FROM s JOIN orders ON o_orderkey = pair_id),
    t AS (SELECT sum(hit) / sum(given) AS cip, sum(found) / sum(gold) AS cir, avg(CASE WHEN given > 0 THEN hit / given ELSE 0 END) AS macro_cip, avg(found / gold) AS macro_cir FROM k)
    SELECT round(cip, 6) AS cip, round(cir, 6) AS cir, round(2 * cip * cir / (cip + cir), 6) AS f1, round(macro_cip, 6) AS macro_cip, round(macro_cir, 6) AS macro_cir FROM t""")
def source_quality(spark, sf_dir):
    """A2, A3: micro and macro precision and recall of sources against needed and allowed ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.array(F.col("o_custkey") % 5).alias("needed"), F.array((F.col("o_custkey") + 1) % 5).alias("allowed"))
    scores = evaluate.source_scores(_judged(spark, sf_dir).join(o, "pair_id"))
    return scores.select(*(F.round(c, 6).alias(c) for c in ("cip", "cir", "f1", "macro_cip", "macro_cir")))


@query("""WITH d AS (SELECT doc_id, substr(sha256(text), 1, 16) AS hash, CASE WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 1000 / 1000 < 0.25 THEN 'test' ELSE 'dev' END AS split FROM documents WHERE text IS NOT NULL),
    g AS (SELECT hash, min(doc_id) FILTER (split = 'dev') AS gold FROM d WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY hash)
    SELECT d.doc_id, d.hash, g.gold, CASE WHEN g.hash IS NULL THEN 'unmatched' WHEN g.gold IS NULL THEN 'other_split' ELSE 'matched' END AS status FROM d LEFT JOIN g ON g.hash = d.hash""")
def labelled_runs(spark, sf_dir):
    """All documents against the labelled ones by the hash of their texts; held-back labels and unmatched runs are named."""
    d = evaluate.hash_split(table(spark, sf_dir, "documents").filter("text is not null"), "text", 0.25).select("doc_id", "hash", "split")
    gold = d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("hash", F.col("doc_id").alias("gold"), "split")
    return evaluate.matched_runs(d.select("doc_id", "hash"), gold, "dev")


@query("""WITH old AS (SELECT doc_id, min(quality) AS quality, bool_or(toxic = 0) AS reviewed, min(CASE WHEN quality = 1 THEN 'a' ELSE 'b' END) AS hash FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, (n_chars >= 1000)::INT AS quality, CASE WHEN lang = 'de' THEN 'b' ELSE 'a' END AS hash FROM documents)
    SELECT d.doc_id, CASE WHEN o.hash <> d.hash THEN o.hash ELSE d.hash END AS hash, coalesce(o.reviewed, false) AS reviewed, CASE WHEN o.reviewed OR o.hash <> d.hash THEN o.quality ELSE d.quality END AS quality, coalesce(o.hash <> d.hash, false) AS changed FROM d LEFT JOIN old o USING (doc_id)""")
def merged_labels(spark, sf_dir):
    """Drafted labels, where reviewed ones stay, and all of a text whose hash has changed."""
    mark = F.when(F.col("quality") == 1, "a").otherwise("b")
    old = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.col("toxic") == 0).alias("reviewed"), F.min(mark).alias("hash"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "de", "b").otherwise("a").alias("hash"), F.lit(False).alias("reviewed"), (F.col("n_chars") >= 1000).cast("int").alias("quality"))
    return evaluate.merged(d, old, ["doc_id"], ["quality"])


# ASCII words, as the SQL's distance counts bytes
_WORDS = r"[A-Z][a-z]{4,}"


@query(rf"""WITH w AS (SELECT DISTINCT conv_id AS pair_id, role, unnest(regexp_extract_all(text, '{_WORDS}')) AS w FROM conversations WHERE role IN ('user', 'assistant')),
    m AS (SELECT DISTINCT pair_id, lower(w) AS low FROM w WHERE role = 'assistant'), s AS (SELECT pair_id, lower(w) AS other, w AS spelling FROM w WHERE role = 'user'),
    k AS (SELECT m.pair_id, m.low, spelling, levenshtein(low, other) AS d FROM m JOIN s USING (pair_id) WHERE abs(length(low) - length(other)) <= 2)
    SELECT pair_id, low, spelling AS nearest FROM k WHERE d BETWEEN 1 AND 2 QUALIFY row_number() OVER (PARTITION BY pair_id, low ORDER BY d, length(spelling), spelling) = 1""")
def nearest_spelling(spark, sf_dir):
    """The nearest other spelling within two edits of the words that claims have, by a join of shortened forms."""
    c = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")
    w = c.select(F.col("conv_id").alias("pair_id"), "role", F.explode(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))).alias("w")).distinct()
    asked = w.filter("role = 'assistant'").select("pair_id", F.lower("w").alias("low")).distinct()
    return verify.nearest_spellings(asked, w.filter("role = 'user'").select("pair_id", F.lower("w").alias("other"), F.col("w").alias("spelling")))


_PLAIN = "regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')"
_CODE = "[A-Z]{2,}|[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+"


@query(rf"""WITH d AS (SELECT doc_id, source, {_PLAIN} AS text FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT item_id, {_PLAIN} AS text FROM benchmark WHERE text IS NOT NULL),
    known AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(lower(text), '[a-z0-9_]+'), regexp_extract_all(lower(regexp_replace(text, '[-/]', ' ', 'g')), '[a-z0-9_]+'))) AS low FROM k),
    p AS (SELECT unnest(regexp_split_to_array(text, '[-/\s]')) AS p FROM k), b AS (SELECT DISTINCT unnest(regexp_extract_all(p, '{_CODE}')) AS code FROM p),
    q AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[-/\s]')) AS p FROM d), c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(p, '{_CODE}')) AS code FROM q),
    m AS (SELECT doc_id AS ci, min(code) AS code, lower(code) AS low FROM c GROUP BY doc_id, lower(code) HAVING lower(code) NOT IN (SELECT low FROM known) AND lower(code) NOT IN (SELECT lower(code) FROM b)),
    n AS (SELECT low, b.code AS nearest, row_number() OVER (PARTITION BY low ORDER BY levenshtein(low, lower(b.code)), length(b.code), b.code) AS r FROM (SELECT DISTINCT low FROM m) JOIN b ON levenshtein(low, lower(b.code)) BETWEEN 1 AND 2)
    SELECT ci, code, CASE WHEN nearest IS NULL THEN 'unbelegt' ELSE 'konflikt' END AS status, nearest FROM m LEFT JOIN n ON n.low = m.low AND r = 1""")
def code_findings(spark, sf_dir):
    """F3 (codes), E9, J9: codes of documents that no benchmark text has, with the nearest one; other than ASCII is blank, as the SQL counts bytes."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text")
    one = F.lit(0).alias("pair_id")
    d = table(spark, sf_dir, "documents").filter("text is not null").select(one, F.col("doc_id").alias("ci"), plain)
    k = table(spark, sf_dir, "benchmark").filter("text is not null").select(one, plain)
    return verify.checked_codes(d, k, chains=False, few=True).select("ci", "code", "status", "nearest")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_discount, l_tax, l_quantity FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, round_even(l_discount * 100, 0)::INT || ' %' AS discount, replace(printf('%.2f', l_tax), '.', ',') AS tax FROM t""")
def percent_texts(spark, sf_dir):
    """Shares as whole per cent, and a decimal comma."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", scoring.percent(F.col("l_discount")).alias("discount"), scoring.comma(F.col("l_tax")).alias("tax"))


_STEMS = "list_transform(list_filter([{1}], lambda e: ends_with({0}, e) AND length({0}) - length(e) >= 4), lambda e: {0}[1:length({0}) - length(e)])".format
_END, _DERIVED = (", ".join(f"'{e}'" for e in sorted(x)) for x in (ENDINGS, ENDINGS | DERIVATIONS))


@query(rf"""WITH w AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÄÖÜäöü]{{4,}}')) AS w FROM benchmark)),
    p AS (SELECT a.w AS a, b.w AS b, translate(a.w, 'äöü', 'aou') AS fa, translate(b.w, 'äöü', 'aou') AS fb FROM w a JOIN w b ON a.w[1:3] = b.w[1:3] AND a.w < b.w),
    r AS (SELECT *, starts_with(a, b) OR starts_with(b, a) OR len(list_intersect({_STEMS("a", _END)}, {_STEMS("b", _END)})) > 0 AS plain,
      fa <> fb AND (fa <> a OR fb <> b) AND (starts_with(fa, fb) OR starts_with(fb, fa) OR len(list_intersect({_STEMS("fa", _DERIVED)}, {_STEMS("fb", _DERIVED)})) > 0) AS folded FROM p)
    SELECT a, b, CASE WHEN plain OR folded THEN true WHEN a[1:4] = b[1:4] THEN false END AS same FROM r""")
def word_forms(spark, sf_dir):
    """Whether the benchmark's words of one beginning are forms of one word."""
    found = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÄÖÜäöü]{4,}"), F.lit(0)))
    w = table(spark, sf_dir, "benchmark").select(found.alias("w")).select(F.lower("w").alias("w")).distinct()
    a, b = (w.select(F.substring("w", 1, 3).alias("head"), F.col("w").alias(x)) for x in "ab")
    return a.join(b, "head").filter("a < b").select("a", "b", words.same_word(F.col("a"), F.col("b")).alias("same"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN n = 0 THEN 'keine_quelle' WHEN n = 1 THEN 'direkt' ELSE 'aggregiert' END AS relation
    FROM orders JOIN (SELECT o_orderkey, count(l_orderkey) FILTER (l_returnflag = 'R') AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) USING (o_orderkey)""")
def derived_relations(spark, sf_dir):
    """The relation that an entry's sources imply until it is reviewed; returned lines are the sources."""
    needed = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("needed"))
    o = table(spark, sf_dir, "orders").join(needed, "o_orderkey", "left").withColumn("needed", F.coalesce("needed", F.array().cast("array<int>")))
    return o.select("o_orderkey", evaluate.derived_relation(F.col("needed"), F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("relation"))


_DRAFT = """WITH k AS (SELECT l_orderkey AS pair_id, l_linenumber % 3 AS satz, l_suppkey AS ci, l_partkey % 9 AS si, CASE WHEN l_linestatus = 'F' THEN 'redundant' ELSE 'primaer' END AS role,
      ['direkt', 'aggregiert', 'keine_quelle'][(l_quantity % 3)::INT + 1] AS relation, CASE WHEN l_returnflag = 'A' THEN 'signale_uneinig' ELSE l_returnflag END AS flag FROM lineitem),
    e AS (SELECT o_orderkey AS pair_id, unnest([0, 1, 2]) AS satz FROM orders),
    d AS (SELECT pair_id, satz, list_sort(list_distinct(coalesce(list(si) FILTER (role = 'primaer'), []))) AS needed, list_sort(list_distinct(coalesce(list(si) FILTER (role = 'redundant'), []))) AS allowed,
      arg_max(relation, list_position(['direkt', 'aggregiert', 'inferiert', 'bedeutung_verschoben', 'keine_quelle'], relation)) AS relation, list_sort(list_distinct(coalesce(list(flag) FILTER (flag <> 'signale_uneinig'), []))) AS flags,
      list_sort(list(ci)) AS claims, count(DISTINCT relation) > 1 AS mixed FROM k GROUP BY ALL)"""


@query(_DRAFT + """ SELECT e.pair_id, e.satz, array_to_string(coalesce(needed, []), ',') AS needed, array_to_string(coalesce(list_filter(allowed, lambda x: NOT list_contains(needed, x)), []), ',') AS allowed,
    coalesce(relation, 'keine_quelle') AS relation, array_to_string(coalesce(flags, []), ',') AS flags, array_to_string(coalesce(claims, []), ',') AS claims, coalesce(mixed, false) AS mixed FROM e LEFT JOIN d USING (pair_id, satz)""")
def label_drafts(spark, sf_dir):
    """One label draft per sentence from the claims in it."""
    relation = F.element_at(F.array(*map(F.lit, ("direkt", "aggregiert", "keine_quelle"))), (F.col("l_quantity") % 3).cast("int") + 1)
    source = F.struct((F.col("l_partkey") % 9).alias("si"), F.when(F.col("l_linestatus") == "F", "redundant").otherwise("primaer").alias("role"))
    flag = F.when(F.col("l_returnflag") == "A", "signale_uneinig").otherwise(F.col("l_returnflag"))
    k = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") % 3).alias("satz"), F.col("l_suppkey").alias("ci"), relation.alias("relation"), F.array(source).alias("sources"), F.array(flag).alias("flags"))
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("satz"))
    out = evaluate.drafted(k, e)
    return out.select("pair_id", "satz", *(F.array_join(c, ",").alias(c) for c in ("needed", "allowed", "flags", "claims")), "relation", "mixed")


# claims with added sources, and labels, made of lines and orders
_ADDED = """WITH c AS (SELECT l_orderkey AS pair_id, l_linenumber AS ci, l_suppkey AS sk, l_suppkey % 20 AS first, (l_suppkey + l_linenumber) % 20 AS red, l_partkey % 20 AS g1, (l_partkey + 3) % 20 AS g2, l_discount AS w1, l_tax AS w2, 0.9 - l_discount AS cov,
      [o_custkey % 20, (o_custkey + 1) % 20, (o_custkey + 7) % 20] AS needed, [(o_custkey + 2) % 20, (o_custkey + 3) % 20] AS allowed FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    a AS (SELECT pair_id, ci, sk, g1 AS si, w1 AS gain, 1 AS step, least(abs(first - g1), abs(red - g1)) AS distance, greatest(0, 1 - cov + (w1 + w2)) AS "left", needed, allowed FROM c
      UNION ALL SELECT pair_id, ci, sk, g2, w2, 2, least(abs(first - g2), abs(red - g2), abs(g1 - g2)), greatest(0, 1 - cov + w2), needed, allowed FROM c),
    j AS (SELECT *, CASE WHEN "left" > 0.01 THEN gain / "left" END AS relative, CASE WHEN list_contains(needed, si) THEN 'notwendig' WHEN list_contains(allowed, si) THEN 'zulaessig' ELSE 'falsch' END AS verdict FROM a)"""


def _added(spark, sf_dir) -> DataFrame:
    # plain columns are joined, as arrays would be dealt out with them
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_tax").join(spread(o), "l_orderkey")
    label = lambda *steps: F.array(*((F.col("o_custkey") + k) % 20 for k in steps))
    gain = lambda k, w: F.struct(((F.col("l_partkey") + k) % 20).alias("si"), F.col(w).alias("gain"))
    return li.select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("ci"), F.array(F.col("l_suppkey") % 20).alias("srcs"), F.array((F.col("l_suppkey") + F.col("l_linenumber")) % 20).alias("redundant"),
        F.array(gain(0, "l_discount"), gain(3, "l_tax")).alias("gains"), (0.9 - F.col("l_discount")).alias("cov_total"), F.array((F.col("l_suppkey") + 5) % 20).alias("extra"),
        label(0, 1, 7).alias("needed"), label(2, 3).alias("allowed"),
    )


_BANDS = """SELECT '{0}' AS kind, {1} AS band, count(*) AS n, count(*) FILTER (verdict = 'notwendig') AS notwendig, count(*) FILTER (verdict = 'zulaessig') AS zulaessig, count(*) FILTER (verdict = 'falsch') AS falsch FROM j GROUP BY ALL"""
_CASE = lambda v, e: "CASE " + " ".join(f"WHEN {v} >= {a} AND {v} < {b} THEN '{a}'" for a, b in zip(e, e[1:], strict=False)) + " END"


@query(_ADDED + ", b AS (" + " UNION ALL ".join(_BANDS.format(k, v) for k, v in (("gain", _CASE("gain", diagnose.GAINS)), ("relative", _CASE("relative", diagnose.RELATIVE)), ("reach", "CASE WHEN distance <= 2 THEN 'nah' WHEN distance < 8 THEN 'mittel' ELSE 'fern' END"), ("step", "step::VARCHAR"))) + ") SELECT *, round((n - falsch) / n, 6) AS rate FROM b")
def added_source_bands(spark, sf_dir):
    """A10: hit rates of the sources that the cover adds, by gain, relative gain, reach and step."""
    rows = diagnose.added_sources(_added(spark, sf_dir))
    by = {"gain": diagnose.band(F.col("gain"), diagnose.GAINS), "relative": diagnose.band(F.col("relative"), diagnose.RELATIVE), "reach": diagnose.reach(F.col("distance")), "step": F.col("step")}
    out = diagnose.all_hit_rates(rows, by)
    return out.select("kind", "band", "n", "notwendig", "zulaessig", "falsch", F.round("rate", 6).alias("rate"))


@query(_ADDED + """, k AS (SELECT 'primaer' AS kind, first AS si, needed, allowed FROM c UNION ALL SELECT 'redundant', red, needed, allowed FROM c UNION ALL SELECT 'anker', (sk + 5) % 20, needed, allowed FROM c WHERE (sk + 5) % 20 NOT IN (g1, g2))
    SELECT kind, count(*) AS n, count(*) FILTER (NOT list_contains(needed, si) AND NOT list_contains(allowed, si)) AS falsch FROM k GROUP BY kind""")
def plain_source_rates(spark, sf_dir):
    """A10: first, redundant and anchors' sources, to compare with the added ones."""
    return diagnose.plain_sources(_added(spark, sf_dir))


@query(_JUDGED + """, n AS (SELECT l_orderkey AS pair_id, l_linenumber % 3 AS satz, count(*) AS n_claims FROM lineitem GROUP BY ALL),
    r AS (SELECT n_claims > 1 AS split, sources, [o_custkey % 5, (o_custkey + 2) % 5] AS needed, [(o_custkey + 1) % 5] AS allowed FROM s JOIN n USING (pair_id, satz) JOIN orders ON o_orderkey = pair_id),
    t AS (SELECT split, count(*) AS n, count(*) FILTER (len(needed) > 0 AND len(sources) = 0) AS none, sum(len(needed))::BIGINT AS needed, sum(len(list_filter(needed, lambda x: NOT list_contains(sources, x))))::BIGINT AS fn,
      sum(len(list_filter(sources, lambda x: NOT list_contains(needed, x) AND NOT list_contains(allowed, x))))::BIGINT AS fp, sum(len(sources))::BIGINT AS given FROM r GROUP BY split)
    SELECT *, round((needed - fn) / needed, 6) AS cir, round((given - fp) / given, 6) AS cip, round(n / sum(n) OVER (), 6) AS n_share, coalesce(round(none / nullif(sum(none) OVER (), 0), 6), 0) AS none_share, round(fn / sum(fn) OVER (), 6) AS fn_share FROM t""")
def split_sentence_errors(spark, sf_dir):
    """Errors of sentences with several claims and of whole ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.array(F.col("o_custkey") % 5, (F.col("o_custkey") + 2) % 5).alias("needed"), F.array((F.col("o_custkey") + 1) % 5).alias("allowed"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") % 3).alias("satz")).agg(F.count("*").alias("n_claims"))
    out = diagnose.split_or_whole(_judged(spark, sf_dir).join(n, ["pair_id", "satz"]).join(o, "pair_id"))
    return out.select("split", "n", "none", "needed", "fn", "fp", "given", *(F.round(c, 6).alias(c) for c in ("cir", "cip", "n_share", "none_share", "fn_share")))


_CASES = """WITH k AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'inferiert' ELSE 'direkt' END AS relation, l_discount * 10 AS "V", l_tax * 12 AS "R_satz", l_quantity / 50 AS "R_span", l_extendedprice / 100000 AS cov, 1 - l_tax * 10 AS entail FROM lineitem),
    f AS (SELECT * FROM k WHERE cov <= 0.80 AND entail >= 0.50)"""


def _cases(spark, sf_dir) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "inferiert").otherwise("direkt").alias("relation"), (F.col("l_discount") * 10).alias("V"), (F.col("l_tax") * 12).alias("R_satz"), (F.col("l_quantity") / 50).alias("R_span"),
        (F.col("l_extendedprice") / 100000).alias("cov"), (1 - F.col("l_tax") * 10).alias("entail"),
    )
    return diagnose.prefiltered(k)


@query(_CASES + """, e AS (SELECT relation, 'V' AS value, "V" AS x FROM f UNION ALL SELECT relation, 'R_satz', "R_satz" FROM f UNION ALL SELECT relation, 'R_span', "R_span" FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY relation, value ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY relation, value) AS m FROM e)
    SELECT relation, value, count(*) AS n, round(min(x), 6) AS least, round(max(x) FILTER (k = floor(m / 2)), 6) AS median, round(max(x), 6) AS most, count(*) FILTER (x <= 0.05 OR x >= 0.95) AS saturated FROM r GROUP BY ALL""")
def direction_spreads(spark, sf_dir):
    """Spreads of the directions of inference among prefiltered cases; the probabilities are columns of lineitem."""
    out = diagnose.spreads(_cases(spark, sf_dir), ["V", "R_satz", "R_span"], "relation")
    return out.select("relation", "value", "n", *(F.round(c, 6).alias(c) for c in ("least", "median", "most")), "saturated")


@query(_CASES + """ SELECT count(*) FILTER ("V" >= 0.70 AND relation = 'direkt') AS n_direkt, count(*) FILTER ("V" >= 0.70 AND relation = 'inferiert') AS n_inferiert, count(*) FILTER (NOT "V" >= 0.70) AS n_dropped,
    round(min("V" - "R_span") FILTER ("V" >= 0.70 AND relation = 'inferiert') - max("V" - "R_span") FILTER ("V" >= 0.70 AND relation = 'direkt'), 6) AS gap FROM f""")
def direction_gap(spark, sf_dir):
    """Whether the backward direction parts the two relations."""
    return diagnose.gap(_cases(spark, sf_dir)).select("n_direkt", "n_inferiert", "n_dropped", F.round("gap", 6).alias("gap"))


_SWEPT = ("basis", "R_fern018", "T_none_040", "P_pos_null")


def _variant_sql(name: str) -> str:
    """The native plan's SQL under a variant's constants."""
    cfg = VARIANTS[name].cfg
    sql = _DECIDED.replace("ELSE 0.22 END", f"ELSE {cfg.residual_min_far} END").replace("0.44", str(cfg.t_none))
    weights = f"({cfg.w_cov} * cov + {cfg.w_lex} * lex + {cfg.w_pos} * (1 - abs(si / n - ci / m))) / ({cfg.w_cov} + {cfg.w_lex} + {cfg.w_pos})"
    return sql.replace("(0.28 * cov + 0.20 * lex + 0.12 * (1 - abs(si / n - ci / m))) / 0.60", weights)


@query(" UNION ALL ".join(f"SELECT * FROM ({_variant_sql(v)} SELECT '{v}' AS variant, relation, count(*) AS n, sum(len(sources))::BIGINT AS n_sources, round(avg(margin), 4) AS margin FROM done GROUP BY ALL)" for v in _SWEPT))
def variant_sweep(spark, sf_dir):
    """Four named variants of the native plan as one plan; what is shared is computed once."""
    sents = kept(grams.sentences(plan.turns(table(spark, sf_dir, "conversations"))))
    out = variants.sweep(sents, list(_SWEPT))
    return out.groupBy("variant", "relation").agg(F.count("*").alias("n"), F.sum(F.size("sources")).alias("n_sources"), F.round(F.avg("margin"), 4).alias("margin"))


@query(_FUSED + """, t AS (SELECT pair_id, count(*) FILTER (side = 'source') AS saetze, count(*) FILTER (side = 'claim') AS claims FROM sents GROUP BY ALL),
    k AS (SELECT pair_id, count(*) FILTER (relation <> 'keine_quelle') AS belegt FROM c0 GROUP BY ALL) SELECT t.pair_id, saetze, claims, coalesce(belegt, 0) AS belegt FROM t LEFT JOIN k USING (pair_id)""")
def run_statistics(spark, sf_dir):
    """Sentences, claims and sourced claims of every pair."""
    sents, _, scores = plan.scored(plan.turns(table(spark, sf_dir, "conversations")))
    n = sents.groupBy("pair_id").agg(*(F.count(F.when(F.col("side") == s, 1)).alias(c) for s, c in (("source", "saetze"), ("claim", "claims"))))
    k = scoring.primary(scoring.fused(scores, sents)).groupBy("pair_id").agg(F.count(F.when(F.col("relation") != "keine_quelle", 1)).alias("belegt"))
    return n.join(k, "pair_id", "left").withColumn("belegt", F.coalesce("belegt", F.lit(0)))


# -- scanners: sequential, tested against documented examples ------------------------------


@query()
def page_text(spark, sf_dir):
    """T1, T2, T3, T4, T5 over raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(udfs.page_segment("html")).alias("s")).select("page_id", "s.*")


@query()
def document_entities(spark, sf_dir):
    """E1-E6 over all documents."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.explode(udfs.entities("text")).alias("e")).select("doc_id", "e.*")


@query()
def document_claims(spark, sf_dir):
    """T6, T7 over the sentences of all documents."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.explode(udfs.claims("text")).alias("c")).select("doc_id", "c.*")


@query()
def document_sentences(spark, sf_dir):
    """T2-T5, T10, V10, V11 over all documents: the scanner's sentences with standard numbers and speakers' context."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.explode(udfs.segment("text")).alias("s")).select("doc_id", "s.*")


@query()
def document_speakers(spark, sf_dir):
    """Sentences of documents that name a speaker."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.explode(udfs.speakers("text")).alias("s")).select("doc_id", "s.*")


@query()
def traced_conversations(spark, sf_dir):
    """The whole method: conversations as pairs of raw texts to run documents (claims of every pair, without models)."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n\n")
    pairs = c.groupBy(F.col("conv_id").cast("string").alias("pair_id")).agg(said("user").alias("article"), said("assistant").alias("transcript"))
    docs = plan.trace(pairs)
    return docs.select("pair_id", F.size("article.sentences").alias("saetze"), F.explode("transcript.claims").alias("c")).select("pair_id", "saetze", "c.id", "c.relation", "c.confidence", "c.margin", "c.note", F.size("c.sources").alias("n_sources"), F.size("c.entities").alias("n_entities"))


@query()
def document_persons(spark, sf_dir):
    """E7, E8 (pattern form)."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.explode(udfs.persons("text")).alias("p")).select("doc_id", "p.*")


assert CFG.t_none == 0.44 and CFG.t_direct == 0.60  # the SQL above states these figures
