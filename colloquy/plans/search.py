"""Retrieval queries. Documents stand for exchanges with a vector (embeddings.vec_id is doc_id); distilled objects are made from exchanges by the extractive distiller."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.core import table
from colloquy.functions import models
from colloquy.functions import text as T
from colloquy.functions import vectors as V
from colloquy.operators import listing as LI
from colloquy.operators import queries_text as Q
from colloquy.operators import search as S
from colloquy.plans.base import CONV, DOC_Q, EXCH, conversations, doc_query, exchanges, query

R9 = lambda c: F.round(c, 6)
TERMS = ["snapshot", "cursor", "stable"]
TEXT = "snapshot cursor stable"
K = 20


def _bm25_sql(name: str, source: str, terms: list[str] = TERMS, k1: float = 1.2, b: float = 0.75, toks: str = "string_split_regex(lower(txt), '[^a-z0-9]+')", okapi: bool = False, extra: str = "") -> str:
    """CTEs that end in `name` (id, the columns of source, score); source must give id and txt."""
    n = range(len(terms))
    tf = ", ".join(f"len(list_filter(tok, lambda w: w = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    raw = [f"ln((n - df{i} + 0.5) / (df{i} + 0.5))" if okapi else f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5))" for i in n]
    mean = "(" + " + ".join(raw) + f") / {len(terms)}"
    idf = ", ".join(f"{f'CASE WHEN {raw[i]} < 0 THEN 0.25 * abs({mean}) ELSE {raw[i]} END' if okapi else raw[i]} AS idf{i}" for i in n)
    score = " + ".join(f"idf{i} * (tf{i} * {k1 + 1}) / (tf{i} + {k1} * (1 - {b} + {b} * dl / avgdl))" for i in n)
    return f"""{name}_t AS (SELECT *, list_filter({toks}, lambda w: w <> '') AS tok FROM ({source})),
 {name}_c AS (SELECT * EXCLUDE (tok), len(tok)::DOUBLE AS dl, {tf} FROM {name}_t),
 {name}_n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}' for i in n)} FROM {name}_c),
 {name}_i AS (SELECT avgdl, {idf} FROM {name}_n),
 {name} AS (SELECT * EXCLUDE (txt), {score} AS score FROM {name}_c, {name}_i WHERE {' OR '.join(f'tf{i} > 0' for i in n)})"""


_X = "SELECT exchange_id AS id, conversation_id, project_id, exchange_text AS txt FROM exch WHERE exchange_text IS NOT NULL"
_D = "SELECT doc_id AS id, coalesce(project_id, 'none') AS project_id, title, collected_at, n_chars, text AS txt FROM documents WHERE text IS NOT NULL"


def _docs(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select(F.col("doc_id").alias("id"), F.coalesce("project_id", F.lit("none")).alias("project_id"), "title", "collected_at", "n_chars", F.col("text").alias("txt"))


def _exch(spark, d):
    return exchanges(spark, d).where("exchange_text is not null").select(F.col("exchange_id").alias("id"), "conversation_id", "project_id", F.col("exchange_text").alias("txt"))


@query(f"WITH {EXCH}, {CONV}, {_bm25_sql('b', _X)} SELECT b.id, c.title, round(b.score, 6) AS score FROM b JOIN conv c USING (conversation_id) ORDER BY round(b.score, 9) DESC, b.id LIMIT {K}")
def bm25_exchanges(spark, d):
    hits = S.bm25(_exch(spark, d), "txt", TERMS)
    j = hits.join(conversations(spark, d).select("conversation_id", "title"), "conversation_id")
    return S.top(j.withColumn("order", F.round("score", 9)), K, "id", "order").select("id", "title", R9(F.col("score")).alias("score"))


@query(f"WITH {_bm25_sql('b', _D)} SELECT id, project_id, round(score, 6) AS score FROM b WHERE project_id IN (SELECT project_id FROM project_settings WHERE time_zone LIKE 'Europe/%') ORDER BY round(score, 9) DESC, id LIMIT {K}")
def bm25_project_filtered(spark, d):
    p = table(spark, d, "project_settings").where("time_zone like 'Europe/%'").select("project_id").distinct()
    hits = S.bm25(_docs(spark, d), "txt", TERMS).join(F.broadcast(p), "project_id", "left_semi")
    return S.top(hits.withColumn("order", F.round("score", 9)), K, "id", "order").select("id", "project_id", R9(F.col("score")).alias("score"))


BATCH = [(1, "snapshot cursor"), (2, "stable sort of the queue"), (3, "lazy vector index"), (4, "no such wordzzz")]


@query(f"""WITH q(query_id, query) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in BATCH)}), qt AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM q),
 x AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS tok FROM documents WHERE text IS NOT NULL), p AS (SELECT id, len(tok)::DOUBLE AS dl, unnest(tok) AS term FROM x),
 tf AS (SELECT id, term, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM p GROUP BY 1, 2), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n, avg(len(tok)) AS avgdl FROM x),
 s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5""")
def bm25_batch(spark, d):
    q = spark.createDataFrame(BATCH, "query_id int, query string")
    return S.bm25_batch(_docs(spark, d), "id", "txt", q, 5).select("query_id", "id", R9(F.col("score")).alias("score"), "rank")


_FIELDS = "SELECT doc_id AS id, concat_ws(' ', text, title, project_id) AS txt FROM documents WHERE text IS NOT NULL"
_FIELD_TOKS = "string_split_regex(regexp_replace(lower(txt), '[_\\-/\\\\.:]', ' ', 'g'), '\\s+')"


@query(f"WITH {_bm25_sql('b', _FIELDS, ['lock', 'vector', 'the'], 1.5, 0.75, _FIELD_TOKS, True)} SELECT id, round(score, 6) AS score FROM b WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT {K}")
def okapi_fields(spark, d):
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", "title", "project_id").alias("txt"))
    hits = S.bm25(t, "txt", ["lock", "vector", "the"], 1.5, 0.75, T.field_words, okapi=True).where("score > 0")
    return S.top(hits.withColumn("order", F.round("score", 9)), K, "id", "order").select("id", R9(F.col("score")).alias("score"))


@query(f"WITH {EXCH} SELECT exchange_id AS id, 1.0::DOUBLE AS score FROM exch WHERE contains(lower(exchange_text), 'the') AND contains(lower(exchange_text), 'queue') AND contains(lower(exchange_text), '100')")
def like_all_terms(spark, d):
    return S.like_all(_exch(spark, d), "txt", "the Queue 100").select("id", "score")


_DIST = "1 - list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[])))"


def _layer(spark, d):
    """Documents with their vector and distance to the query's."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return S.nearest(e, doc_query(spark, d))


@query(f"WITH {DOC_Q} SELECT d.doc_id AS id, d.title, p.time_zone, round({_DIST}, 6) AS distance, round(1 / (1 + {_DIST}), 6) AS score FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id JOIN project_settings p USING (project_id), q ORDER BY round({_DIST}, 9), id LIMIT {K}")
def vector_cosine(spark, d):
    p = table(spark, d, "project_settings").select("project_id", "time_zone")
    j = _layer(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "title", "project_id"), "id").join(F.broadcast(p), "project_id")
    return S.top(j.withColumn("order", F.round("distance", 9)), K, "id", "order", True).select("id", "title", "time_zone", R9(F.col("distance")).alias("distance"), R9(F.col("score")).alias("score"))


_L2 = "list_sum(list_transform(list_zip(embedding, qv), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


@query(f"WITH {DOC_Q} SELECT vec_id AS id, round({_L2}, 5) AS distance FROM embeddings, q ORDER BY round({_L2}, 9), id LIMIT {K}")
def vector_l2(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = S.nearest(e, doc_query(spark, d), squared=True)
    return S.top(hits.withColumn("order", F.round("distance", 9)), K, "id", "order", True).select("id", F.round("distance", 5).alias("distance"))


@query(f"WITH {DOC_Q} SELECT vec_id AS id, label, round({_DIST}, 6) AS distance FROM embeddings, q WHERE label IN (1, 3) ORDER BY round({_DIST}, 9), id LIMIT {K}")
def vector_label_filtered(spark, d):
    hits = _layer(spark, d).where(F.col("label").isin(1, 3))
    return S.top(hits.withColumn("order", F.round("distance", 9)), K, "id", "order", True).select("id", "label", R9(F.col("distance")).alias("distance"))


@query(f"WITH {DOC_Q}, h AS (SELECT vec_id AS id, round({_DIST}, 6) AS distance FROM embeddings, q WHERE embedding IS NOT NULL ORDER BY round({_DIST}, 9), vec_id LIMIT {K}) SELECT h.id, h.distance, d.lang, substr(d.text, 1, 40) AS text FROM h LEFT JOIN documents d ON d.doc_id = h.id")
def vector_left_join(spark, d):
    hits = _layer(spark, d).where("embedding is not null")
    hits = S.top(hits.withColumn("order", F.round("distance", 9)), K, "id", "order", True).select("id", R9(F.col("distance")).alias("distance"))
    return hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.substring("text", 1, 40).alias("text")), "id", "left")


# fusion: the keyword leg and the vector leg, each cut to 2K rows by rounded score and id

_LEGS = f"""{DOC_Q}, {_bm25_sql('b', _D)}, kw AS (SELECT id, round(score, 9) AS score FROM b ORDER BY round(score, 9) DESC, id LIMIT {2 * K}),
 sem AS (SELECT vec_id AS id, round(1 / (1 + {_DIST}), 9) AS score FROM embeddings, q ORDER BY round(1 / (1 + {_DIST}), 9) DESC, vec_id LIMIT {2 * K}),
 kd AS (SELECT greatest(CASE WHEN count(*) >= 10 THEN quantile_cont(score, 0.95) WHEN count(*) > 0 THEN max(score) ELSE 1.0 END, 1e-10) AS div FROM kw), sd AS (SELECT greatest(CASE WHEN count(*) >= 10 THEN quantile_cont(score, 0.95) WHEN count(*) > 0 THEN max(score) ELSE 1.0 END, 1e-10) AS div FROM sem),
 kn AS (SELECT id, score, least(score / div, 1.0) AS norm, row_number() OVER (ORDER BY score DESC, id) AS rank FROM kw, kd), sn AS (SELECT id, score, least(score / div, 1.0) AS norm, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sem, sd)"""


def _legs(spark, d):
    kw = S.bm25(_docs(spark, d), "txt", TERMS).select("id", F.round("score", 9).alias("score"))
    sem = _layer(spark, d).select("id", F.round("score", 9).alias("score"))
    return S.top(kw, 2 * K, "id"), S.top(sem, 2 * K, "id")


@query(f"WITH {_LEGS} SELECT id, rank::INT AS rank, round(norm, 6) AS norm, round(1 / (1 + 0.1 * rank), 6) AS decay FROM kn")
def normalised_and_decayed(spark, d):
    kw, _ = _legs(spark, d)
    return S.ranked(S.normalised(kw), "id").select("id", "rank", R9(F.col("norm")).alias("norm"), R9(S.rank_decay(F.col("rank"))).alias("decay"))


@query("SELECT * FROM (VALUES ('five', 5.0::DOUBLE), ('hundred', 95.05::DOUBLE), ('none', 1.0::DOUBLE), ('zero', 1e-10::DOUBLE)) AS v(name, div)")
def divisors(spark, d):
    rows = {"five": [1.0, 2.0, 5.0, 3.0, 4.0], "hundred": [float(i) for i in range(1, 101)], "none": [], "zero": [0.0] * 12}
    out = None
    for name, values in rows.items():
        x = S.divisor(spark.createDataFrame([(v,) for v in values], "score double")).select(F.lit(name).alias("name"), "div")
        out = x if out is None else out.unionAll(x)
    return out


def _fused_sql(wk: float, ws: float) -> str:
    return f"""fu AS (SELECT coalesce(kn.id, sn.id) AS id, ({wk} * coalesce(kn.norm / (1 + 0.1 * kn.rank), 0) + {ws} * coalesce(sn.norm / (1 + 0.1 * sn.rank), 0)) * CASE WHEN kn.id IS NOT NULL AND sn.id IS NOT NULL THEN 1.2 ELSE 1.0 END AS base FROM kn FULL OUTER JOIN sn ON kn.id = sn.id),
 sc AS (SELECT fu.id, coalesce(d.project_id, 'none') AS project_id, d.title, d.collected_at, base * CASE WHEN coalesce(contains(lower(title), 'snapshot') OR contains(lower(title), 'cursor') OR contains(lower(title), 'stable'), false) THEN 2.0 ELSE 1.0 END AS score FROM fu JOIN documents d ON d.doc_id = fu.id),
 bp AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY round(score, 9) DESC, id) = 1)"""


def _fused(spark, d, wk, ws, words=TEXT):
    kw, sem = _legs(spark, d)
    f = S.weighted(kw, sem, "id", wk, ws)
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("project_id", F.lit("none")).alias("project_id"), "title", "collected_at")
    f = S.title_boost(f.join(doc, "id"), "title", words).withColumn("score", F.round("score", 9))
    return S.best_per(f, "project_id", "id")


@query(f"WITH {_LEGS}, {_fused_sql(0.6, 0.4)} SELECT id, project_id, round(score, 6) AS score FROM bp ORDER BY round(score, 9) DESC, id LIMIT 10")
def hybrid_weighted(spark, d):
    return S.top(_fused(spark, d, 0.6, 0.4), 10, "id").select("id", "project_id", R9(F.col("score")).alias("score"))


ADAPTIVE = "why does stable_cursor/snapshot fail"


@query(f"WITH {_LEGS}, {_fused_sql(0.2, 0.8)} SELECT id, project_id, round(score, 6) AS score FROM bp ORDER BY round(score, 9) DESC, id LIMIT 10")
def adaptive_hybrid(spark, d):
    _, wk, ws, _ = Q.classify(ADAPTIVE)
    return S.top(_fused(spark, d, wk, ws), 10, "id").select("id", "project_id", R9(F.col("score")).alias("score"))


@query(f"WITH {_LEGS}, {_fused_sql(0.6, 0.4)}, t AS (SELECT * FROM bp ORDER BY round(score, 9) DESC, id LIMIT 10) SELECT id, collected_at FROM t ORDER BY collected_at DESC NULLS LAST, id")
def resorted_after_limit(spark, d):
    return S.top(_fused(spark, d, 0.6, 0.4), 10, "id").select("id", "collected_at").orderBy(F.col("collected_at").desc_nulls_last(), "id")


@query(f"WITH {_LEGS}, f AS (SELECT kw.id, d.project_id, kw.score FROM kw JOIN (SELECT doc_id, coalesce(project_id, 'none') AS project_id, n_chars, text FROM documents) d ON d.doc_id = kw.id WHERE contains(lower(d.text), 'snapshot') AND NOT contains(lower(d.text), 'yaml') AND coalesce(d.n_chars, 0) >= 100) SELECT id, project_id, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) = 1 ORDER BY score DESC, id LIMIT 10")
def keyword_mode(spark, d):
    kw, _ = _legs(spark, d)
    j = kw.join(_docs(spark, d).select("id", "project_id", "txt", "n_chars"), "id").where(T.all_phrases(F.col("txt"), ["snapshot"]) & T.none_of(F.col("txt"), ["yaml"]) & (F.coalesce("n_chars", F.lit(0)) >= 100))
    return S.top(S.best_per(j, "project_id", "id"), 10, "id").select("id", "project_id", R9(F.col("score")).alias("score"))


@query(f"WITH {_LEGS}, f AS (SELECT sem.id, coalesce(d.project_id, 'none') AS project_id, sem.score FROM sem JOIN documents d ON d.doc_id = sem.id WHERE collected_at IS NULL OR collected_at >= TIMESTAMP '2024-06-01') SELECT id, project_id, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) = 1 ORDER BY score DESC, id LIMIT 10")
def semantic_mode(spark, d):
    _, sem = _legs(spark, d)
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("project_id", F.lit("none")).alias("project_id"), F.col("collected_at").alias("updated_at"))
    j = LI.search_filters(sem.join(doc, "id"), since="2024-06-01")
    return S.top(S.best_per(j, "project_id", "id"), 10, "id").select("id", "project_id", R9(F.col("score")).alias("score"))


_MNZ = "mnz AS (SELECT coalesce(kn.id, sn.id) AS id, (coalesce(kn.norm, 0) + coalesce(sn.norm, 0)) * ((coalesce(kn.norm, 0) > 0)::INT + (coalesce(sn.norm, 0) > 0)::INT) AS score FROM kn FULL OUTER JOIN sn ON kn.id = sn.id)"


@query(f"WITH {_LEGS}, {_MNZ}, j AS (SELECT mnz.id, coalesce(d.project_id, 'none') AS project_id, coalesce(d.title, 'Untitled') AS title, round(score, 9) AS score FROM mnz JOIN documents d ON d.doc_id = mnz.id WHERE collected_at IS NULL OR collected_at <= TIMESTAMP '2025-11-01') SELECT id, project_id, title, round(score, 6) AS score FROM j QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) = 1 ORDER BY j.score DESC, id LIMIT {K}")
def cross_layer_combmnz(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("project_id", F.lit("none")).alias("project_id"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.col("collected_at").alias("updated_at"))
    j = LI.search_filters(S.combmnz(*_legs(spark, d), "id").withColumn("score", F.round("score", 9)).join(doc, "id"), until="2025-11-01")
    return S.top(S.best_per(j, "project_id", "id"), K, "id").select("id", "project_id", "title", R9(F.col("score")).alias("score"))


@query(f"WITH {_LEGS}, j AS (SELECT sem.id, coalesce(d.project_id, 'none') AS project_id, d.collected_at, sem.score FROM sem JOIN documents d ON d.doc_id = sem.id), b1 AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) = 1), t AS (SELECT * FROM b1 ORDER BY score DESC, id LIMIT 15) SELECT id, project_id, round(score, 6) AS score FROM t WHERE collected_at IS NULL OR collected_at >= TIMESTAMP '2025-01-01'")
def distill_mode(spark, d):
    """The date filter follows the limit, so fewer rows may come out."""
    _, sem = _legs(spark, d)
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("project_id", F.lit("none")).alias("project_id"), F.col("collected_at").alias("updated_at"))
    t = S.top(S.best_per(sem.join(doc, "id"), "project_id", "id"), 15, "id")
    return LI.search_filters(t, since="2025-01-01").select("id", "project_id", R9(F.col("score")).alias("score"))


_BEST = "pk AS (SELECT project_id, max(norm) AS score FROM kn JOIN (SELECT doc_id, coalesce(project_id, 'none') AS project_id FROM documents) d ON d.doc_id = kn.id GROUP BY 1), pv AS (SELECT project_id, max(norm) AS score FROM sn JOIN (SELECT doc_id, coalesce(project_id, 'none') AS project_id FROM documents) d ON d.doc_id = sn.id GROUP BY 1)"
_MERGE = "SELECT coalesce(pk.project_id, pv.project_id) AS project_id, round(CASE WHEN pk.score IS NOT NULL AND pv.score IS NOT NULL THEN least((0.5 * pk.score + 0.5 * {v}) * 1.2, 1.0) WHEN pk.score IS NOT NULL THEN 0.5 * pk.score ELSE 0.5 * {v} END, 6) AS score, CASE WHEN pk.score IS NOT NULL AND pv.score IS NOT NULL THEN 'both' WHEN pk.score IS NOT NULL THEN 'distilled' ELSE 'verbatim' END AS layers FROM pk FULL OUTER JOIN pv USING (project_id)"


def _two_layers(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("project_id", F.lit("none")).alias("project_id"))
    return [S.normalised(leg).join(doc, "id").groupBy("project_id").agg(F.max("norm").alias("score")) for leg in _legs(spark, d)]


@query(f"WITH {_LEGS}, {_BEST} {_MERGE.format(v='pv.score')}")
def two_layer_merge(spark, d):
    return S.merged_layers(*_two_layers(spark, d), "project_id").select("project_id", R9(F.col("score")).alias("score"), "layers")


SCOPE = ["atlas-notebook", "cinder-board", "delta-search"]
_IN = "(" + ", ".join(f"'{p}'" for p in SCOPE) + ")"
_SOFT = f"(pv.score * CASE WHEN pv.project_id IN {_IN} THEN 1.5 ELSE 1.0 END)"


@query(f"WITH {_LEGS}, {_BEST} {_MERGE.format(v=_SOFT)}")
def two_layer_merge_scoped(spark, d):
    return S.merged_layers(*_two_layers(spark, d), "project_id", boosted=SCOPE).select("project_id", R9(F.col("score")).alias("score"), "layers")


@query(f"WITH {_LEGS}, h AS (SELECT coalesce(d.project_id, 'none') AS project_id FROM sem JOIN documents d ON d.doc_id = sem.id) SELECT count(*) FILTER (project_id IN {_IN})::BIGINT AS boosted, count(*) FILTER (project_id NOT IN {_IN})::BIGINT AS not_boosted FROM h")
def scoping_counters(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("project_id", F.lit("none")).alias("project_id"))
    return _legs(spark, d)[1].join(doc, "id").agg(F.count(F.when(F.col("project_id").isin(SCOPE), 1)).alias("boosted"), F.count(F.when(~F.col("project_id").isin(SCOPE), 1)).alias("not_boosted"))


@query(f"WITH {_LEGS}, c AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (kn.id IS NOT NULL AND sn.id IS NOT NULL)::BIGINT AS shared, count(*) FILTER (kn.rank <= 5 AND sn.rank <= 5) AS t FROM kn FULL OUTER JOIN sn ON kn.id = sn.id) SELECT shared, total, shared / total AS jaccard, t / 5 AS top_overlap FROM c")
def resultset_agreement(spark, d):
    a, b = (S.ranked(x, "id") for x in _legs(spark, d))
    return S.agreement(a, b, "id")


_REL = f"""e AS (SELECT DISTINCT facet_text, unnest(project_ids) AS p FROM hierarchical_facets WHERE facet_type = 'room' AND facet_text IS NOT NULL), k AS (SELECT DISTINCT facet_text FROM e WHERE p IN ('atlas-notebook', 'garnet-parser')),
 rel AS (SELECT DISTINCT p AS project_id FROM e WHERE facet_text IN (SELECT facet_text FROM k) AND p NOT IN ('atlas-notebook', 'garnet-parser') ORDER BY 1 LIMIT 5)"""


def _related(spark, d, scope, limit=5):
    e = table(spark, d, "hierarchical_facets").where("facet_type = 'room' and facet_text is not null").select("facet_text", F.explode("project_ids").alias("project_id")).distinct()
    keys = e.where(F.col("project_id").isin(scope)).select("facet_text").distinct()
    return e.join(keys, "facet_text", "left_semi").where(~F.col("project_id").isin(scope)).select("project_id").distinct().orderBy("project_id").limit(limit)


@query(f"WITH {_REL} SELECT project_id FROM rel")
def related_projects(spark, d):
    return _related(spark, d, ["atlas-notebook", "garnet-parser"])


@query(f"WITH {_LEGS}, {_REL}, h AS (SELECT sem.id, coalesce(d.project_id, 'none') AS project_id, sem.score FROM sem JOIN documents d ON d.doc_id = sem.id), f AS (SELECT *, project_id IN ('atlas-notebook', 'garnet-parser') AS sc, project_id IN ('atlas-notebook', 'garnet-parser') OR project_id IN (SELECT project_id FROM rel) AS nr FROM h), t AS (SELECT CASE WHEN count(*) FILTER (sc) >= 3 THEN 'scoped' WHEN count(*) FILTER (nr) >= 3 THEN 'related' ELSE 'unscoped' END AS tier FROM f) SELECT id, project_id, tier FROM f, t WHERE tier = 'unscoped' OR (tier = 'related' AND nr) OR (tier = 'scoped' AND sc)")
def fallback_tiers(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("project_id", F.lit("none")).alias("project_id"))
    hits = _legs(spark, d)[1].join(doc, "id")
    scope = ["atlas-notebook", "garnet-parser"]
    return S.with_fallback(hits, "project_id", scope, _related(spark, d, scope)).select("id", "project_id", "tier")


@query("WITH t AS (SELECT coalesce(lang, 'none') AS tier, count(*) AS n FROM documents GROUP BY 1) SELECT tier, n::BIGINT AS uses, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM t")
def tier_percentages(spark, d):
    """Counters of a small set of values as percentages; the language stands for the tier."""
    t = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("tier")).agg(F.count("*").alias("uses"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("uses").alias("all")))).select("tier", "uses", R9(100.0 * F.col("uses") / F.col("all")).alias("percent"))


@query(f"""WITH {EXCH}, s AS (SELECT exchange_id AS id, exchange_text AS t, coalesce(nullif(strpos(lower(exchange_text), 'sort is not stable'), 0), nullif(strpos(lower(exchange_text), 'queue'), 0), 0) AS a FROM exch WHERE exchange_text IS NOT NULL), u AS (SELECT *, greatest(a - 101, 0) AS b, least(a - 1 + 200, length(t)) AS e FROM s)
SELECT id, CASE WHEN a > 0 THEN (CASE WHEN b > 0 THEN '...' ELSE '' END) || substr(t, b + 1, e - b) || (CASE WHEN e < length(t) THEN '...' ELSE '' END) ELSE substr(t, 1, 200) || (CASE WHEN length(t) > 200 THEN '...' ELSE '' END) END AS snippet FROM u""")
def snippet_centered(spark, d):
    return _exch(spark, d).select("id", T.snippet(F.col("txt"), ["sort is not stable"], ["queue"]).alias("snippet"))


@query()
def query_classes(spark, d):
    rows = [(q, *Q.classify(q)) for q in ("fix error in app/main.py:12", "why is the design of the queue better than a pool", "def merge_rows", "hello there", "compare \"lock\" versus semaphore", ADAPTIVE)]
    return spark.createDataFrame(rows, "query string, class string, keyword_weight double, semantic_weight double, confidence double")


@query()
def query_parts(spark, d):
    rows = []
    for q in ('"exact phrase" +must -not word', "one AND two", "red OR blue", "cross-layer search last week", "it's fine"):
        p = Q.parse(q)
        rows.append((q, "|".join(p.phrases), "|".join(p.must), "|".join(p.without), "|".join(p.should)))
    return spark.createDataFrame(rows, "query string, phrases string, must string, without string, should string")


@query()
def embedded_exchanges(spark, d):
    return models.embedded(_exch(spark, d), "txt", models.hashed_embedding()).select("id", F.size("embedding").alias("size"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))
