"""Facets, rooms and routing queries. Objects are exchanges distilled by the extractive default; their rooms are the folders of the files they touch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.core import table
from colloquy.functions import models
from colloquy.functions import text as T
from colloquy.functions import vectors as V
from colloquy.operators import facets as FA
from colloquy.operators import search as S
from colloquy.plans.base import EXCH, FACET, FACET_Q, exchanges, facet_query, facets, query
from colloquy.plans.search import _DIST

NOW = "2025-12-31"
R6 = lambda c: F.round(c, 6)
_PATH_SQL = T.PATH.replace("'", "''")
_CORE = "substr(regexp_extract(regexp_replace(exchange_text, '^[a-z]+: ', ''), '(?s)^(.*?(?:[.?!。]|\\n|$))', 1), 1, 160)"
_RUNS = "list_filter(list_transform(list_filter(regexp_extract_all({0}, '" + T.RUN + "'), lambda r: contains(r, '.')), lambda r: regexp_extract(r, '" + _PATH_SQL + "', 1)), lambda p: p <> '')"
PATHS = f"""list_distinct(list_transform(list_concat(flatten(list_transform(regexp_extract_all(exchange_text, '`([^`\\n]+)`', 1), lambda s: {_RUNS.format('s')})), {_RUNS.format('exchange_text')}), lambda p: regexp_replace(replace(p, '\\', '/'), '^\\./', '')))"""
OBJ = f"""{EXCH}, obj AS (SELECT exchange_id AS object_id, conversation_id, project_id, ply_start, ply_end, created_at AS exchange_at, {_CORE} AS exchange_core, {PATHS} AS files FROM exch WHERE exchange_text IS NOT NULL)"""
EDGE = """edge AS (SELECT object_id, project_id, exchange_at, unnest(files) AS path FROM obj)"""
ROOM = """edges AS (SELECT DISTINCT object_id, project_id, exchange_at, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS room_key FROM edge),
 jn AS (SELECT substr(sha256('file:' || room_key || ':' || coalesce(project_id, '')), 1, 16) AS room_id, room_key, project_id, object_id, exchange_at FROM edges WHERE room_key <> '')"""


def objects(spark, d):
    """(object_id, conversation_id, project_id, ply_start, ply_end, exchange_at, exchange_core, files)."""
    x = exchanges(spark, d).where("exchange_text is not null")
    o = models.distilled(x, "exchange_text")
    return o.select(F.col("exchange_id").alias("object_id"), "conversation_id", "project_id", "ply_start", "ply_end", F.col("created_at").alias("exchange_at"), "exchange_core", T.file_paths(F.col("exchange_text")).alias("files"))


def room_objects(spark, d):
    """(room_id, room_key, project_id, object_id, exchange_at): which object lies in which room."""
    e = objects(spark, d).select("object_id", "project_id", "exchange_at", F.explode("files").alias("path")).select("object_id", "project_id", "exchange_at", T.parent(F.col("path")).alias("room_key")).distinct()
    return e.where("room_key != ''").select(T.room_id(F.lit("file"), F.col("room_key"), F.col("project_id")).alias("room_id"), "room_key", "project_id", "object_id", "exchange_at")


@query(f"WITH {OBJ} SELECT object_id, exchange_core, array_to_string(list_sort(files), '|') AS files FROM obj")
def distilled_objects(spark, d):
    return objects(spark, d).select("object_id", "exchange_core", F.array_join(F.array_sort("files"), "|").alias("files"))


@query(f"WITH {OBJ}, {EDGE}, {ROOM} SELECT room_id, min(room_key) AS room_key, min(project_id) AS project_id, count(*)::BIGINT AS object_count, max(exchange_at) AS updated_at FROM jn GROUP BY 1")
def rooms(spark, d):
    return room_objects(spark, d).groupBy("room_id").agg(F.min("room_key").alias("room_key"), F.min("project_id").alias("project_id"), F.count("*").alias("object_count"), F.max("exchange_at").alias("updated_at"))


@query(f"WITH {OBJ}, {EDGE}, {ROOM}, r AS (SELECT room_id, min(room_key) AS room_key, count(*)::BIGINT AS object_count, max(exchange_at) AS updated_at FROM jn GROUP BY 1) SELECT * FROM r ORDER BY object_count DESC, updated_at DESC NULLS LAST, room_id LIMIT 20")
def rooms_largest(spark, d):
    return rooms(spark, d).select("room_id", "room_key", "object_count", "updated_at").orderBy(F.desc("object_count"), F.col("updated_at").desc_nulls_last(), "room_id").limit(20)


@query(f"WITH {OBJ}, {EDGE}, {ROOM}, r AS (SELECT room_id FROM jn GROUP BY 1 ORDER BY count(*) DESC, room_id LIMIT 1) SELECT object_id, exchange_core, jn.exchange_at FROM jn JOIN r USING (room_id) JOIN obj USING (object_id) ORDER BY jn.exchange_at NULLS FIRST, object_id")
def room_walk(spark, d):
    """The objects of the largest room in time order."""
    j = room_objects(spark, d)
    largest = j.groupBy("room_id").count().orderBy(F.desc("count"), "room_id").limit(1).select("room_id")
    return j.join(F.broadcast(largest), "room_id").select("object_id", "exchange_at").join(objects(spark, d).select("object_id", "exchange_core"), "object_id").select("object_id", "exchange_core", "exchange_at").orderBy(F.col("exchange_at").asc_nulls_first(), "object_id")


@query(f"WITH {OBJ}, {EDGE}, {ROOM} SELECT object_id, count(*)::BIGINT AS rooms, string_agg(room_key, '|' ORDER BY room_key) AS room_keys FROM jn GROUP BY 1")
def rooms_of_object(spark, d):
    return room_objects(spark, d).groupBy("object_id").agg(F.count("*").alias("rooms"), F.array_join(F.array_sort(F.collect_list("room_key")), "|").alias("room_keys"))


@query(f"""WITH {EXCH}, o AS (SELECT exchange_id, conversation_id, ply_start, ply_end FROM exch ORDER BY exchange_id LIMIT 1), n AS (SELECT conversation_id, list({{'sequence': sequence, 'content': content}}) AS messages FROM messages WHERE conversation_id IN (SELECT conversation_id FROM o) AND sequence IS NOT NULL GROUP BY 1), u AS (SELECT conversation_id, unnest(messages) AS m FROM n)
SELECT DISTINCT u.conversation_id, m.sequence AS sequence, m.content AS content FROM u JOIN o USING (conversation_id) WHERE m.sequence BETWEEN ply_start AND ply_end ORDER BY 2, 3""")
def drill_to_verbatim(spark, d):
    """The messages of an exchange, from a nested list of its conversation's."""
    o = exchanges(spark, d).orderBy("exchange_id").limit(1).select("conversation_id", "ply_start", "ply_end")
    m = table(spark, d, "messages").where("sequence is not null").join(F.broadcast(o.select("conversation_id")), "conversation_id", "left_semi")
    # nested as the interchange format has it: in parts of a bounded number of messages
    n = m.groupBy("conversation_id", F.floor(F.col("sequence") / 1000).alias("part")).agg(F.collect_list(F.struct("sequence", "content")).alias("messages"))
    u = n.select("conversation_id", F.inline("messages"))
    return u.join(F.broadcast(o), "conversation_id").where("sequence between ply_start and ply_end").select("conversation_id", "sequence", "content").distinct().orderBy("sequence", "content")


@query(f"""WITH {OBJ}, {EDGE}, f AS (SELECT project_id, exchange_at, 'full' AS facet_level, lower(path) AS facet_text, 3.0 AS weight FROM edge WHERE length(path) > 3
 UNION ALL SELECT project_id, exchange_at, 'directory', lower(regexp_replace(path, '/[^/]*$', '') || '/*'), 2.0 FROM edge WHERE contains(path, '/') AND regexp_replace(path, '/[^/]*$', '') <> ''
 UNION ALL SELECT project_id, exchange_at, 'basename', lower(string_split(path, '/')[-1]), 1.0 FROM edge WHERE length(string_split(path, '/')[-1]) > 3)
SELECT substr(sha256('file:' || facet_level || ':' || facet_text), 1, 16) AS facet_id, facet_level, facet_text, count(DISTINCT project_id)::INT AS project_count, round(max(weight)::DOUBLE / (1 + count(DISTINCT project_id)), 6) AS weighted_count, max(exchange_at) AS last_seen,
 CASE WHEN count(DISTINCT project_id) BETWEEN 1 AND 3 THEN string_agg(DISTINCT project_id, ',' ORDER BY project_id) END AS projects FROM f GROUP BY 2, 3""")
def facet_build_hierarchical(spark, d):
    e = objects(spark, d).select("project_id", F.col("exchange_at").alias("seen"), F.explode("files").alias("path"))
    f = FA.counted(FA.path_facets(e))
    return f.select("facet_id", "facet_level", "facet_text", "project_count", R6(F.col("weighted_count")).alias("weighted_count"), "last_seen", F.array_join("project_ids", ",").alias("projects"))


@query("""WITH p AS (SELECT DISTINCT project_id FROM exchanges WHERE project_id IS NOT NULL), t AS (SELECT DISTINCT project_id, unnest(string_split_regex(lower(project_id), '[-_]+')) AS t FROM p)
SELECT substr(sha256('project:' || t), 1, 16) AS facet_id, t AS facet_text, count(*)::BIGINT AS projects FROM t WHERE length(t) > 2 AND t NOT IN ('projects', 'home', 'tmp', 'mnt', 'users', 'data', 'subtask', 'workspaces', 'benchmark', 'var', 'opt') GROUP BY 2""")
def facet_build_flat(spark, d):
    p = table(spark, d, "exchanges").where("project_id is not null").select("project_id").distinct()
    return FA.project_parts(p).groupBy("facet_text").agg(F.count("*").alias("projects")).select(T.facet_id(F.lit("project"), F.col("facet_text")).alias("facet_id"), "facet_text", "projects")


_HITS = f"{FACET}, {FACET_Q}, hit AS (SELECT facet_id, facet_type, facet_level, facet_text, weight, weighted_count, project_ids, project_count, last_seen, {_DIST} AS dist, 1 - ({_DIST}) AS sim FROM fac, q)"
_AGE = f"coalesce(exp(-0.01 * greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen)) / 86400e6, 0)), 1.0)"


def _hits(spark, d):
    f = facets(spark, d)
    return S.nearest(f, facet_query(f)).withColumn("sim", 1 - F.col("distance"))


def _nearest(h, k):
    return S.top(h.withColumn("order", F.round("distance", 9)), k, "facet_id", "order", True)


def _aged(h):
    return h.withColumn("aged", FA.aged(F.col("sim"), F.col("last_seen"), F.lit(NOW).cast("timestamp_ntz")))


@query(f"WITH {_HITS} SELECT facet_id, facet_text, round(dist, 6) AS distance FROM hit WHERE facet_type IN ('file') AND project_count <= 3 ORDER BY round(dist, 9), facet_id LIMIT 20")
def facet_search(spark, d):
    return _nearest(_hits(spark, d).where("facet_type in ('file') and project_count <= 3"), 20).select("facet_id", "facet_text", R6(F.col("distance")).alias("distance"))


@query(f"WITH {_HITS}, t AS (SELECT * FROM hit WHERE project_count <= 3 ORDER BY round(dist, 9), facet_id LIMIT 40) SELECT facet_id, round(sim * {_AGE}, 6) AS score FROM t ORDER BY round(sim * {_AGE}, 9) DESC, facet_id LIMIT 20")
def facet_search_decayed(spark, d):
    """Twice as many by distance, then the best of these by similarity that falls off with age."""
    t = _aged(_nearest(_hits(spark, d).where("project_count <= 3"), 40)).withColumn("score", F.round("aged", 9))
    return S.top(t, 20, "facet_id").select("facet_id", R6(F.col("score")).alias("score"))


@query(f"WITH {_HITS} SELECT facet_id, facet_level, round(dist, 6) AS distance FROM hit WHERE weighted_count >= 0.75 AND project_count <= 3 ORDER BY round(dist, 9), facet_id LIMIT 20")
def facet_search_hierarchical(spark, d):
    return _nearest(_hits(spark, d).where("weighted_count >= 0.75 and project_count <= 3"), 20).select("facet_id", "facet_level", R6(F.col("distance")).alias("distance"))


@query(f"WITH {_HITS}, t AS (SELECT * FROM hit WHERE project_count <= 3 ORDER BY round(dist, 9), facet_id LIMIT 1) SELECT facet_id, unnest(list_sort(project_ids)) AS project_id FROM t")
def facet_winner(spark, d):
    return _nearest(_hits(spark, d).where("project_count <= 3"), 1).select("facet_id", F.explode(F.array_sort("project_ids")).alias("project_id"))


def _votes_sql(k: int, vote: str) -> str:
    return f"""WITH {_HITS}, t AS (SELECT *, {vote} AS v FROM hit WHERE project_count <= 3 ORDER BY round(dist, 9), facet_id LIMIT {k}), u AS (SELECT unnest(project_ids) AS project_id, v FROM t), g AS (SELECT project_id, sum(v) AS votes FROM u GROUP BY 1)
SELECT project_id, round(votes, 6) AS votes, round(votes / sum(votes) OVER (), 6) AS confidence, (row_number() OVER (ORDER BY round(votes, 9) DESC, project_id) = 1 AND votes / sum(votes) OVER () >= 0.6) AS winner FROM g"""


def _vote(df, vote):
    return FA.votes(df, vote).select("project_id", R6(F.col("votes")).alias("votes"), R6(F.col("confidence")).alias("confidence"), "winner")


@query(_votes_sql(5, "1 / (1 + dist)"))
def facet_weighted_vote(spark, d):
    return _vote(_nearest(_hits(spark, d).where("project_count <= 3"), 5), F.col("score"))


@query(_votes_sql(5, f"sim * {_AGE}"))
def facet_temporal_vote(spark, d):
    return _vote(_aged(_nearest(_hits(spark, d).where("project_count <= 3"), 5)), F.col("aged"))


@query(_votes_sql(10, "sim * weight * weighted_count"))
def hierarchical_vote(spark, d):
    return _vote(_nearest(_hits(spark, d).where("project_count <= 3"), 10), F.col("sim") * F.col("weight") * F.col("weighted_count"))


_SCOPED = """, sc AS (SELECT project_id FROM g ORDER BY round(votes, 9) DESC, project_id LIMIT 3) SELECT d.doc_id AS id, coalesce(d.project_id, 'none') AS project_id, len(list_filter(string_split_regex(lower(d.text), '[^a-z0-9]+'), lambda w: w = 'snapshot'))::INT AS hits FROM documents d WHERE d.project_id IN (SELECT project_id FROM sc) AND contains(lower(d.text), 'snapshot')"""


def _scoped_sql(k: int, vote: str) -> str:
    return f"WITH {_HITS}, t AS (SELECT *, {vote} AS v FROM hit WHERE project_count <= 3 ORDER BY round(dist, 9), facet_id LIMIT {k}), u AS (SELECT unnest(project_ids) AS project_id, v FROM t), g AS (SELECT project_id, sum(v) AS votes FROM u GROUP BY 1){_SCOPED}"


def _scoped(spark, d, hits, vote):
    """Documents of the three projects with the most votes that hold the word, with how often."""
    v = FA.votes(hits, vote)
    scope = v.orderBy(F.round("votes", 9).desc(), "project_id").limit(3).select("project_id")
    docs = table(spark, d, "documents").where(T.all_phrases(F.col("text"), ["snapshot"])).join(F.broadcast(scope), "project_id", "left_semi")
    return docs.select(F.col("doc_id").alias("id"), "project_id", F.size(F.filter(T.words(F.col("text")), lambda w: w == "snapshot")).alias("hits"))


@query(_scoped_sql(10, "sim * weight * weighted_count"))
def hierarchical_mode(spark, d):
    return _scoped(spark, d, _nearest(_hits(spark, d).where("project_count <= 3"), 10), F.col("sim") * F.col("weight") * F.col("weighted_count"))


@query(_scoped_sql(5, f"sim * {_AGE}"))
def temporal_mode(spark, d):
    return _scoped(spark, d, _aged(_nearest(_hits(spark, d).where("project_count <= 3"), 5)), F.col("aged"))


@query(f"WITH {_HITS}, t AS (SELECT * FROM hit ORDER BY round(dist, 9), facet_id LIMIT 30) SELECT facet_level AS room, round(avg(1 / (1 + dist)), 6) AS score, count(*)::BIGINT AS hits FROM t GROUP BY 1")
def room_mean_score(spark, d):
    """The mean nearness of the hits of each room; the level of a facet stands for its room."""
    return _nearest(_hits(spark, d), 30).groupBy(F.col("facet_level").alias("room")).agg(R6(F.avg("score")).alias("score"), F.count("*").alias("hits"))


@query(f"""WITH {_HITS}, kw AS (SELECT facet_id, 0 AS phase, 1.0::DOUBLE AS score FROM fac WHERE facet_type = 'room' AND contains(lower(facet_text), 'e')), sm AS (SELECT facet_id, 1 AS phase, round(1 / (1 + dist), 9) AS score FROM hit WHERE facet_type = 'room'),
 al AS (SELECT * FROM (SELECT * FROM kw UNION ALL SELECT * FROM sm) QUALIFY row_number() OVER (PARTITION BY facet_id ORDER BY phase) = 1) SELECT facet_id, phase::INT AS phase, round(score, 6) AS score FROM al ORDER BY phase, al.score DESC, facet_id LIMIT 25""")
def room_finder(spark, d):
    """Rooms by keyword first, then rooms by vector that are not among them."""
    f = facets(spark, d).where("facet_type = 'room'")
    kw = f.where(F.lower("facet_text").contains("e")).select("facet_id", F.lit(0).alias("phase"), F.lit(1.0).alias("score"))
    sm = _hits(spark, d).where("facet_type = 'room'").select("facet_id", F.lit(1).alias("phase"), F.round("score", 9).alias("score"))
    al = kw.unionAll(sm).withColumn("n", F.row_number().over(Window.partitionBy("facet_id").orderBy("phase"))).where("n = 1")
    return al.orderBy("phase", F.desc("score"), "facet_id").limit(25).select("facet_id", "phase", R6(F.col("score")).alias("score"))


_KW = "len(list_filter(string_split_regex(regexp_replace(lower(facet_text), '[_\\-/\\\\.:]', ' ', 'g'), '\\s+'), lambda w: w IN ('room', 'vector', 'fetch')))::DOUBLE"


@query(f"""WITH {_HITS}, k AS (SELECT facet_id, {_KW} AS score FROM fac WHERE {_KW} > 0 ORDER BY score DESC, facet_id LIMIT 40), s AS (SELECT facet_id, round(1 / (1 + dist), 9) AS score FROM hit ORDER BY score DESC, facet_id LIMIT 40),
 kd AS (SELECT greatest(CASE WHEN count(*) >= 10 THEN quantile_cont(score, 0.95) WHEN count(*) > 0 THEN max(score) ELSE 1.0 END, 1e-10) AS div FROM k), sd AS (SELECT greatest(CASE WHEN count(*) >= 10 THEN quantile_cont(score, 0.95) WHEN count(*) > 0 THEN max(score) ELSE 1.0 END, 1e-10) AS div FROM s),
 j AS (SELECT coalesce(k.facet_id, s.facet_id) AS facet_id, (0.5 * least(coalesce(k.score, 0) / (SELECT div FROM kd), 1.0) + 0.5 * least(coalesce(s.score, 0) / (SELECT div FROM sd), 1.0)) * CASE WHEN k.facet_id IS NOT NULL AND s.facet_id IS NOT NULL THEN 1.2 ELSE 1.0 END AS score FROM k FULL OUTER JOIN s ON k.facet_id = s.facet_id)
SELECT facet_id, round(score, 6) AS score FROM j ORDER BY round(score, 9) DESC, facet_id LIMIT 20""")
def palace_hybrid(spark, d):
    """Words and vectors of the distilled layer, normalised, summed by weight and raised where both agree."""
    f = facets(spark, d)
    wanted = ["room", "vector", "fetch"]
    k = f.select("facet_id", F.size(F.filter(T.field_words(F.col("facet_text")), lambda w: w.isin(wanted))).cast("double").alias("score")).where("score > 0")
    s = _hits(spark, d).select("facet_id", F.round("score", 9).alias("score"))
    a, b = (S.normalised(S.top(x, 40, "facet_id")).select("facet_id", F.col("norm").alias(n)) for x, n in ((k, "a"), (s, "b")))
    j = a.join(b, "facet_id", "full_outer")
    base = 0.5 * F.coalesce("a", F.lit(0.0)) + 0.5 * F.coalesce("b", F.lit(0.0))
    j = j.withColumn("score", F.round(base * F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1.2).otherwise(1.0), 9))
    return S.top(j, 20, "facet_id").select("facet_id", R6(F.col("score")).alias("score"))


@query(f"WITH {FACET}, {FACET_Q} SELECT facet_id, round({_DIST}, 6) AS distance, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM fac, q WHERE facet_type = 'project'")
def vector_functions(spark, d):
    f = facets(spark, d)
    h = S.nearest(f, facet_query(f)).where("facet_type = 'project'")
    return h.select("facet_id", R6(F.col("distance")).alias("distance"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))
