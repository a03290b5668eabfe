"""Lookups, filters, listings, statistics and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.core import table
from colloquy.functions import text as T
from colloquy.operators import listing as O
from colloquy.plans.base import CONV, EXCH, FACET, STATE, conversations, exchanges, facets, query, states

L = F.lit
FIRST_CONV = "(SELECT min(conversation_id) FROM conversations)"


def _first(df, column):
    """The least value of a column, as a one-row frame."""
    return df.agg(F.min(column).alias("k"))


@query(f"WITH {CONV} SELECT conversation_id, title, message_count FROM conv WHERE conversation_id = {FIRST_CONV}")
def conversation_by_id(spark, d):
    c = conversations(spark, d)
    return c.join(F.broadcast(_first(table(spark, d, "conversations"), "conversation_id")), F.col("conversation_id") == F.col("k")).select("conversation_id", "title", "message_count")


@query(f"WITH {CONV}, ids AS (SELECT DISTINCT conversation_id FROM source_file_state WHERE lower(status) = 'invalid') SELECT conversation_id, title FROM conv WHERE conversation_id IN (SELECT conversation_id FROM ids WHERE conversation_id IS NOT NULL)")
def conversations_batch(spark, d):
    ids = table(spark, d, "source_file_state").where("lower(status) = 'invalid'").select("conversation_id").distinct()
    return conversations(spark, d).join(ids, "conversation_id", "left_semi").select("conversation_id", "title")


@query(f"WITH {CONV}, asked AS (SELECT DISTINCT conversation_id FROM messages WHERE conversation_id IS NOT NULL) SELECT a.conversation_id, (c.conversation_id IS NOT NULL) AS present FROM asked a LEFT JOIN conv c USING (conversation_id)")
def conversation_exists(spark, d):
    asked = table(spark, d, "messages").where("conversation_id is not null").select("conversation_id").distinct()
    return O.exists_each(asked, conversations(spark, d), "conversation_id")


@query(f"WITH {EXCH} SELECT e.exchange_id, e.conversation_id, e.ply_start, e.ply_end FROM exch e WHERE ply_start = 0 AND ply_end = 1 AND conversation_id IN (SELECT conversation_id FROM conversations WHERE message_count = 2)")
def exchange_by_ply(spark, d):
    two = table(spark, d, "conversations").where("message_count = 2").select("conversation_id")
    return exchanges(spark, d).where("ply_start = 0 and ply_end = 1").join(two, "conversation_id", "left_semi").select("exchange_id", "conversation_id", "ply_start", "ply_end")


@query(f"WITH {EXCH}, p AS (SELECT DISTINCT project_id FROM project_settings WHERE time_zone LIKE 'America/%') SELECT project_id, count(*)::BIGINT AS exchanges FROM exch WHERE project_id IN (SELECT project_id FROM p) GROUP BY 1")
def exchanges_of_projects(spark, d):
    p = table(spark, d, "project_settings").where("time_zone like 'America/%'").select("project_id").distinct()
    return exchanges(spark, d).join(F.broadcast(p), "project_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("exchanges"))


@query(f"WITH {CONV} SELECT conversation_id, message_count FROM conv WHERE (updated_at IS NULL OR updated_at BETWEEN TIMESTAMP '2024-06-01' AND TIMESTAMP '2025-06-01') AND coalesce(message_count, 0) >= 4")
def date_window_min_messages(spark, d):
    return O.search_filters(conversations(spark, d), since="2024-06-01", until="2025-06-01", min_messages=4).select("conversation_id", "message_count")


@query(f"WITH {EXCH} SELECT exchange_id FROM exch WHERE contains(lower(exchange_text), 'the sort is not stable') AND NOT contains(lower(exchange_text), 'snapshot') AND NOT contains(lower(exchange_text), 'yaml')")
def phrase_and_exclude(spark, d):
    x = exchanges(spark, d)
    return x.where(T.all_phrases(F.col("exchange_text"), ["The sort is not stable"]) & T.none_of(F.col("exchange_text"), ["snapshot", "yaml"])).select("exchange_id")


@query(f"WITH {FACET} SELECT facet_id, facet_text FROM fac WHERE facet_type IN ('file', 'room') AND project_count <= 2 AND weighted_count >= 0.5")
def facet_predicates(spark, d):
    return facets(spark, d).where(F.col("facet_type").isin("file", "room") & (F.col("project_count") <= 2) & (F.col("weighted_count") >= 0.5)).select("facet_id", "facet_text")


@query("SELECT DISTINCT facet_id, facet_text FROM hierarchical_facets WHERE facet_id IS NOT NULL AND facet_type = 'room' AND facet_text ILIKE '%e%'")
def rooms_by_keyword(spark, d):
    r = table(spark, d, "hierarchical_facets").where("facet_id is not null and facet_type = 'room'")
    return O.keyword_rooms(r, "e", ["facet_text"]).select("facet_id", "facet_text").distinct()


_LIST = f"WITH {CONV} SELECT conversation_id, title, message_count, updated_at FROM conv WHERE message_count > 0 AND updated_at >= TIMESTAMP '2024-03-01' AND updated_at < TIMESTAMP '2025-10-01'"


@query(f"{_LIST} ORDER BY message_count DESC, conversation_id LIMIT 25 OFFSET 25")
def conversations_page(spark, d):
    return O.page(O.listed(conversations(spark, d), since="2024-03-01", until="2025-09-30"), "length", 25, 25).select("conversation_id", "title", "message_count", "updated_at")


@query(f"{_LIST} ORDER BY updated_at DESC NULLS LAST, conversation_id LIMIT 20")
def conversations_newest(spark, d):
    return O.page(O.listed(conversations(spark, d), since="2024-03-01", until="2025-09-30"), "date_newest", 20).select("conversation_id", "title", "message_count", "updated_at")


@query(f"{_LIST} ORDER BY title NULLS LAST, conversation_id LIMIT 20")
def conversations_by_title(spark, d):
    return O.page(O.listed(conversations(spark, d), since="2024-03-01", until="2025-09-30"), "title", 20).select("conversation_id", "title", "message_count", "updated_at")


@query(f"WITH x AS ({_LIST}) SELECT count(*)::BIGINT AS total, count(*) > 45 AS has_more FROM x")
def conversations_total(spark, d):
    return O.listed(conversations(spark, d), since="2024-03-01", until="2025-09-30").agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > 45)


@query(f"WITH {CONV} SELECT conversation_id, message_count, substr(full_text, 1, 200) AS preview FROM conv ORDER BY message_count DESC NULLS LAST, conversation_id LIMIT 50")
def cli_listing(spark, d):
    return conversations(spark, d).orderBy(F.col("message_count").desc_nulls_last(), "conversation_id").limit(50).select("conversation_id", "message_count", F.substring("full_text", 1, 200).alias("preview"))


@query(f"""WITH {CONV}, p(preset, lo, hi) AS (VALUES ('today', TIMESTAMP '2025-06-15', TIMESTAMP '2025-06-15 12:00:00'), ('week', TIMESTAMP '2025-06-08 12:00:00', TIMESTAMP '2025-06-15 12:00:00'), ('month', TIMESTAMP '2025-05-16 12:00:00', TIMESTAMP '2025-06-15 12:00:00'), ('custom', TIMESTAMP '2025-01-01', TIMESTAMP '2025-02-01'))
SELECT preset, count(conversation_id)::BIGINT AS conversations FROM p LEFT JOIN conv ON updated_at >= lo AND updated_at <= hi GROUP BY 1""")
def date_presets(spark, d):
    c = conversations(spark, d).select("updated_at")
    now = "2025-06-15 12:00:00"
    parts = [c.where(O.preset(F.col("updated_at"), p, now, "2025-01-01", "2025-01-31")).agg(F.count("*").alias("conversations")).select(L(p).alias("preset"), "conversations") for p in ("today", "week", "month", "custom")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f"""WITH {CONV} SELECT conversation_id, coalesce(title, 'Untitled') AS title, CASE WHEN contains(lower(file_path), '/home/') OR contains(lower(file_path), 'wsl') THEN 'WSL' ELSE 'WIN' END AS source,
 CASE WHEN contains(file_path, '/.codex/') THEN 'B' WHEN contains(file_path, '/projects/') THEN 'A' WHEN file_path LIKE '%.json' THEN 'C' ELSE 'A' END AS tool, coalesce(message_count, 0)::BIGINT AS message_count FROM conv""")
def api_projection(spark, d):
    return O.api_row(conversations(spark, d))


@query(f"WITH {CONV} SELECT conversation_id, file_hash, file_path FROM conv WHERE file_hash IS NOT NULL")
def conversation_hashes(spark, d):
    return conversations(spark, d).where("file_hash is not null").select("conversation_id", "file_hash", "file_path")


@query("SELECT DISTINCT conversation_id, ply_start, ply_end FROM exchanges WHERE conversation_id IS NOT NULL")
def exchange_keys(spark, d):
    return table(spark, d, "exchanges").where("conversation_id is not null").select("conversation_id", "ply_start", "ply_end").distinct()


@query("SELECT DISTINCT project_id FROM conversations WHERE project_id IS NOT NULL ORDER BY 1")
def projects_distinct(spark, d):
    return table(spark, d, "conversations").where("project_id is not null").select("project_id").distinct().orderBy("project_id")


@query(f"WITH {CONV} SELECT count(*)::BIGINT AS conversations, coalesce(sum(message_count), 0)::BIGINT AS messages, round(coalesce(avg(message_count), 0), 6) AS average, count(DISTINCT project_id)::BIGINT AS projects, min(updated_at) AS earliest, max(updated_at) AS latest FROM conv")
def index_statistics(spark, d):
    return O.statistics(conversations(spark, d))


_COUNTS = ("conversations", "messages", "exchanges", "hierarchical_facets", "source_file_state", "documents", "embeddings", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count FROM {t}" for t in _COUNTS))
def storage_counts(spark, d):
    out = None
    for t in _COUNTS:
        n = table(spark, d, t).agg(F.count("*").alias("row_count")).select(L(t).alias("table_name"), "row_count")
        out = n if out is None else out.unionAll(n)
    return out


@query(f"WITH {CONV}, m AS (SELECT conversation_id, max(sequence) AS s FROM messages GROUP BY 1) SELECT c.conversation_id, coalesce(m.s, -1)::BIGINT AS last_sequence FROM conv c LEFT JOIN m USING (conversation_id)")
def last_sequence(spark, d):
    m = table(spark, d, "messages").groupBy("conversation_id").agg(F.max("sequence").alias("s"))
    return conversations(spark, d).join(m, "conversation_id", "left").select("conversation_id", F.coalesce("s", L(-1)).cast("long").alias("last_sequence"))


@query("SELECT DISTINCT conversation_id, sequence, content FROM messages WHERE conversation_id IN (SELECT conversation_id FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING count(*) = 2) ORDER BY conversation_id, sequence, content")
def messages_ordered(spark, d):
    m = table(spark, d, "messages")
    two = m.where("conversation_id is not null").groupBy("conversation_id").count().where("count = 2").select("conversation_id")
    return m.join(two, "conversation_id", "left_semi").select("conversation_id", "sequence", "content").distinct().orderBy("conversation_id", "sequence", "content")


@query(f"WITH {EXCH} SELECT conversation_id, exchange_id, ply_start, ply_end FROM exch WHERE conversation_id IN (SELECT conversation_id FROM exch GROUP BY 1 HAVING count(*) >= 3) ORDER BY conversation_id, ply_start, ply_end, exchange_id")
def exchanges_ordered(spark, d):
    x = exchanges(spark, d)
    many = x.groupBy("conversation_id").count().where("count >= 3").select("conversation_id")
    return x.join(many, "conversation_id", "left_semi").select("conversation_id", "exchange_id", "ply_start", "ply_end").orderBy("conversation_id", "ply_start", "ply_end", "exchange_id")


@query(f"WITH {CONV} SELECT coalesce(project_id, 'none') AS project_id, count(*)::BIGINT AS conversations, sum(coalesce(message_count, 0))::BIGINT AS messages FROM conv GROUP BY 1 ORDER BY conversations DESC, project_id")
def project_report(spark, d):
    return O.per_project(conversations(spark, d))


@query(f"WITH {STATE} SELECT lower(coalesce(status, 'unknown')) AS status, count(*)::BIGINT AS files, count(error_message)::BIGINT AS with_error, min(error_message) AS example FROM st GROUP BY 1")
def indexing_report(spark, d):
    return O.status_report(states(spark, d))


_SETS = "a AS (SELECT DISTINCT conversation_id FROM conversations WHERE conversation_id IS NOT NULL), b AS (SELECT DISTINCT conversation_id FROM messages WHERE conversation_id IS NOT NULL)"


def _ids(spark, d):
    return [table(spark, d, t).where("conversation_id is not null").select("conversation_id").distinct() for t in ("conversations", "messages")]


@query(f"WITH {_SETS} SELECT conversation_id FROM a UNION SELECT conversation_id FROM b")
def ids_union(spark, d):
    a, b = _ids(spark, d)
    return a.union(b).distinct()


@query(f"WITH {_SETS} SELECT conversation_id FROM a EXCEPT SELECT conversation_id FROM b")
def ids_difference(spark, d):
    a, b = _ids(spark, d)
    return a.subtract(b)


@query(f"WITH {_SETS} SELECT conversation_id FROM a INTERSECT SELECT conversation_id FROM b")
def ids_intersection(spark, d):
    a, b = _ids(spark, d)
    return a.intersect(b)


@query("""WITH s AS (SELECT DISTINCT facet_id, list_sort(list_distinct(project_ids)) AS resolved FROM hierarchical_facets WHERE facet_id IS NOT NULL AND project_ids IS NOT NULL), w AS (SELECT list_sort(list(DISTINCT project_id)) AS ws FROM project_settings)
SELECT facet_id, array_to_string(CASE WHEN len(list_intersect(ws, resolved)) > 0 THEN list_sort(list_intersect(ws, resolved)) ELSE ws[1:3] END, ',') AS scope FROM s, w""")
def scope_intersection(spark, d):
    s = table(spark, d, "hierarchical_facets").where("facet_id is not null and project_ids is not null").select("facet_id", F.array_sort(F.array_distinct("project_ids")).alias("resolved")).distinct()
    w = table(spark, d, "project_settings").agg(F.array_sort(F.collect_set("project_id")).alias("ws"))  # a fixed table of some tens of rows
    both = F.array_sort(F.array_intersect("ws", "resolved"))
    return s.crossJoin(F.broadcast(w)).select("facet_id", F.array_join(F.when(F.size(both) > 0, both).otherwise(F.slice("ws", 1, 3)), ",").alias("scope"))


@query("""WITH e AS (SELECT DISTINCT facet_text, unnest(project_ids) AS p FROM hierarchical_facets WHERE project_ids IS NOT NULL AND facet_text IS NOT NULL)
SELECT facet_text, count(*)::BIGINT AS projects, string_agg(p, ',' ORDER BY p) AS merged FROM e GROUP BY 1""")
def project_sets_merged(spark, d):
    e = table(spark, d, "hierarchical_facets").where("facet_text is not null").select("facet_text", F.explode("project_ids").alias("p")).distinct()
    return e.groupBy("facet_text").agg(F.count("*").alias("projects"), F.array_join(F.array_sort(F.collect_list("p")), ",").alias("merged"))
