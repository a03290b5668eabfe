"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.core import table
from colloquy.functions import text as T
from colloquy.plans.base import CONV, EXCH, conversations, exchanges, query


@query(f"""WITH {CONV} SELECT conversation_id, lower(title) AS low, len(string_split(title, ' '))::INT AS parts, trim(title) AS trimmed, starts_with(title, 'The') AS starts, contains(title, 'queue') AS has, strpos(title, 'queue')::INT AS at, substr(title, 3, 5) AS slice, replace(title, ' ', '_') AS replaced FROM conv WHERE title IS NOT NULL""")
def string_functions(spark, d):
    t = F.col("title")
    return conversations(spark, d).where("title is not null").select(
        "conversation_id", F.lower(t).alias("low"), F.size(F.split(t, " ")).alias("parts"), F.trim(t).alias("trimmed"), t.startswith("The").alias("starts"), t.contains("queue").alias("has"), F.locate("queue", t).alias("at"), F.substring(t, 3, 5).alias("slice"), F.replace(t, F.lit(" "), F.lit("_")).alias("replaced"),
    )


@query(f"WITH {CONV} SELECT conversation_id, title ILIKE '%' || 'QUEUE' || '%' AS hit FROM conv WHERE title IS NOT NULL")
def ilike_concat(spark, d):
    return conversations(spark, d).where("title is not null").select("conversation_id", F.expr("title ilike concat('%', 'QUEUE', '%')").alias("hit"))


@query(f"""WITH {CONV} SELECT conversation_id, string_split(file_path, '/')[-1] AS name, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS folder, (CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END) || '/*' AS pattern FROM conv WHERE file_path IS NOT NULL""")
def path_functions(spark, d):
    p = F.col("file_path")
    return conversations(spark, d).where("file_path is not null").select("conversation_id", T.basename(p).alias("name"), T.parent(p).alias("folder"), F.concat(T.parent(p), F.lit("/*")).alias("pattern"))


@query(f"""WITH {CONV} SELECT conversation_id, substr(sha256('file:' || conversation_id), 1, 16) AS facet_id, substr(sha256('file:full:' || conversation_id), 1, 16) AS level_facet_id, substr(sha256('file:' || conversation_id || ':' || coalesce(project_id, '')), 1, 16) AS room_id, md5(conversation_id || '|0|1') AS exchange_id FROM conv""")
def identity_hashes(spark, d):
    c = F.col("conversation_id")
    return conversations(spark, d).select("conversation_id", T.facet_id(F.lit("file"), c).alias("facet_id"), T.level_facet_id(F.lit("file"), F.lit("full"), c).alias("level_facet_id"), T.room_id(F.lit("file"), c, F.col("project_id")).alias("room_id"), T.exchange_id(c, F.lit(0), F.lit(1)).alias("exchange_id"))


@query("SELECT event_id, round(1 / (1 + value), 6) AS near, round(exp(-0.01 * value), 6) AS aged, round(value / greatest(value, 1.0), 6) AS ratio, round(value, 1) AS rounded FROM events WHERE value >= 0")
def math_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").where("value >= 0").select("event_id", F.round(1 / (1 + v), 6).alias("near"), F.round(F.exp(-0.01 * v), 6).alias("aged"), F.round(v / F.greatest(v, F.lit(1.0)), 6).alias("ratio"), F.round(v, 1).alias("rounded"))


@query("SELECT DISTINCT facet_id, array_to_string(list_sort(list_distinct(project_ids)), ',') AS sorted, list_contains(project_ids, 'atlas-notebook') AS member, len(project_ids)::INT AS size FROM hierarchical_facets WHERE facet_id IS NOT NULL AND project_ids IS NOT NULL")
def array_functions(spark, d):
    p = F.col("project_ids")
    return table(spark, d, "hierarchical_facets").where("facet_id is not null and project_ids is not null").select("facet_id", F.array_join(F.array_sort(F.array_distinct(p)), ",").alias("sorted"), F.array_contains(p, "atlas-notebook").alias("member"), F.size(p).alias("size")).distinct()


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k, (props::JSON ->> 'none') IS NULL AS missing FROM events")
def json_functions(spark, d):
    j = F.from_json("props", "k int, none string")
    return table(spark, d, "events").select("event_id", j["k"].alias("k"), j["none"].isNull().alias("missing"))


@query("SELECT event_id, date_trunc('day', ts) AS day, ts - INTERVAL 7 DAY AS week_before, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6, 6) AS days, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def date_functions(spark, d):
    t = F.col("ts")
    us = F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.date_trunc("day", t).cast("timestamp_ntz").alias("day"), (t - F.expr("interval 7 days")).alias("week_before"), F.round(us / 86400e6, 6).alias("days"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query(f"WITH {CONV} SELECT conversation_id, coalesce(title, 'Untitled') AS title, coalesce(message_count, 0) AS message_count, CASE WHEN project_id IS NULL THEN 'none' ELSE project_id END AS project FROM conv")
def conditional_functions(spark, d):
    return conversations(spark, d).select("conversation_id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("message_count", F.lit(0)).alias("message_count"), F.when(F.col("project_id").isNull(), "none").otherwise(F.col("project_id")).alias("project"))


@query(f"WITH {EXCH} SELECT exchange_id, len(list_filter(string_split_regex(lower(exchange_text), '[^a-z0-9]+'), lambda w: w <> ''))::INT AS words, len(list_distinct(list_filter(string_split_regex(lower(exchange_text), '[^a-z0-9]+'), lambda w: w <> '')))::INT AS distinct_words FROM exch WHERE exchange_text IS NOT NULL")
def word_counts(spark, d):
    w = T.words(F.col("exchange_text"))
    return exchanges(spark, d).where("exchange_text is not null").select("exchange_id", F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct_words"))
