"""Ingestion queries: transcripts from raw_lines, messages into exchanges, detection of changes, and the changes of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.core import table
from colloquy.functions import text as T
from colloquy.operators import mutations as M
from colloquy.operators import segments as SG
from colloquy.plans.base import CONV, EXCH, STATE, conversations, exchanges, msgs_sql, query, states
from colloquy.sources import transcripts as TR

# segmentation

_SEG = f"""{msgs_sql()}, r AS (SELECT *, max(CASE WHEN role IS DISTINCT FROM 'user' AND length(content) > 0 THEN sequence END) OVER w AS la, max(CASE WHEN role = 'user' THEN sequence END) OVER w AS lu FROM msgs WINDOW w AS (PARTITION BY conversation_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT *, sum(CASE WHEN role = 'user' AND la IS NOT NULL AND la > coalesce(lu, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY sequence) AS gid FROM r),
 s AS (SELECT conversation_id, gid, min(sequence) AS first, max(sequence) AS last, sum(length(content)) AS chars, coalesce(sum(length(content)) FILTER (role = 'user'), 0) AS user_chars FROM g GROUP BY 1, 2),
 seg AS (SELECT conversation_id, k AS ply_start, least(k + 19, last) AS ply_end FROM (SELECT *, unnest(range(first, last + 1, 20))::INT AS k FROM s WHERE chars >= 50 AND user_chars > 0))"""


@query(f"WITH {_SEG} SELECT conversation_id, ply_start, ply_end::INT AS ply_end FROM seg")
def exchange_segmentation(spark, d):
    return SG.segments(SG.clean_messages(spark, d))


@query(f"""WITH {_SEG} SELECT md5(seg.conversation_id || '|' || ply_start || '|' || ply_end) AS exchange_id, seg.conversation_id, ply_start, ply_end::INT AS ply_end, md5(string_agg(coalesce(role, 'unknown') || ': ' || content, chr(10) || chr(10) ORDER BY sequence)) AS text_md5
 FROM seg JOIN msgs m ON m.conversation_id = seg.conversation_id AND m.sequence BETWEEN ply_start AND ply_end WHERE content <> '' GROUP BY 1, 2, 3, 4""")
def exchange_text(spark, d):
    m = SG.clean_messages(spark, d)
    return SG.exchange_texts(m, SG.segments(m)).select("exchange_id", "conversation_id", "ply_start", "ply_end", F.md5("exchange_text").alias("text_md5"))


@query(f"WITH {msgs_sql()} SELECT conversation_id, substr(arg_min(content, sequence), 1, 100) AS title, count(*)::BIGINT AS messages, max(sequence)::INT AS last_sequence FROM msgs GROUP BY 1")
def conversation_rollup(spark, d):
    return SG.clean_messages(spark, d).groupBy("conversation_id").agg(F.substring(F.min_by("content", "sequence"), 1, 100).alias("title"), F.count("*").alias("messages"), F.max("sequence").alias("last_sequence"))


@query(f"WITH {msgs_sql()} SELECT conversation_id, sequence, len(regexp_extract_all(content, '(?s)```(?:[A-Za-z0-9_]+)?\\n(.*?)```', 1))::INT AS blocks, len(regexp_extract_all(content, '(?s)```(?:[A-Za-z0-9_]+)?\\n(.*?)```', 1)) > 0 AS has_code FROM msgs")
def code_block_flag(spark, d):
    b = F.size(T.code_blocks(F.col("content")))
    return SG.clean_messages(spark, d).select("conversation_id", "sequence", b.alias("blocks"), (b > 0).alias("has_code"))


@query(f"WITH {msgs_sql()}, f AS (SELECT conversation_id, arg_min(content, sequence) AS first FROM msgs WHERE role = 'user' AND regexp_matches(content, '[^ \t\r\n]') GROUP BY 1) SELECT conversation_id, (starts_with(first, 'Please') OR starts_with(first, 'Why does')) AS internal FROM f")
def internal_prompt_detect(spark, d):
    """With prefixes that occur in the tables; the fixed ones are the default of the operator."""
    m = SG.clean_messages(spark, d).where(F.col("content").rlike(r"[^ \t\r\n]") & (F.col("role") == "user"))
    hits = TR.internal_prompts(m, "conversation_id", ["Please", "Why does"]).withColumn("internal", F.lit(True))
    return m.select("conversation_id").distinct().join(hits, "conversation_id", "left").select("conversation_id", F.coalesce("internal", F.lit(False)).alias("internal"))


@query(f"WITH {msgs_sql()} SELECT conversation_id, max(sequence) FILTER (role = 'user')::INT AS user_sequence, max(sequence) FILTER (role = 'assistant')::INT AS assistant_sequence, md5(substr(arg_max(content, sequence) FILTER (role = 'user'), 1, 4000)) AS user_md5 FROM msgs GROUP BY 1")
def last_exchange(spark, d):
    m = SG.clean_messages(spark, d)
    seq = lambda r: F.max(F.when(F.col("role") == r, F.col("sequence")))
    t = TR.last_exchange(m, "conversation_id").select("conversation_id", F.md5("user_text").alias("user_md5"))
    return m.groupBy("conversation_id").agg(seq("user").alias("user_sequence"), seq("assistant").alias("assistant_sequence")).join(t, "conversation_id")


# transcripts


def _lines(spark, d):
    return TR.checked(table(spark, d, "raw_lines"))


@query()
def transcript_messages(spark, d):
    """Messages of files without a bad line."""
    return TR.messages(_lines(spark, d))


@query()
def transcript_messages_lenient(spark, d):
    return TR.messages(_lines(spark, d), "skip")


@query()
def transcript_rollup(spark, d):
    return TR.rollup(TR.messages(_lines(spark, d), "skip"))


@query()
def transcript_folders(spark, d):
    return TR.folders(_lines(spark, d))


@query()
def single_turn_files(spark, d):
    return TR.single_turn(_lines(spark, d))


@query()
def accepted_files(spark, d):
    return TR.accepted_files(_lines(spark, d))


@query()
def parse_diagnostics(spark, d):
    """Up to five issues of each file that has any, and how many there are."""
    bad = _lines(spark, d).where(F.size("issues") > 0).select("file_path", "line_number", F.concat_ws(": ", F.col("line_number").cast("string"), F.array_join("issues", "; ")).alias("m")).distinct()
    from pyspark.sql import Window

    first = bad.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("line_number", "m")))
    return first.groupBy("file_path").agg(F.count("*").alias("issues"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "m")))), lambda x: x["m"]), " | ").alias("first_five"))


@query(f"WITH {CONV} SELECT conversation_id, CASE WHEN contains(file_path, '/.codex/') THEN 'B' WHEN contains(file_path, '/projects/') THEN 'A' WHEN file_path LIKE '%.json' THEN 'C' ELSE 'A' END AS dialect FROM conv WHERE file_path IS NOT NULL")
def provider_detect(spark, d):
    return conversations(spark, d).where("file_path is not null").select("conversation_id", TR.dialect(F.col("file_path"), F.lit(None).cast("string")).alias("dialect"))


# changes of tables


@query(f"""WITH {CONV}, {STATE}, l AS (SELECT file_path, any_value(file_size ORDER BY conversation_id) AS file_size, any_value(mtime_ns ORDER BY conversation_id) AS mtime_ns FROM (SELECT file_path, conversation_id, file_size, coalesce(mtime_ns, 0) AS mtime_ns FROM conv WHERE file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY conversation_id) = 1) GROUP BY 1)
SELECT l.file_path, CASE WHEN st.file_path IS NULL THEN 'new' WHEN coalesce(st.mtime_ns, 0) = 0 THEN 'backfill' WHEN st.mtime_ns = l.mtime_ns THEN 'same' WHEN st.file_size IS NOT DISTINCT FROM l.file_size THEN 'touched' ELSE 'changed' END AS change FROM l LEFT JOIN st ON l.file_path = st.file_path""")
def change_detection(spark, d):
    """Conversations stand for the files listed now."""
    l = M.latest(conversations(spark, d).where("file_path is not null"), ["file_path"], F.col("conversation_id")).select("file_path", "file_size", F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"))
    return M.changed_files(l, states(spark, d)).select("file_path", "change")


@query("""WITH a AS (SELECT conversation_id, title, indexed_at, updated_at, row_number() OVER (PARTITION BY conversation_id ORDER BY indexed_at NULLS FIRST, updated_at NULLS FIRST, title NULLS FIRST) AS lo, row_number() OVER (PARTITION BY conversation_id ORDER BY indexed_at DESC NULLS LAST, updated_at DESC NULLS LAST, title NULLS FIRST) AS hi FROM conversations WHERE conversation_id IS NOT NULL)
SELECT h.conversation_id, h.title, l.updated_at AS created, h.indexed_at FROM (SELECT * FROM a WHERE hi = 1) h JOIN (SELECT * FROM a WHERE lo = 1) l USING (conversation_id)""")
def upsert_preserve_created(spark, d):
    """The first indexing of each conversation, then the last one put over it; what stands in `created` stays."""
    c = table(spark, d, "conversations").where("conversation_id is not null").select("conversation_id", "title", F.col("updated_at").alias("created"), "indexed_at")
    old = M.latest(c, ["conversation_id"], F.col("indexed_at").asc_nulls_first(), F.col("created").asc_nulls_first(), F.col("title").asc_nulls_first())
    new = M.latest(c, ["conversation_id"], F.col("indexed_at").desc_nulls_last(), F.col("created").desc_nulls_last(), F.col("title").asc_nulls_first())
    return M.upsert(old, new, ["conversation_id"], keep=("created",))


@query(f"WITH {CONV} SELECT conversation_id, title, message_count, indexed_at FROM conv")
def upsert_keep_latest(spark, d):
    return conversations(spark, d).select("conversation_id", "title", "message_count", "indexed_at")


_KEYED = """k AS (SELECT conversation_id, ply_start, ply_end, exchange_id, length(exchange_text)::INT AS chars, row_number() OVER (PARTITION BY conversation_id, ply_start, ply_end ORDER BY exchange_id) AS n FROM (SELECT DISTINCT exchange_id, conversation_id, ply_start, ply_end, exchange_text FROM exchanges WHERE exchange_id IS NOT NULL AND conversation_id IS NOT NULL))"""


@query(f"WITH {_KEYED} SELECT conversation_id, ply_start, ply_end, exchange_id FROM k WHERE n = 1")
def insert_if_absent(spark, d):
    """Exchanges into an empty table, then again: keys that are there stay as they are."""
    x = table(spark, d, "exchanges").where("exchange_id is not null and conversation_id is not null")
    keys = ["conversation_id", "ply_start", "ply_end"]
    one = M.latest(x, keys, F.col("exchange_id")).select(*keys, "exchange_id")
    return M.insert_absent(one, one.withColumn("exchange_id", F.lit("other")), keys)


@query(f"WITH {_KEYED} SELECT conversation_id, ply_start, ply_end, exchange_id, chars + 1 AS chars FROM k WHERE n = 1")
def exchange_batch_upsert(spark, d):
    """New texts over old ones; the old exchange_id stays."""
    x = table(spark, d, "exchanges").where("exchange_id is not null and conversation_id is not null")
    keys = ["conversation_id", "ply_start", "ply_end"]
    old = M.latest(x, keys, F.col("exchange_id")).select(*keys, "exchange_id", F.length("exchange_text").alias("chars"))
    new = old.withColumns({"exchange_id": F.lit("other"), "chars": F.col("chars") + 1})
    return M.upsert(old, new, keys, keep=("exchange_id",))


@query("""WITH f AS (SELECT facet_id, min(last_seen) AS lo, max(last_seen) AS hi, count(last_seen) AS n FROM hierarchical_facets WHERE facet_id IS NOT NULL GROUP BY 1) SELECT facet_id, CASE WHEN lo IS NULL OR lo < TIMESTAMP '2025-01-01' THEN TIMESTAMP '2025-01-01' ELSE lo END AS last_seen, CASE WHEN lo IS NULL OR lo < TIMESTAMP '2025-01-01' THEN -1 ELSE 0 END AS project_count FROM f""")
def facet_update_newer(spark, d):
    old = table(spark, d, "hierarchical_facets").where("facet_id is not null").groupBy("facet_id").agg(F.min("last_seen").alias("last_seen"), F.lit(0).alias("project_count"))
    new = old.select("facet_id", F.lit("2025-01-01").cast("timestamp_ntz").alias("last_seen"), F.lit(-1).alias("project_count"))
    return M.update_newer(old, new, "facet_id", "last_seen", ["project_count"])


_GONE = "gone AS (SELECT DISTINCT conversation_id FROM source_file_state WHERE lower(status) = 'invalid' AND conversation_id IS NOT NULL)"


def _gone(spark, d):
    return table(spark, d, "source_file_state").where("lower(status) = 'invalid' and conversation_id is not null").select("conversation_id").distinct()


@query(f"WITH {EXCH}, {_GONE} SELECT exchange_id FROM exch WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT conversation_id FROM gone)")
def cascade_delete_exchanges(spark, d):
    return M.delete(exchanges(spark, d), _gone(spark, d), ["conversation_id"]).select("exchange_id")


@query(f"WITH {EXCH}, {_GONE} SELECT exchange_id FROM exch WHERE NOT (conversation_id IS NOT NULL AND conversation_id IN (SELECT conversation_id FROM gone) AND coalesce(ply_start >= 2, false))")
def cascade_delete_from_ply(spark, d):
    return M.delete(exchanges(spark, d), _gone(spark, d), ["conversation_id"], F.col("ply_start") >= 2).select("exchange_id")


@query("WITH " + _GONE + " SELECT 'conversations' AS table_name, count(*)::BIGINT AS deleted FROM conversations WHERE conversation_id IN (SELECT conversation_id FROM gone) UNION ALL SELECT 'exchanges', count(*)::BIGINT FROM exchanges WHERE conversation_id IN (SELECT conversation_id FROM gone) UNION ALL SELECT 'messages', count(*)::BIGINT FROM messages WHERE conversation_id IN (SELECT conversation_id FROM gone)")
def cascade_delete_counts(spark, d):
    return M.deleted_counts({t: table(spark, d, t) for t in ("conversations", "exchanges", "messages")}, _gone(spark, d), ["conversation_id"])


@query(f"WITH {EXCH}, {_GONE} SELECT exchange_id, conversation_id FROM exch WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT conversation_id FROM conversations WHERE conversation_id IS NOT NULL)")
def orphan_detect(spark, d):
    c = table(spark, d, "conversations").where("conversation_id is not null").select("conversation_id")
    return exchanges(spark, d).where("conversation_id is not null").join(c, "conversation_id", "left_anti").select("exchange_id", "conversation_id")


@query(f"WITH {_SEG} SELECT conversation_id, ply_start, ply_end::INT AS ply_end FROM seg WHERE (conversation_id, ply_start) NOT IN (SELECT (conversation_id, ply_start) FROM exchanges WHERE conversation_id IS NOT NULL AND ply_start IS NOT NULL)")
def pending_anti_join(spark, d):
    """Segments that no exchange has yet."""
    have = table(spark, d, "exchanges").where("conversation_id is not null and ply_start is not null").select("conversation_id", "ply_start").distinct()
    return SG.segments(SG.clean_messages(spark, d)).join(have, ["conversation_id", "ply_start"], "left_anti").select("conversation_id", "ply_start", "ply_end")


@query(f"WITH {STATE} SELECT file_path, lower(status) AS status, error_message FROM st WHERE lower(status) = 'invalid'")
def quarantine_read(spark, d):
    return states(spark, d).where("lower(status) = 'invalid'").select("file_path", F.lower("status").alias("status"), "error_message")


@query(f"WITH {STATE} SELECT file_path, CASE WHEN lower(status) = 'pending' THEN 'invalid' ELSE lower(status) END AS status FROM st WHERE lower(status) IS DISTINCT FROM 'invalid'")
def quarantine_mark_and_clear(spark, d):
    """Invalid files are cleared, then the pending ones are marked as invalid."""
    s = states(spark, d).select("file_path", F.lower("status").alias("status"))
    left = M.delete(s, s.where("status = 'invalid'"), ["file_path"])
    return M.upsert(left, left.where("status = 'pending'").withColumn("status", F.lit("invalid")), ["file_path"])


@query(f"WITH {STATE} SELECT file_path, error_message FROM st WHERE error_message IS NOT NULL AND NOT starts_with(error_message, 'line')")
def skip_list_clear(spark, d):
    """A list of skipped files without those of one kind of reason."""
    return states(spark, d).where(F.col("error_message").isNotNull() & ~F.col("error_message").startswith("line")).select("file_path", "error_message")


@query(f"WITH {CONV}, m AS (SELECT conversation_id, count(*)::INT AS n FROM (SELECT DISTINCT conversation_id, sequence FROM messages WHERE conversation_id IS NOT NULL AND sequence IS NOT NULL) GROUP BY 1) SELECT conversation_id, coalesce(m.n, message_count) AS message_count FROM conv LEFT JOIN m USING (conversation_id)")
def backfill_counts(spark, d):
    c = conversations(spark, d).select("conversation_id", "message_count")
    n = table(spark, d, "messages").where("conversation_id is not null and sequence is not null").select("conversation_id", "sequence").distinct().groupBy("conversation_id").agg(F.count("*").cast("int").alias("message_count"))
    return M.upsert(c, n.join(c.select("conversation_id"), "conversation_id", "left_semi"), ["conversation_id"])


@query("""WITH m AS (SELECT conversation_id, max(sequence) AS s FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1), x AS (SELECT DISTINCT conversation_id, exchange_id FROM exchanges WHERE conversation_id IS NOT NULL AND exchange_id IS NOT NULL)
SELECT x.conversation_id, x.exchange_id, (coalesce(m.s, -1) + row_number() OVER (PARTITION BY x.conversation_id ORDER BY exchange_id))::INT AS sequence FROM x LEFT JOIN m USING (conversation_id)""")
def append_offsets(spark, d):
    """Exchanges appended as messages: numbers go on after the largest of their conversation."""
    m = table(spark, d, "messages").where("conversation_id is not null").groupBy("conversation_id").agg(F.max("sequence").alias("sequence"))
    x = table(spark, d, "exchanges").where("conversation_id is not null and exchange_id is not null").select("conversation_id", "exchange_id").distinct()
    return M.appended(m, x, "conversation_id", "exchange_id")


@query(f"WITH {CONV} SELECT conversation_id, NULL::VARCHAR AS summary, 0 AS version FROM conv")
def migrated_columns(spark, d):
    from colloquy.sources.store import migrated

    c = migrated(conversations(spark, d).select("conversation_id"), {"summary": "string", "version": "int"})
    return c.withColumn("version", F.coalesce("version", F.lit(0)))
