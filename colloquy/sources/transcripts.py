"""Transcripts in the three dialects of agents, as conversations and messages.

Lines come from `colloquy.sources.lines` (or any frame of file_path, line_number, line), whole documents from `read_documents`. `POLICIES` says what a bad line does:
`reject` leaves its whole file out, `skip` only the line.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.core import BLANK
from colloquy.functions import text as T
from colloquy.sources import lines as L

# What discovery passes over, and prompts that are not conversations.
EXCLUDED_DIRS = ("plugins", "hooks", "commands", "todos", "settings", "usage-sessions", "telemetry", "sessions", "_corrupt_jsonls", "plans", "worktrees")
EXCLUDED_FILES = (".credentials.json", "stats-cache.json", "settings.json", "settings.local.json", "settings.backup.json", "history.jsonl", "sessions-index.json", "mcp-needs-auth-cache.json")
PROMPT_PREFIXES = [
    "Distill this conversation exchange into JSON",
    "Distill the conversation exchange below into JSON",
    "You are a strict relevance assessor",
    "Your task is to create a detailed summary of the conversation so far",
    "Your task is to create a detailed summary of the RECENT portion",
]
POLICIES = ("reject", "skip")


def discover(roots: list[str], endings: tuple[str, ...] = (".jsonl", ".json")) -> list[str]:
    """The transcript files under the roots: .jsonl at any depth, .json directly in a root. Links are not followed."""
    out = []
    for root in roots:
        for at, dirs, files in os.walk(root, followlinks=False):
            dirs[:] = sorted(x for x in dirs if x not in EXCLUDED_DIRS and not os.path.islink(os.path.join(at, x)))
            for f in sorted(files):
                p = os.path.join(at, f)
                if f in EXCLUDED_FILES or os.path.islink(p):
                    continue
                if f.endswith(".jsonl") and ".jsonl" in endings or f.endswith(".json") and ".json" in endings and at == root:
                    out.append(p)
    return out


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_path, line_number, line) of text files. Numbers come from the place of a line in its file's partition order, without gathering files: each file is one
    row of at most its own size."""
    t = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file_path"), "value")
    return t.select("file_path", F.posexplode(F.split("value", "\n")).alias("n", "line")).select("file_path", (F.col("n") + 1).alias("line_number"), "line")


def parquet_tolerant(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files, without those that are broken."""
    return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(*paths)


def checked(lines: DataFrame) -> DataFrame:
    """Lines as nullable text with their issues (blank lines and headers are left out)."""
    return L.issues(L.as_text(lines)).where("dialect != 'header'")


def accepted_files(text: DataFrame, policy: str = "reject") -> DataFrame:
    """(file_path): files with a valid line, under `reject` without any bad one."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    n = text.groupBy("file_path").agg(F.count(F.when(F.size("issues") > 0, 1)).alias("bad"), F.count(F.when(F.size("issues") == 0, 1)).alias("good"))
    return n.where("good > 0" + (" and bad = 0" if policy == "reject" else "")).select("file_path")


def dialect(path: Column, first_type: Column) -> Column:
    """The dialect of a file by its path, else by the type of its first record."""
    return F.when(path.contains("/.codex/"), "B").when(path.contains("/projects/"), "A").when(path.endswith(".json"), "C").when(first_type.isin("session_meta", "response_item"), "B").otherwise("A")


def messages(text: DataFrame, policy: str = "reject") -> DataFrame:
    """(file_path, sequence, ply_index, role, content, timestamp_us, has_code) of dialects A and B: text blocks joined by blank lines, empty ones dropped.

    Numbers run within a file: a file is one transcript, written by one session."""
    ok = text.join(accepted_files(text, policy), "file_path", "left_semi").where("size(issues) = 0 and dialect = 'jsonl'")
    m = ok.where(F.col("j_type").isin("user", "assistant", "response_item") & F.col("j_role").isNotNull())
    content = F.coalesce("j_content", F.lit(""))
    m = m.where(~content.rlike(BLANK))
    w = Window.partitionBy("file_path").orderBy("line_number")
    return m.select("file_path", (F.row_number().over(w) - 1).cast("int").alias("sequence"), (F.col("line_number") - 1).alias("ply_index"), F.col("j_role").alias("role"), content.alias("content"), L.iso_micros(F.col("j_timestamp")).alias("timestamp_us"), (F.size(T.code_blocks(content)) > 0).alias("has_code"))


def folders(text: DataFrame) -> DataFrame:
    """(file_path, cwd): the first working folder that a file names."""
    return text.where("j_cwd is not null").groupBy("file_path").agg(F.min_by("j_cwd", "line_number").alias("cwd"))


def rollup(msgs: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, title, message_count, first_us, last_us): the title is the first 100 characters of the first message."""
    return msgs.groupBy(key).agg(F.substring(F.min_by("content", "sequence"), 1, 100).alias("title"), F.count("*").alias("message_count"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"))


def last_exchange(msgs: DataFrame, key: str = "file_path", most: int = 4000) -> DataFrame:
    """(key, user_text, assistant_text): the last message of each role, cut at `most` characters."""
    last = lambda role: F.substring(F.max_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("sequence"))), 1, most)
    return msgs.groupBy(key).agg(last("user").alias("user_text"), last("assistant").alias("assistant_text"))


def internal_prompts(msgs: DataFrame, key: str, prefixes: list[str] = PROMPT_PREFIXES) -> DataFrame:
    """(key) whose first non-blank user message begins with one of the prefixes."""
    first = msgs.where((F.col("role") == "user") & ~F.col("content").rlike(BLANK)).groupBy(key).agg(F.min_by("content", "sequence").alias("first"))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("first").startswith(p)
    return first.where(hit).select(key)


def single_turn(text: DataFrame) -> DataFrame:
    """(file_path) of files with one user and one assistant record, no snapshot and no use of a tool."""
    n = text.where("size(issues) = 0").groupBy("file_path").agg(
        F.count(F.when(F.col("j_type") == "user", 1)).alias("u"), F.count(F.when(F.col("j_type") == "assistant", 1)).alias("a"), F.count(F.when(F.col("j_type") == "file-history-snapshot", 1)).alias("s"),
        F.count(F.when(F.col("content_json").rlike(r'"type": ?"tool_use"'), 1)).alias("t"),
    )
    return n.where("u = 1 and a = 1 and s = 0 and t = 0").select("file_path")


DOCUMENT = "metadata struct<session_id:string,start_time:string,end_time:string,environment:struct<working_directory:string>>, messages array<struct<role:string,content:string>>"


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_path, session_id, sequence, role, content, timestamp) of dialect C, one JSON document a file; empty messages are dropped, all have the start time."""
    t = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file_path"), F.from_json("value", DOCUMENT).alias("d"))
    kept = F.filter("d.messages", lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    return t.select("file_path", F.col("d.metadata.session_id").alias("session_id"), F.col("d.metadata.start_time").alias("timestamp"), F.posexplode(kept).alias("sequence", "m")).select("file_path", "session_id", "sequence", "m.role", "m.content", "timestamp")


def history_documents(history: DataFrame) -> DataFrame:
    """(file_path, document): a history of lines `role: text` as one document of dialect C; lines without a role go on the message before."""
    h = history.withColumn("role", F.regexp_extract("line", r"^(user|assistant):", 1)).withColumn("starts", (F.col("role") != "").cast("int"))
    w = Window.partitionBy("file_path").orderBy("line_number")
    h = h.withColumn("g", F.sum("starts").over(w)).where("g > 0").withColumn("text", F.when(F.col("starts") == 1, F.trim(F.regexp_replace("line", r"^(?:user|assistant):", ""))).otherwise(F.col("line")))
    m = h.groupBy("file_path", "g").agg(F.max("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda x: x["text"]), "\n").alias("content"))
    doc = m.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("g", "role", "content"))).alias("ms"))
    return doc.select("file_path", F.to_json(F.struct(F.struct(T.basename(F.col("file_path")).alias("session_id")).alias("metadata"), F.transform("ms", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("document"))
