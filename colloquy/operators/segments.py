"""Messages into exchanges.

Running values over a conversation are taken in blocks of the sequence: within a block by a window, across blocks from one small row a block. So a conversation
that holds a tenth of all messages is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.core import table
from colloquy.functions import text as T

BLOCK, MAX_PLY, MIN_CHARS = 512, 20, 50


def running(df: DataFrame, key: str, order: str, name: str, value: Column, how: str, block: int = BLOCK) -> DataFrame:
    """df with `name`: the max or sum of value over the earlier rows of the key."""
    fn = F.max if how == "max" else F.sum
    d = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block))
    inside = fn("_v").over(Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sums = d.groupBy(key, "_b").agg(fn("_v").alias("_s"))
    sums = sums.withColumn("_c", fn("_s").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    d = d.withColumn("_i", inside).join(sums, [key, "_b"])
    both = F.greatest("_i", "_c") if how == "max" else F.coalesce("_i", F.lit(0)) + F.coalesce("_c", F.lit(0))
    return d.withColumn(name, both).drop("_v", "_b", "_i", "_c")


def clean_messages(spark: SparkSession, d: str) -> DataFrame:
    """One row for each (conversation_id, sequence): roles looked up (unknown roles are NULL), the least content of several, NULL as empty."""
    m = table(spark, d, "messages").where("conversation_id is not null and sequence is not null")
    a = table(spark, d, "role_aliases").select(F.lower(F.trim("alias")).alias("alias"), F.col("role").alias("known"))
    m = m.withColumn("alias", F.lower(F.trim("role"))).join(F.broadcast(a), "alias", "left")
    return m.groupBy("conversation_id", "sequence").agg(F.coalesce(F.min("content"), F.lit("")).alias("content"), F.min("known").alias("role"))


def grouped(m: DataFrame, key: str = "conversation_id") -> DataFrame:
    """m with `gid`: a user message after an answer begins a new group."""
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    m = running(m, key, "sequence", "la", F.when(~user & (F.length("content") > 0), F.col("sequence")), "max")
    m = running(m, key, "sequence", "lu", F.when(user, F.col("sequence")), "max")
    begins = user & F.col("la").isNotNull() & (F.col("la") > F.coalesce("lu", F.lit(-1)))
    m = m.withColumn("begins", begins.cast("int"))
    return running(m, key, "sequence", "gid", F.col("begins"), "sum").withColumn("gid", F.col("gid") + F.col("begins")).drop("la", "lu", "begins")


def segments(m: DataFrame, max_ply: int = MAX_PLY, min_chars: int = MIN_CHARS) -> DataFrame:
    """(conversation_id, ply_start, ply_end) of at most max_ply messages, from groups of min_chars characters that have some by the user."""
    g = grouped(m).groupBy("conversation_id", "gid").agg(
        F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.sum(F.length("content")).alias("chars"), F.sum(F.when(F.col("role") == "user", F.length("content")).otherwise(0)).alias("user_chars"),
    )
    g = g.where(f"chars >= {min_chars} and user_chars > 0").select("conversation_id", "last", F.explode(F.sequence("first", "last", F.lit(max_ply))).alias("ply_start"))
    return g.select("conversation_id", "ply_start", F.least(F.col("ply_start") + max_ply - 1, F.col("last")).alias("ply_end"))


def exchange_texts(m: DataFrame, seg: DataFrame, max_ply: int = MAX_PLY) -> DataFrame:
    """seg with the text of its messages as `role: content` by blank lines, and a stable id. The range join is an equal join: a message lies in the segment that
    covers it, and every segment is listed by each of its at most max_ply plies."""
    each = seg.withColumn("sequence", F.explode(F.sequence("ply_start", "ply_end")))
    rows = each.join(m.where("content != ''"), ["conversation_id", "sequence"])
    line = F.struct("sequence", F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), F.col("content")).alias("line"))
    t = rows.groupBy("conversation_id", "ply_start", "ply_end").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return t.select(T.exchange_id(F.col("conversation_id"), F.col("ply_start"), F.col("ply_end")).alias("exchange_id"), "conversation_id", "ply_start", "ply_end", F.array_join("lines.line", "\n\n").alias("exchange_text"))
