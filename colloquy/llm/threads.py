"""Problem 3: rebuilding conversations from message rows.

Method: each message points to its parent, here the message before it in its conversation; parent pointers are resolved by iterative pointer jumping (every round
joins each unresolved pointer to the pointer of the row it points to, so that ceil(log2(depth)) rounds suffice). Rows whose parent is absent are orphans; rows still
unresolved after the last round that could resolve any lie on or behind a cycle. Root-to-leaf paths come out as ordered conversations, in parts of a bounded
number of messages, so that no conversation is ever gathered whole.

Rows with a NULL key are left out; repeats with equal role and content count once; a conversation known only from its header has no message and is dropped; extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import blank, cut, table

#: Messages in one part of an emitted conversation.
PART = 1000


def _hash(c: Column) -> list[Column]:
    return [F.xxhash64(c), F.xxhash64(F.lit(11), c)]


def resolved(nodes: DataFrame, node: Column, parent: Column, group: Column, most_rounds: int = 64) -> DataFrame:
    """(a, b, root_a, root_b, depth, state) for each node: a 128-bit key of the node and of its root, the number of its ancestors, and `whole`, `orphan` (its
    root's parent is absent) or `cycle`. group: a value that all nodes of one tree share; trees that are resolved take no part in later rounds."""
    (a, b), (pa, pb) = _hash(node), _hash(parent)
    n = nodes.select(a.alias("a"), b.alias("b"), F.when(parent.isNotNull(), pa).alias("pa"), F.when(parent.isNotNull(), pb).alias("pb"), F.xxhash64(group).alias("g")).dropDuplicates(["a", "b"])
    there = n.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.lit(True).alias("there"))
    t = n.join(there, ["pa", "pb"], "left")
    root = F.col("there").isNull()
    t = t.select(
        "a", "b", "g", F.when(root, F.col("a")).otherwise(F.col("pa")).alias("pa"), F.when(root, F.col("b")).otherwise(F.col("pb")).alias("pb"),
        F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("done"), (root & F.col("pa").isNotNull()).alias("orphan"),
    )
    t, finished, bound = cut(t), [], None
    for k in range(most_rounds):
        left = t.agg(F.count("*"), F.count(F.when(~F.col("done"), 1))).first()
        bound = max(1, left[0]).bit_length() + 1 if bound is None else bound
        if not left[1] or k > bound:
            break
        live = t.where("not done").select("g").distinct()
        if k:
            finished.append(t.join(live, "g", "left_anti"))
            t = t.join(live, "g", "left_semi")
        up = t.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("depth").alias("more"), F.col("done").alias("q_done"), F.col("orphan").alias("q_orphan"))
        moved = t.where("not done").join(up, ["pa", "pb"]).select("a", "b", "g", F.col("qa").alias("pa"), F.col("qb").alias("pb"), (F.col("depth") + F.col("more")).alias("depth"), F.col("q_done").alias("done"), F.col("q_orphan").alias("orphan"))
        t = cut(t.where("done").unionByName(moved))
    state = F.when(~F.col("done"), "cycle").when(F.col("orphan"), "orphan").otherwise("whole")
    return reduce(DataFrame.unionByName, finished, t).select("a", "b", F.col("pa").alias("root_a"), F.col("pb").alias("root_b"), "depth", state.alias("state"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """One row for each (conversation_id, sequence): its role after look-up (NULL if unknown), whether it has two roles or contents, whether its content is blank."""
    m = table(spark, d, "messages").where("conversation_id is not null and sequence is not null")
    a = table(spark, d, "role_aliases").where("alias is not null").select(F.lower(F.trim("alias")).alias("alias"), F.col("role").alias("known")).dropDuplicates(["alias"])
    m = m.select("conversation_id", "sequence", F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", "")).alias("alias"), F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(5), "content").alias("h2"), blank(F.col("content")).alias("blank"), F.col("content").isNull().alias("absent"))
    m = m.join(F.broadcast(a), "alias", "left").withColumn("as", F.coalesce("known", F.concat(F.lit("?"), F.coalesce("alias", F.lit("")))))
    content = F.struct("absent", "h1", "h2")
    return m.groupBy("conversation_id", "sequence").agg(
        ((F.min(content) != F.max(content)) | (F.min("as") != F.max("as"))).alias("mixed"), F.max(F.col("known").isNull()).alias("unknown"), F.max("known").alias("role"), F.min("blank").alias("blank"),
    )


def placed(m: DataFrame) -> DataFrame:
    """m with the depth of each message below its root and the state of its thread."""
    key = F.struct("conversation_id", "sequence")
    parent = F.when(F.col("sequence") != 0, F.struct(F.col("conversation_id").alias("conversation_id"), (F.col("sequence") - 1).alias("sequence")))
    at = resolved(m, key, parent, F.col("conversation_id"))
    a, b = _hash(key)
    return m.withColumn("a", a).withColumn("b", b).join(at, ["a", "b"]).drop("a", "b", "root_a", "root_b")


def judged(m: DataFrame) -> DataFrame:
    """(conversation_id, dropped) from placed messages."""
    said = F.max(F.when(~F.col("blank") & F.col("role").isin("user", "assistant"), F.struct("sequence", "role")))
    return m.groupBy("conversation_id").agg(
        (
            F.max("mixed") | F.max(F.col("state") != "whole") | F.max("unknown") | ~F.max(F.coalesce(~F.col("blank") & (F.col("role") == "user"), F.lit(False))) | F.coalesce(said["role"] != "assistant", F.lit(True))
        ).alias("dropped")
    )


def found(spark: SparkSession, d: str) -> DataFrame:
    """(conversation_id) of the conversations that are broken, empty or without a reply."""
    of = judged(placed(cut(messages(spark, d))))
    headers = table(spark, d, "conversations").where("conversation_id is not null").select("conversation_id", F.lit(None).cast("boolean").alias("dropped"))
    return of.unionAll(headers).groupBy("conversation_id").agg(F.coalesce(F.max("dropped"), F.lit(True)).alias("dropped")).where("dropped").select("conversation_id")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """(conversation_id, part, turns): the kept conversations as ordered lists of (position, role, content), PART messages a row."""
    m = cut(placed(cut(messages(spark, d))))
    kept = judged(m).where("not dropped").select("conversation_id")
    text = table(spark, d, "messages").where("conversation_id is not null and sequence is not null").select("conversation_id", "sequence", "content").dropDuplicates(["conversation_id", "sequence"])
    rows = m.join(kept, "conversation_id", "left_semi").select("conversation_id", "sequence", F.col("depth").cast("int").alias("position"), "role").join(text, ["conversation_id", "sequence"])
    parts = rows.groupBy("conversation_id", F.floor(F.col("position") / PART).cast("int").alias("part"))
    return parts.agg(F.sort_array(F.collect_list(F.struct("position", "role", "content"))).alias("turns"))
