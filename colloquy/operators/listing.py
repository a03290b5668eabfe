"""Filters, listings and reports over conversations and their relatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources import transcripts

ORDERS = {
    "length": (F.desc, "message_count"),
    "date_newest": (F.desc, "updated_at"),
    "date_oldest": (F.asc, "updated_at"),
    "title": (F.asc, "title"),
}


def _ts(x: str) -> Column:
    return F.lit(x).cast("timestamp_ntz")


def exists_each(asked: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """asked with `present`."""
    have = there.select(F.col(key)).distinct().withColumn("_p", F.lit(True))
    return asked.join(have, key, "left").select(*asked.columns, F.coalesce("_p", F.lit(False)).alias("present"))


def search_filters(c: DataFrame, since: str | None = None, until: str | None = None, min_messages: int = 0, projects: list[str] | None = None) -> DataFrame:
    """The filters of a search: rows without a date pass; both ends belong to the window."""
    if since:
        c = c.where(F.col("updated_at").isNull() | (F.col("updated_at") >= _ts(since)))
    if until:
        c = c.where(F.col("updated_at").isNull() | (F.col("updated_at") <= _ts(until)))
    if projects:
        c = c.where(F.col("project_id").isin(projects))
    return c.where(F.coalesce("message_count", F.lit(0)) >= min_messages) if min_messages else c


def listed(c: DataFrame, since: str | None = None, until: str | None = None, project: str | None = None) -> DataFrame:
    """The filters of a listing: conversations with messages; the last day belongs to it whole; rows without a date do not pass a date filter."""
    c = c.where("message_count > 0")
    if since:
        c = c.where(F.col("updated_at") >= _ts(since))
    if until:
        c = c.where(F.col("updated_at") < _ts(until) + F.expr("interval 1 day"))
    return c.where(F.col("project_id") == project) if project else c


def page(c: DataFrame, order: str, limit: int, offset: int = 0, id_: str = "conversation_id") -> DataFrame:
    """One page by one of ORDERS; ties go by id."""
    if order not in ORDERS:
        raise ValueError(f"order is one of {sorted(ORDERS)}")
    fn, column = ORDERS[order]
    by = F.col(column).desc_nulls_last() if fn is F.desc else F.col(column).asc_nulls_last()
    return c.orderBy(by, id_).offset(offset).limit(limit)


def preset(stamp: Column, name: str, now: str, first: str | None = None, last: str | None = None) -> Column:
    """Whether stamp lies in today, week, month or custom (whose last day belongs to it); now is a parameter."""
    n = _ts(now)
    if name == "today":
        return (stamp >= F.date_trunc("day", n).cast("timestamp_ntz")) & (stamp <= n)
    if name in ("week", "month"):
        return (stamp >= n - F.expr(f"interval {7 if name == 'week' else 30} days")) & (stamp <= n)
    if name != "custom":
        raise ValueError("preset is today, week, month or custom")
    out = F.lit(True)
    if first:
        out = out & (stamp >= _ts(first))
    return out & (stamp <= _ts(last) + F.expr("interval 1 day")) if last else out


def keyword_rooms(rooms: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rooms of which any column holds text literally, in any case."""
    return rooms.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(text.lower()) for c in columns]))


def api_row(c: DataFrame) -> DataFrame:
    low = F.lower("file_path")
    source = F.when(low.contains("/home/") | low.contains("wsl"), "WSL").otherwise("WIN")
    return c.select("conversation_id", F.coalesce("title", F.lit("Untitled")).alias("title"), source.alias("source"), transcripts.dialect(F.col("file_path"), F.lit(None).cast("string")).alias("tool"), F.coalesce("message_count", F.lit(0)).cast("long").alias("message_count"))


def statistics(c: DataFrame) -> DataFrame:
    return c.agg(
        F.count("*").alias("conversations"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"), F.round(F.coalesce(F.avg("message_count"), F.lit(0.0)), 6).alias("average"), F.countDistinct("project_id").alias("projects"), F.min("updated_at").alias("earliest"), F.max("updated_at").alias("latest"),
    )


def per_project(c: DataFrame) -> DataFrame:
    g = c.groupBy(F.coalesce("project_id", F.lit("none")).alias("project_id")).agg(F.count("*").alias("conversations"), F.sum(F.coalesce("message_count", F.lit(0))).alias("messages"))
    return g.orderBy(F.desc("conversations"), "project_id")


def status_report(s: DataFrame) -> DataFrame:
    g = s.groupBy(F.lower(F.coalesce("status", F.lit("unknown"))).alias("status"))
    return g.agg(F.count("*").alias("files"), F.count("error_message").alias("with_error"), F.min("error_message").alias("example"))
