"""Shared by the query modules: the registry, and views of the tables with one row a key, for the library and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import table
from colloquy.operators import mutations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function by its name, with the SQL that gives the same rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each conversation."""
    c = table(spark, d, "conversations").where("conversation_id is not null")
    return mutations.latest(c, ["conversation_id"], F.col("indexed_at").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("title").asc_nulls_first())


CONV = """conv AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY indexed_at DESC NULLS LAST, updated_at DESC NULLS LAST, title NULLS FIRST) AS rn
  FROM conversations WHERE conversation_id IS NOT NULL) WHERE rn = 1)"""


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each exchange."""
    x = table(spark, d, "exchanges").where("exchange_id is not null")
    return mutations.latest(x, ["exchange_id"], F.col("created_at").desc_nulls_last(), F.col("project_id").asc_nulls_first())


EXCH = """exch AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY created_at DESC NULLS LAST, project_id NULLS FIRST) AS rn
  FROM exchanges WHERE exchange_id IS NOT NULL) WHERE rn = 1)"""


def states(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each source file."""
    s = table(spark, d, "source_file_state").where("file_path is not null")
    return mutations.latest(s, ["file_path"], F.col("updated_at").desc_nulls_last(), F.col("status").asc_nulls_first(), F.col("mtime_ns").asc_nulls_first())


STATE = """st AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC NULLS LAST, status NULLS FIRST, mtime_ns NULLS FIRST) AS rn
  FROM source_file_state WHERE file_path IS NOT NULL) WHERE rn = 1)"""


def facets(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each facet with a usable embedding."""
    from colloquy.functions import vectors as V

    f = table(spark, d, "hierarchical_facets").where("facet_id is not null").where(V.usable(F.col("embedding"), 64))
    return mutations.latest(f, ["facet_id"], F.col("last_seen").desc_nulls_last(), F.col("project_count").asc_nulls_first())


FACET = """fac AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY facet_id ORDER BY last_seen DESC NULLS LAST, project_count NULLS FIRST) AS rn
  FROM hierarchical_facets WHERE facet_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE rn = 1)"""
# the facet whose vector stands for the query's
FACET_Q = "q AS (SELECT embedding AS qv FROM fac ORDER BY facet_id LIMIT 1)"
DOC_Q = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"


def facet_query(f: DataFrame) -> DataFrame:
    return f.orderBy("facet_id").limit(1).select(F.col("embedding").alias("q"))


def doc_query(spark: SparkSession, d: str) -> DataFrame:
    """The vector that stands for the query's."""
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def msgs_sql() -> str:
    return """msgs AS (SELECT m.conversation_id, m.sequence, coalesce(min(m.content), '') AS content, min(a.role) AS role FROM messages m
  LEFT JOIN role_aliases a ON lower(trim(m.role)) = lower(trim(a.alias)) WHERE m.conversation_id IS NOT NULL AND m.sequence IS NOT NULL GROUP BY 1, 2)"""


BLANK_SQL = "regexp_full_match(coalesce({0}, ''), '[\\s\\x{{180e}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}\\p{{Z}}\\x{{85}}]*')"
