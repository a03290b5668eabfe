"""Facets: short names of files, rooms and projects, by which a query is routed to projects.

A facet may be shared by very many projects. Projects are kept as rows of an edge table and counted; a list of projects is made only for facets of few projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T

# Name parts that say nothing of a project, and the weight of each level of a path.
STOP_PARTS = ["projects", "home", "tmp", "mnt", "users", "data", "subtask", "workspaces", "benchmark", "var", "opt"]
FULL, DIRECTORY, BASENAME = 3.0, 2.0, 1.0
FEW = 3


def path_facets(edges: DataFrame, path: str = "path") -> DataFrame:
    """edges with facet_type, facet_level, facet_text and weight: up to three rows a path (whole, folder, name)."""
    p = F.col(path)
    row = lambda level, text, weight, ok: F.when(ok, F.struct(F.lit("file").alias("facet_type"), F.lit(level).alias("facet_level"), F.lower(text).alias("facet_text"), F.lit(weight).alias("weight")))
    three = F.array_compact(F.array(row("full", p, FULL, F.length(p) > 3), row("directory", F.concat(T.parent(p), F.lit("/*")), DIRECTORY, T.parent(p) != ""), row("basename", T.basename(p), BASENAME, F.length(T.basename(p)) > 3)))
    return edges.withColumn("_f", F.explode(three)).select(*edges.columns, "_f.*")


def project_parts(projects: DataFrame, project: str = "project_id") -> DataFrame:
    """(project_id, facet_type, facet_level, facet_text, weight): the parts of each project's name that say something."""
    parts = F.filter(F.split(F.lower(F.col(project)), "[-_]+"), lambda t: (F.length(t) > 2) & ~t.isin(STOP_PARTS))
    return projects.select(F.col(project).alias("project_id"), F.explode(F.array_distinct(parts)).alias("facet_text")).select("project_id", F.lit("project").alias("facet_type"), F.lit("full").alias("facet_level"), "facet_text", F.lit(1.0).alias("weight"))


def counted(edges: DataFrame) -> DataFrame:
    """(facet_id, facet_type, facet_level, facet_text, weight, project_count, weighted_count, last_seen, project_ids) from edges with project_id and seen; project_ids only where there are few."""
    keys = ["facet_type", "facet_level", "facet_text"]
    pairs = edges.groupBy(*keys, "project_id").agg(F.max("weight").alias("weight"), F.max("seen").alias("seen"))
    f = pairs.groupBy(*keys).agg(F.max("weight").alias("weight"), F.count("project_id").cast("int").alias("project_count"), F.max("seen").alias("last_seen"))
    few = pairs.where("project_id is not null").join(f.where(F.col("project_count") <= FEW).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list("project_id")).alias("project_ids"))
    f = f.join(few, keys, "left").withColumn("weighted_count", F.col("weight") / (1 + F.col("project_count")))
    return f.select(T.level_facet_id(*[F.col(k) for k in keys]).alias("facet_id"), *keys, "weight", "project_count", "weighted_count", "last_seen", "project_ids")


def aged(similarity: Column, last_seen: Column, now: Column, rate: float = 0.01) -> Column:
    """Similarity that falls off by days since last_seen; without a date it stays."""
    days = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_seen.cast("timestamp"))) / 86400e6, F.lit(0.0))
    return similarity * F.coalesce(F.exp(-rate * days), F.lit(1.0))


def votes(hits: DataFrame, vote: Column, least: float = 0.6) -> DataFrame:
    """(project_id, votes, total, confidence, winner): the votes of facet hits for the projects they name; the winner has the most and at least that share."""
    v = hits.select(F.explode("project_ids").alias("project_id"), vote.alias("v")).groupBy("project_id").agg(F.sum("v").alias("votes"))
    # few rows: the projects of some hits
    t = v.agg(F.sum("votes").alias("total"))
    v = v.crossJoin(F.broadcast(t)).withColumn("confidence", F.when(F.col("total") > 0, F.col("votes") / F.col("total")).otherwise(F.lit(0.0)))
    first = F.row_number().over(Window.orderBy(F.round("votes", 9).desc(), "project_id")) == 1
    return v.withColumn("winner", first & (F.col("confidence") >= least))
