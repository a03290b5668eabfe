"""Retrieval: BM25, vectors, normalisation, fusion, merging of layers, and scopes.

Scores are doubles. Every order ends with the id, so that results are the same in each run. Where an operator needs numbers of the whole corpus it takes them in one
aggregation of a single row; only rows of such a size are broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions import vectors as V


def _times(term: str) -> Column:
    return F.size(F.filter("tok", lambda w: w == term))


def bm25(docs: DataFrame, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75, tokens=T.words, okapi: bool = False, keep_zero: bool = False) -> DataFrame:
    """docs with `score` for the query terms. One pass counts the terms in each row, one aggregation of a single row has the statistics of the corpus.

    okapi: the inverse frequency may fall under 0 and is then a quarter of the mean; terms count as often as they are given."""
    terms = terms if okapi else list(dict.fromkeys(terms))
    if tokens is T.words:  # counted in the text itself, without making a list of its words
        low = F.lower(F.col(text))
        d = docs.withColumns({"dl": F.regexp_count(low, F.lit("[a-z0-9]+"))} | {f"tf{i}": F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")) for i, t in enumerate(map(re.escape, terms))})
    else:
        d = docs.withColumn("tok", tokens(F.col(text))).withColumn("dl", F.size("tok")).withColumns({f"tf{i}": _times(t) for i, t in enumerate(terms)}).drop("tok")
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    if okapi:
        raw = [F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in range(len(terms))]
        mean = reduce(lambda x, y: x + y, raw) / len(terms)
        idf = [F.when(r < 0, 0.25 * F.abs(mean)).otherwise(r) for r in raw]
    else:
        idf = [F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in range(len(terms))]
    stats = stats.select("avgdl", *[x.alias(f"idf{i}") for i, x in enumerate(idf)])
    part = lambda i: F.col(f"idf{i}") * (F.col(f"tf{i}") * (k1 + 1)) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    some = d if keep_zero else d.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    return some.crossJoin(F.broadcast(stats)).withColumn("score", reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))])).select(*docs.columns, "score")


def postings(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, term, tf, dl): the stored index of many queries; counts are combined before the shuffle."""
    t = docs.select(F.col(id_).alias("id"), T.words(F.col(text)).alias("tok"))
    return t.select("id", F.size("tok").alias("dl"), F.explode("tok").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_batch(docs: DataFrame, id_: str, text: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score): the k best of each query of (query_id, query), through postings filtered by the queries' terms before any shuffle of theirs."""
    q = queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("query")))).alias("term"))
    post = postings(docs, id_, text).join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
    stats = docs.select(F.size(T.words(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    s = post.join(df, "term").join(F.broadcast(q), "term").crossJoin(F.broadcast(stats))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = s.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def like_all(docs: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds every word of the query literally, in any case; the score is 1."""
    return docs.where(T.all_phrases(F.col(text), query.split())).withColumn("score", F.lit(1.0))


def nearest(vectors: DataFrame, query: DataFrame, embedding: str = "embedding", squared: bool = False) -> DataFrame:
    """vectors with `distance` and `score` to the one vector in query (a single row with `q`)."""
    d = V.squared_l2(F.col(embedding), F.col("q")) if squared else V.cosine_distance(F.col(embedding), F.col("q"))
    return vectors.crossJoin(F.broadcast(query.limit(1))).withColumn("distance", d).withColumn("score", V.nearness(F.col("distance"))).drop("q")


def top(df: DataFrame, k: int, id_: str, score: str = "score", ascending: bool = False) -> DataFrame:
    return df.orderBy(F.col(score).asc() if ascending else F.col(score).desc(), id_).limit(k)


def ranked(df: DataFrame, id_: str, score: str = "score") -> DataFrame:
    """df, already cut to its best rows, with rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), id_)))


def divisor(df: DataFrame, score: str = "score", least: int = 10) -> DataFrame:
    """One row with what scores are divided by: their 95th percentile from `least` rows on, else their maximum; 1 without rows, 1e-10 at least."""
    return df.agg(F.greatest(F.coalesce(F.when(F.count(score) >= least, F.expr(f"percentile({score}, 0.95)")).otherwise(F.max(score)), F.lit(1.0)), F.lit(1e-10)).alias("div"))


def normalised(df: DataFrame, score: str = "score", least: int = 10) -> DataFrame:
    """df, already cut to its best rows, with `norm`, its scores divided by the divisor, 1 at most. A window over the few rows, so that they are not computed twice."""
    w = Window.partitionBy(F.lit(1))
    div = F.greatest(F.when(F.count(score).over(w) >= least, F.expr(f"percentile({score}, 0.95)").over(w)).otherwise(F.max(score).over(w)), F.lit(1e-10))
    return df.withColumn("div", div).withColumn("norm", F.least(F.col(score) / F.col("div"), F.lit(1.0))).drop("div")


def rank_decay(rank: Column, decay: float = 0.1) -> Column:
    return 1 / (1 + decay * rank)


def best_per(df: DataFrame, key: str, id_: str, score: str = "score") -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), id_))).where("place = 1").drop("place")


def weighted(keyword: DataFrame, semantic: DataFrame, id_: str, keyword_weight: float, semantic_weight: float, both: float = 1.2) -> DataFrame:
    """(id, base): two result lists fused by weights, normalised scores and rank decay, raised where both lists have the row."""
    leg = lambda df, name: ranked(normalised(df), id_).select(id_, (F.col("norm") * rank_decay(F.col("rank"))).alias(name))
    j = leg(keyword, "kw").join(leg(semantic, "sem"), id_, "full_outer")
    base = keyword_weight * F.coalesce("kw", F.lit(0.0)) + semantic_weight * F.coalesce("sem", F.lit(0.0))
    return j.select(id_, (base * F.when(F.col("kw").isNotNull() & F.col("sem").isNotNull(), both).otherwise(1.0)).alias("base"))


def title_boost(df: DataFrame, title: str, query: str, factor: float = 2.0) -> DataFrame:
    """score = base, times factor where any word of the query is part of the title."""
    hit = reduce(lambda x, y: x | y, [F.coalesce(F.lower(F.col(title)).contains(w.lower()), F.lit(False)) for w in query.split()])
    return df.withColumn("score", F.col("base") * F.when(hit, factor).otherwise(1.0))


def combmnz(first: DataFrame, second: DataFrame, id_: str) -> DataFrame:
    """(id, score): the sum of both normalised scores times the number of lists that have the row."""
    leg = lambda df, name: normalised(df).select(id_, F.col("norm").alias(name))
    j = leg(first, "a").join(leg(second, "b"), id_, "full_outer").select(id_, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    return j.withColumn("score", (F.col("a") + F.col("b")) * ((F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int")))


def merged_layers(distilled: DataFrame, verbatim: DataFrame, key: str, weight_p: float = 0.5, weight_v: float = 0.5, both: float = 1.2, boosted: list[str] | None = None, project: str = "project_id", boost: float = 1.5) -> DataFrame:
    """(key, score, layers): the two layers by conversation; boosted: projects whose verbatim scores are raised (soft scope)."""
    v = verbatim
    if boosted is not None:
        v = v.withColumn("score", F.col("score") * F.when(F.col(project).isin(boosted), boost).otherwise(1.0))
    j = distilled.select(key, F.col("score").alias("p")).join(v.select(key, F.col("score").alias("v")), key, "full_outer")
    score = F.when(F.col("p").isNotNull() & F.col("v").isNotNull(), F.least((weight_p * F.col("p") + weight_v * F.col("v")) * both, F.lit(1.0))).when(F.col("p").isNotNull(), weight_p * F.col("p")).otherwise(weight_v * F.col("v"))
    return j.select(key, score.alias("score"), F.when(F.col("p").isNotNull() & F.col("v").isNotNull(), "both").when(F.col("p").isNotNull(), "distilled").otherwise("verbatim").alias("layers"))


def with_fallback(hits: DataFrame, project: str, scope: list[str], related: DataFrame, least: int = 3) -> DataFrame:
    """hits with `tier` of the first tier that has `least` rows: scoped, then related, then unscoped. One aggregation of a single row picks the tier."""
    r = related.select(F.col(project).alias("rp")).distinct().withColumn("is_related", F.lit(True))
    h = hits.join(F.broadcast(r.limit(1000)), hits[project] == F.col("rp"), "left").withColumn("scoped", F.coalesce(F.col(project).isin(scope), F.lit(False)))
    h = h.withColumn("near", F.col("scoped") | F.coalesce("is_related", F.lit(False))).drop("rp", "is_related")
    pick = h.agg(F.when(F.count(F.when(F.col("scoped"), 1)) >= least, "scoped").when(F.count(F.when(F.col("near"), 1)) >= least, "related").otherwise("unscoped").alias("tier"))
    h = h.crossJoin(F.broadcast(pick))
    keep = (F.col("tier") == "unscoped") | (F.col("tier") == "related") & F.col("near") | (F.col("tier") == "scoped") & F.col("scoped")
    return h.where(keep).drop("scoped", "near")


def agreement(a: DataFrame, b: DataFrame, id_: str, first: int = 5) -> DataFrame:
    """(shared, total, jaccard, top_overlap) of two ranked result lists (id, rank)."""
    j = a.select(id_, F.col("rank").alias("ra")).join(b.select(id_, F.col("rank").alias("rb")), id_, "full_outer")
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    top_ = both & (F.col("ra") <= first) & (F.col("rb") <= first)
    n = j.agg(F.count(F.when(both, 1)).alias("shared"), F.count("*").alias("total"), F.count(F.when(top_, 1)).alias("t"))
    return n.select("shared", "total", F.when(F.col("total") > 0, F.col("shared") / F.col("total")).otherwise(F.lit(0.0)).alias("jaccard"), (F.col("t") / first).alias("top_overlap"))
