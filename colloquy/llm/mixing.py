"""Problem 9: mixing sources to target weights.

Method: Poisson replication. A hash of (seed, document) gives each document a uniform number; the inverse of the Poisson distribution with the rate of its source
turns it into a count of copies, which is cut at the source's max_repeats; documents are exploded by their counts and put in a global order by hash.

The number of copies of one document rises with the rate at fixed points, so the rate of each source is not the mean but the one at which its drawn tokens reach
its budget: the points are summed by rate in a histogram of BINS, refined once, which corrects for the cut at max_repeats and for chance. The whole is the largest
for which no source with documents falls short of its share. A source without documents cannot be reached: its actual share is 0 and the report says so.

NULL texts, texts of no token and documents of sources without a target are not used; a target of 0, NULL or with max_repeats under 1 draws nothing; repeated
targets of a source count once, the largest; equal hashes go by doc_id; extra columns are not used; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import cut, map_slices, table
from colloquy.llm import tokens

SEED, BINS = 17, 4096


def rates(u: np.ndarray, k: int) -> np.ndarray:
    """The Poisson rates at which documents with uniform numbers u get their k-th copy: P(X <= k - 1) = 1 - u falls through there. By bisection."""
    low, high = np.zeros(len(u)), np.full(len(u), k + 40.0 + 12 * np.sqrt(k))
    for _ in range(60):
        rate = (low + high) / 2
        term, below = np.exp(-rate), np.exp(-rate)
        for i in range(1, k):
            term = term * rate / i
            below = below + term
        more = below > u
        low, high = np.where(more, rate, low), np.where(more, high, rate)
    return (low + high) / 2


def drawn(docs: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents in the mixture."""
    goal = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    d = docs.where("source is not null and doc_id is not null").select("doc_id", "source", "text").join(F.broadcast(goal.select("source")), "source", "left_semi")
    sizes = cut(tokens.sized(d, "text", vocabulary).where("tokens > 0"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have"))
    # one row a source of the fixed table of targets
    per = [r.asDict() for r in goal.join(have, "source").collect()]
    if not per:
        return sizes.select("doc_id", "source", "tokens", F.lit(1).alias("copies")).where("false")
    whole = min(r["have"] * r["most"] / r["share"] for r in per)
    budget = {r["source"]: whole * r["share"] for r in per}
    plan = docs.sparkSession.createDataFrame([(r["source"], int(r["most"]), float(budget[r["source"]])) for r in per], "source string, most int, budget double")

    def points(rows: list[dict]) -> list[dict]:
        u = np.array([r["u"] for r in rows])
        most = max(r["most"] for r in rows)
        at = [rates(u, k) for k in range(1, most + 1)]
        return [{"doc_id": r["doc_id"], "source": r["source"], "tokens": r["tokens"], "rates": [float(at[k][i]) for k in range(r["most"])], "budget": r["budget"]} for i, r in enumerate(rows)]

    # uniform in (0, 1): the low 52 bits of a hash
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = cut(map_slices(sizes.join(F.broadcast(plan), "source").withColumn("u", u), points, "doc_id bigint, source string, tokens bigint, rates array<double>, budget double", 2048))
    each = p.select("source", "budget", "tokens", F.explode("rates").alias("rate"))
    # the rate of each source at which its tokens reach the budget: by bins, then by bins of the bin that passes it
    low, step, base = {s: 0.0 for s in budget}, {s: 128.0 / BINS for s in budget}, {s: 0.0 for s in budget}
    for turn in range(3):
        now = docs.sparkSession.createDataFrame([(s, low[s], step[s]) for s in budget], "source string, low double, step double")
        binned = each.join(F.broadcast(now), "source").where("rate >= low and rate < low + step * " + str(BINS)).groupBy("source", F.floor((F.col("rate") - F.col("low")) / F.col("step")).alias("bin")).agg(F.sum("tokens").alias("t"))
        got: dict[str, list] = {s: [] for s in budget}
        for r in binned.collect():  # at most BINS rows a source
            got[r["source"]].append((r["bin"], r["t"]))
        for s in budget:
            total, at = base[s], BINS
            for b, t in sorted(got[s]):
                if total + t > budget[s] * (1 + 1e-6):
                    # the draw that passes the budget is taken if that comes nearer to it
                    at = b + (turn == 2 and total + t - budget[s] < budget[s] - total)
                    break
                total += t
            base[s], low[s], step[s] = total, low[s] + at * step[s], step[s] / BINS
    final = docs.sparkSession.createDataFrame([(s, low[s]) for s in budget], "source string, rate double")
    out = p.join(F.broadcast(final), "source").withColumn("copies", F.size(F.filter("rates", lambda x: x < F.col("rate"))))
    return out.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def mixture(spark: SparkSession, d: str) -> DataFrame:
    """(position key, doc_id, copy, source, tokens): the mixture, in the global order of `shuffle_key`."""
    got = drawn(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    each = got.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.withColumn("shuffle_key", F.xxhash64(F.lit(SEED + 1), "doc_id", "copy")).orderBy("shuffle_key", "doc_id", "copy")


def shares(spark: SparkSession, d: str) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, copies, max_copies) of every target."""
    got = drawn(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    per = got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("max_copies"))
    all_ = table(spark, d, "mix_targets").select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["tokens", "documents", "copies", "max_copies"])
    total = all_.agg(F.sum("tokens").alias("total"))
    return all_.crossJoin(F.broadcast(total)).select("source", "target_share", F.when(F.col("total") > 0, F.round(F.col("tokens") / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "documents", "copies", "max_copies", "max_repeats")
