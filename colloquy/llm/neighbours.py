"""Problem 6: the most similar vectors of every vector.

Method: a forest of random-projection trees, searched through one priority queue that all trees share (the leaf with the largest least margin on its path is opened
next, in whichever tree), then exact cosine over the members of the opened leaves.

The trees are fitted on a bounded sample (SAMPLE vectors), so the model is of bounded size; all vectors are routed. Equal vectors cannot be split, so they are
searched as one representative and expanded afterwards. A leaf that the sample shows to be large is worked in blocks of about BLOCK members against blocks of as
many queries, so that no task holds it whole. `recall` measures the answer against brute force over a set of queries in blocks.

Vectors that are NULL, of another length, with NaN, infinite or NULL parts or all zero are not usable and have no neighbours. A repeated id counts once, with its
latest row. Ties of similarity (to nine places) go by id. Fewer than k others give fewer neighbours; an empty table gives none. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.core import cut, table

K, DIM, TREES, LEAVES, LEAF, SAMPLE, BLOCK, NEAR = 5, 64, 4, 20, 2048, 40_000, 8192, 0.9


class Forest:
    """Arrays over the inner nodes of all trees: a normal, an offset, two children; a child under 0 is the leaf -child - 1."""

    def __init__(self, sample: np.ndarray, leaf: int, trees: int = TREES, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.normal, self.offset, self.child, self.roots, self.leaves, self.size = [], [], [], [], 0, []
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng))
        self.normal, self.offset, self.child = np.array(self.normal, np.float32).reshape(-1, sample.shape[1]), np.array(self.offset, np.float32), np.array(self.child, np.int32).reshape(-1, 2)

    def _grow(self, x: np.ndarray, ids: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        root, todo = None, [(ids, None, 0)]
        while todo:
            ids, parent, side = todo.pop()
            if len(ids) <= leaf:
                self.leaves += 1
                self.size.append(len(ids))
                here = -self.leaves
            else:
                a, b = x[rng.choice(ids, 2, replace=False)]
                normal = a - b
                if not np.any(normal):
                    normal = rng.standard_normal(x.shape[1])
                normal = normal / np.linalg.norm(normal)
                along = x[ids] @ normal
                offset = np.median(along)
                right = along > offset
                if right.all() or not right.any():
                    right = rng.random(len(ids)) < 0.5
                here = len(self.normal)
                self.normal.append(normal)
                self.offset.append(offset)
                self.child.append([0, 0])
                todo += [(ids[~right], here, 0), (ids[right], here, 1)]
            if parent is None:
                root = here
            else:
                self.child[parent][side] = here
        return root

    def own(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf in which each vector lies in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, np.int32)
            inner = np.flatnonzero(at >= 0)
            while len(inner):
                n = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.normal[n]) > self.offset[n]
                at[inner] = self.child[n, right.astype(int)]
                inner = inner[at[inner] >= 0]
            out[:, t] = -at - 1
        return out

    def search(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """(vectors, leaves): the leaves opened for each vector, -1 where there are no more. One priority queue a vector over all trees, worked for all vectors at once."""
        n, room = len(x), len(self.roots) + 1
        queue = np.full((n, room + 64 * len(self.roots)), -np.inf, np.float32)
        node = np.zeros(queue.shape, np.int32)
        queue[:, : len(self.roots)], node[:, : len(self.roots)] = np.inf, self.roots
        used = np.full(n, len(self.roots))
        out, got = np.full((n, leaves), -1, np.int32), np.zeros(n, int)
        live = np.arange(n)
        while len(live):
            best = queue[live].argmax(1)
            rank, at = queue[live, best], node[live, best]
            queue[live, best] = -np.inf
            leaf = at < 0
            open_ = rank > -np.inf
            hit = live[leaf & open_]
            out[hit, got[hit]] = -at[leaf & open_] - 1
            got[hit] += 1
            inner = live[~leaf & open_]
            if len(inner):
                a, r = at[~leaf & open_], rank[~leaf & open_]
                margin = np.einsum("ij,ij->i", x[inner], self.normal[a]) - self.offset[a]
                right = (margin > 0).astype(int)
                slot = best[~leaf & open_]
                queue[inner, slot], node[inner, slot] = r, self.child[a, right]  # the nearer child keeps the rank of its parent
                if used[inner].max() >= queue.shape[1]:
                    queue = np.pad(queue, ((0, 0), (0, 256)), constant_values=-np.inf)
                    node = np.pad(node, ((0, 0), (0, 256)))
                queue[inner, used[inner]], node[inner, used[inner]] = np.minimum(r, -np.abs(margin)), self.child[a, 1 - right]
                used[inner] += 1
            live = live[open_ & (got[live] < leaves)]
        return out


def usable(vectors: DataFrame, id_: str, embedding: str, dim: int, latest: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, embedding, keep...) of usable vectors, one row an id."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.where(F.col(id_).isNotNull() & (F.size(e) == dim)).where(~bad & F.exists(e, lambda x: x != 0))
    order = F.struct(*([F.col(latest)] if latest else []), F.hash(e))
    return v.groupBy(F.col(id_).alias("id")).agg(F.max_by(e, order).alias("embedding"), *[F.max_by(F.col(c), order).alias(c) for c in keep])


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_NEAR = pa.schema([("q", pa.int64()), ("r", pa.int64()), ("similarity", pa.float64())])


def _best(k: int, dim: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NEAR.empty_table()
        q, r = left["rep"].to_numpy(), right["rep"].to_numpy()
        x, y = _unit(left["embedding"], dim), _unit(right["embedding"], dim)
        fine, out = np.ascontiguousarray(y.astype(np.float32).T), []
        take = min(k + 1, len(r))  # the query itself may be among them
        for at in range(0, len(q), 512):
            rough = x[at : at + 512].astype(np.float32) @ fine
            # all that single precision cannot tell from the best are compared exactly; ties at the last place all stay and are settled by id
            floor = np.partition(rough, len(r) - take, axis=1)[:, len(r) - take] - 1e-5
            a, b = np.nonzero(rough >= floor[:, None])
            ok = q[at + a] != r[b]
            a, b = a[ok], b[ok]
            s = np.round(np.einsum("ij,ij->i", x[at + a], y[b]), 9)
            out.append(pa.table([pa.array(q[at + a]), pa.array(r[b]), pa.array(s)], schema=_NEAR))
        return pa.concat_tables(out)

    return run


def forest(reps: DataFrame, n: int, dim: int, leaf: int = LEAF, sample: int = SAMPLE, trees: int = TREES) -> Forest:
    """Fitted on the `sample` vectors of least hash."""
    picked = reps.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    x = _unit(picked["embedding"], dim).astype(np.float32) if picked.num_rows else np.zeros((0, dim), np.float32)
    share = max(1.0, n / max(1, len(x)))
    return Forest(x, max(2, int(leaf / share)), trees)


def neighbours(vectors: DataFrame, k: int = K, dim: int = DIM, leaves: int = LEAVES, leaf: int = LEAF, queries: DataFrame | None = None) -> DataFrame:
    """(id, rank, neighbour, similarity) for each row of vectors (id, embedding), or for the ids of `queries` only, against all rows."""
    spark = vectors.sparkSession
    # representatives of equal vectors; of each class the k + 1 least ids are enough to answer for any of its members
    v = vectors.withColumn("rep", F.xxhash64("embedding"))
    member = v.select("rep", "id")
    reps = cut(v.groupBy("rep").agg(F.first("embedding").alias("embedding"), F.count("*").alias("members")))
    n = reps.count()
    model = spark.sparkContext.broadcast(forest(reps, n, dim, leaf))

    # how many blocks of members and of queries each leaf has, from its share of the sample
    expected = np.array(model.value.size or [0]) * max(1.0, n / SAMPLE)
    blocks = spark.sparkContext.broadcast((np.maximum(1, np.ceil(expected / BLOCK)).astype(np.int64), np.maximum(1, np.ceil(expected * leaves / TREES / BLOCK)).astype(np.int64)))

    def spread_out(b: pa.RecordBatch, at: np.ndarray, leaf_: np.ndarray, own: int) -> pa.RecordBatch:
        """Each row (at) once for each block of the other side in its leaf."""
        mine, other = blocks.value[own][leaf_], blocks.value[1 - own][leaf_]
        rep = b["rep"].to_numpy(zero_copy_only=False)[at]
        block = np.mod(rep, mine)
        each = np.repeat(np.arange(len(at)), other)
        turn = np.arange(len(each)) - np.repeat(np.cumsum(other) - other, other)
        sides = [block[each], turn]
        where = pa.array(at[each])
        return pa.RecordBatch.from_arrays([b["rep"].take(where), b["embedding"].take(where), pa.array(leaf_[each].astype(np.int32)), pa.array(sides[own]), pa.array(sides[1 - own])], names=["rep", "embedding", "leaf", "mb", "qb"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                own = model.value.own(_unit(part["embedding"], dim).astype(np.float32))
                yield spread_out(part, np.repeat(np.arange(len(own)), own.shape[1]), own.ravel(), 0)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                got = model.value.search(_unit(part["embedding"], dim).astype(np.float32), leaves)
                at, _ = np.nonzero(got >= 0)
                yield spread_out(part, at, got[got >= 0], 1)

    kind = "rep bigint, embedding array<float>, leaf int, mb bigint, qb bigint"
    asked = reps if queries is None else reps.join(v.join(queries.select("id").distinct(), "id", "left_semi").select("rep").distinct(), "rep", "left_semi")
    lone, spread = reps.select("rep", "embedding"), max(1, min(2000, n // 4000 + 1))
    keys = ["leaf", "qb", "mb"]
    members = lone.repartition(spread, "rep").mapInArrow(route, kind).groupBy(*keys)
    probes = asked.select("rep", "embedding").repartition(spread, "rep").mapInArrow(probe, kind).groupBy(*keys)
    near = probes.cogroup(members).applyInArrow(_best(k + 1, dim), "q bigint, r bigint, similarity double").distinct()
    w = Window.partitionBy("q").orderBy(F.desc("similarity"))
    near = near.withColumn("place", F.rank().over(w)).where(F.col("place") <= k).drop("place")
    first = member.withColumn("place", F.row_number().over(Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).where(F.col("place") <= k + 1)
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1).select(F.col("rep").alias("r"), F.col("id").alias("neighbour"))
    ask = member if queries is None else member.join(queries.select("id").distinct(), "id", "left_semi")
    same = asked.where("members > 1").select(F.col("rep").alias("q"), F.col("rep").alias("r"), F.lit(1.0).alias("similarity"))
    # the answer of a class, then of each of its members
    cand = near.select("q", "r", "similarity").unionByName(same).join(first, "r")
    top = cand.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("place") <= k + 1).groupBy("q").agg(F.collect_list(F.struct("place", "neighbour", "similarity")).alias("near"))
    each = ask.join(top, ask["rep"] == top["q"]).select("id", F.slice(F.filter(F.array_sort("near"), lambda x: x["neighbour"] != F.col("id")), 1, k).alias("near"))
    return each.select("id", F.posexplode("near").alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), F.col("x.similarity").alias("similarity"))


def brute(vectors: DataFrame, queries: DataFrame, k: int = K, dim: int = DIM) -> DataFrame:
    """The exact answer for the ids of queries against all rows, in blocks of vectors."""
    q = vectors.join(queries.select("id").distinct(), "id", "left_semi").select(F.xxhash64("id").alias("rep"), F.col("embedding").alias("asked"))
    blocks = max(1, vectors.count() // 50_000)
    m = vectors.select(F.xxhash64("id").alias("rep"), "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"))
    q = q.select("rep", F.col("asked").alias("embedding"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    near = q.groupBy("b").cogroup(m.groupBy("b")).applyInArrow(_best(k, dim), "q bigint, r bigint, similarity double")
    names = vectors.select(F.xxhash64("id").alias("h"), "id")
    near = near.join(names.select(F.col("h").alias("q"), "id"), "q").join(names.select(F.col("h").alias("r"), F.col("id").alias("neighbour")), "r")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")


def facets(spark: SparkSession, d: str) -> DataFrame:
    return usable(table(spark, d, "hierarchical_facets"), "facet_id", "embedding", DIM, "last_seen", ("facet_text",))


def top5(spark: SparkSession, d: str) -> DataFrame:
    """(facet_id, rank, neighbour_id, neighbour_text, similarity)."""
    f = facets(spark, d)
    near = neighbours(f.select("id", "embedding"))
    return near.join(f.select(F.col("id").alias("neighbour"), F.col("facet_text").alias("neighbour_text")), "neighbour").select(F.col("id").alias("facet_id"), "rank", F.col("neighbour").alias("neighbour_id"), "neighbour_text", "similarity")


def found(spark: SparkSession, d: str) -> DataFrame:
    """(facet_id_a, facet_id_b) with a < b: one is among the K most similar of the other, similarity at least NEAR."""
    near = neighbours(facets(spark, d).select("id", "embedding")).where(F.col("similarity") >= NEAR)
    return near.select(F.least("id", "neighbour").alias("facet_id_a"), F.greatest("id", "neighbour").alias("facet_id_b")).distinct()


def recall(spark: SparkSession, d: str) -> DataFrame:
    """(queries, wanted, got, recall): the share of the exact neighbours of every hundredth facet that the forest finds; ties count by similarity."""
    f = cut(facets(spark, d).select("id", "embedding"))
    q = f.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).select("id")
    exact, got = brute(f, q).groupBy("id").agg(F.min("similarity").alias("least"), F.count("*").alias("wanted")), neighbours(f, queries=q)
    both = exact.join(got.select("id", "similarity"), "id", "left").groupBy("id", "wanted", "least").agg(F.count(F.when(F.col("similarity") >= F.col("least"), 1)).alias("got"))
    return both.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), F.sum("got").alias("got"), F.round(F.sum("got") / F.sum("wanted"), 4).alias("recall"))
