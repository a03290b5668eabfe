"""Problem 8: filling fixed-capacity containers.

Method: conflict-constrained best-fit. Items are taken from the largest to the smallest; containers are ordered by what is left in them and carry a bitmap of their
sources and one of their duplicate classes; from the tightest container that has room the search goes on to the next until one is compatible. Near-duplicates of
one class (`duplicates`) stay in different containers, and so do pairs of sources given as `apart`.

A class of more members than there are containers at least (a hot group of copies) is divided into as many sub-classes as needed, so that its copies spread evenly
instead of each opening a container of its own. Items are packed in shards by hash; items of under-filled containers are packed again across shards while that makes
fewer of them. Only a text larger than a container is divided, into full pieces and a rest.

A NULL text is no item; an empty text has 0 tokens and lies in some container; ties go by id and piece; a NULL source is a source of its own; repeated ids get
containers each; extra columns are not used; an empty table gives no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import cut, table
from colloquy.llm import duplicates, tokens

CAPACITY, SHARD, FULL, LEVELS = 2048, 20_000, 0.985, 6
_OUT = "doc_id bigint, piece int, begin bigint, tokens bigint, source string, class bigint, container string, used bigint"


def best_fit(sizes: list[int], sources: list[str | None], classes: list[object], capacity: int = CAPACITY, apart: frozenset[frozenset[str]] = frozenset()) -> list[int]:
    """The container of each item. sizes must not pass capacity. Two items of one class, None apart, and two of sources kept apart share no container."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    seen: dict[object, int] = {}
    for c in classes:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    class_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1)}
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    against = {s: sum(source_bit.get(o, 0) for pair in apart if s in pair for o in pair - {s}) for s in source_bit}
    left: list[tuple[int, int]] = []  # (room, container), ordered
    class_map, source_map, out = [], [], [0] * len(sizes)
    for i in order:
        bit, foe = class_bit.get(classes[i], 0), against[sources[i]]
        at = bisect_left(left, (sizes[i], -1))
        while at < len(left) and (class_map[left[at][1]] & bit or source_map[left[at][1]] & foe):
            at += 1
        if at < len(left):
            room, b = left.pop(at)
        else:
            room, b = capacity, len(class_map)
            class_map.append(0)
            source_map.append(0)
        class_map[b] |= bit
        source_map[b] |= source_bit[sources[i]]
        insort(left, (room - sizes[i], b))
        out[i] = b
    return out


def _pack(level: int, capacity: int, apart: frozenset[frozenset[str]]):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes, kinds = t["tokens"].to_pylist(), t["class"].to_pylist()
        subs = t["sub"].to_pylist()
        where = best_fit(sizes, t["source"].to_pylist(), [None if c is None else (c, s) for c, s in zip(kinds, subs)], capacity, apart)
        used: dict[int, int] = {}
        for b, n in zip(where, sizes):
            used[b] = used.get(b, 0) + n
        shard = t["shard"][0].as_py()
        cols = [t[c] for c in ("doc_id", "piece", "begin", "tokens", "source", "class", "sub")]
        return pa.table([*cols, pa.array([f"{level}-{shard}-{b}" for b in where]), pa.array([used[b] for b in where], pa.int64())], names=["doc_id", "piece", "begin", "tokens", "source", "class", "sub", "container", "used"])

    return run


def containers(docs: DataFrame, capacity: int = CAPACITY, apart: frozenset[frozenset[str]] = frozenset(), vocabulary: str = tokens.VOCABULARY, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, begin, tokens, source, class, container, used) for each text, or each piece of one larger than a container; begin counts tokens."""
    docs = docs.select("doc_id", "source", "text")
    size = tokens.sized(docs, "text", vocabulary)
    # the copies of a class may be many: they are counted, never gathered
    kind = cut(duplicates.classes(docs))
    item = cut(size.join(kind, size["doc_id"] == kind["id"], "left").select("doc_id", "source", "tokens", "class"))
    total = item.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    fewest = max(1, -(-total // capacity))
    # a class whose members outnumber the containers is divided
    many = item.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("k"), F.ceil(F.col("n") * 1.25 / fewest).alias("parts"))
    item = item.join(many, item["class"] == many["k"], "left")
    sub = F.when(F.coalesce("parts", F.lit(1)) > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0)).cast("long")
    item = item.select("doc_id", "source", F.when(F.col("k").isNotNull(), F.col("class")).alias("class"), sub.alias("sub"), "tokens")
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1).cast("int"))
    todo = item.select("doc_id", "source", "class", "sub", F.col("tokens").alias("whole"), F.explode(pieces).alias("piece"))
    todo = todo.select("doc_id", "source", "class", "sub", "piece", (F.col("piece").cast("long") * capacity).alias("begin"), F.least(F.lit(capacity), F.col("whole") - F.col("piece").cast("long") * capacity).alias("tokens"))
    done, last = [], None
    kinds = _OUT.replace(", container", ", sub bigint, container")
    for level in range(LEVELS):
        todo = cut(todo)
        shards = max(1, -(-todo.count() // shard))
        if last is not None and shards >= last:  # no fewer shards than before: packing again would change little
            break
        packed = todo.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece"), F.lit(shards))).groupBy("shard").applyInArrow(_pack(level, capacity, apart), kinds)
        packed = cut(packed)
        last = shards
        if shards == 1:
            done.append(packed)
            todo = None
            break
        full = F.col("used") >= FULL * capacity
        done.append(packed.where(full))
        todo = packed.where(~full)
    if todo is not None:
        done.append(todo)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "piece", "begin", "tokens", "source", "class", "container", "used")


def all_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(table(spark, d, "documents"))


def report(spark: SparkSession, d: str) -> DataFrame:
    """(containers, fewest, tokens, fill, texts, divided): fewest is the least number that the tokens need."""
    c = all_containers(spark, d)
    per = c.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"), F.countDistinct(F.when(F.col("piece") > 0, F.col("doc_id"))).alias("divided"))
    return per.select("containers", F.ceil(F.col("tokens") / CAPACITY).alias("fewest"), "tokens", F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("fill"), "texts", "divided")
