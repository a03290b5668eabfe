"""Near-duplicate classes of texts: shingles of five words, Jaccard similarity of 0.8 or more, linked texts share a class.

Texts of one shingle set are one representative. Representatives meet in buckets of MinHash bands; in a bucket each pair not yet linked is verified exactly, so no
link between different texts is lost there, and only links that join two parts come out. A bucket of more than BLOCK members is worked block against block.
Classes are the connected components, found by taking least labels and jumping pointers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.core import cut

SHINGLE, SIMILAR, BANDS, ROWS, BLOCK = 5, 0.8, 20, 5, 1024
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W぀-ヿ㐀-鿿]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SALT = np.random.default_rng(5).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; one over all words if it has fewer than five."""
    w = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in _WORD.findall(text.lower())], np.uint64)
    if not len(w):
        return np.zeros(0, np.int64)
    k = min(SHINGLE, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(31))) * _ODD[1] + w[j : len(w) - k + 1 + j] * _ODD[j]
    h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def bands(s: np.ndarray) -> list[int]:
    """One 64-bit key for each band of ROWS least hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        h = s[at : at + 4096].view(np.uint64)[:, None] * (_SALT[0] | np.uint64(1)) + _SALT[1]
        h ^= h >> np.uint64(32)
        least = np.minimum(least, h.min(0))
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = (key ^ least.reshape(BANDS, ROWS)[:, r]) * _ODD[2]
        key ^= key >> np.uint64(33)
    return key.view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _links(t: pa.Table) -> pa.Table:
    """Links that join two parts among the members of one bucket."""
    ids, sets = t["rep"].to_pylist(), [np.array(x, np.int64) for x in t["set"].to_pylist()]
    parent, out = list(range(len(ids))), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in reversed(order[:x]):
            if len(sets[j]) < SIMILAR * len(sets[i]):
                break  # the rest are shorter still
            if top(i) != top(j) and jaccard(sets[i], sets[j]) >= SIMILAR:
                parent[top(i)] = top(j)
                out.append((ids[i], ids[j]))
    return pa.table({"x": pa.array([a for a, _ in out], pa.int64()), "y": pa.array([b for _, b in out], pa.int64())})


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of links (x, y): the least node of its component."""
    both = cut(links.select("x", "y").unionAll(links.select("y", "x")).distinct())
    label = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("node"), "label"))
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("y"), F.col("label").alias("m")), "y").groupBy(F.col("x").alias("node")).agg(F.min("m").alias("m"))
        new = label.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        new = cut(new.join(up, "label", "left").select("node", F.least("label", F.coalesce("upper", "label")).alias("label"), "was"))
        if new.where("label != was").isEmpty():
            break
        label = new.select("node", "label")
    return new.select("node", "label")


def classes(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class) of every row of docs with a text: class is the representative's 64-bit key, equal for linked texts. Texts without words are classes by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x) for x in b.column(text).to_pylist()]
            keys = [zlib.crc32(s.tobytes()) << 31 ^ zlib.adler32(s.tobytes()[::-1]) ^ len(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(id_), pa.array(keys, pa.int64()), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], names=["id", "rep", "set"])

    d = docs.where(f"`{text}` is not null and `{id_}` is not null").select(id_, text)
    all_ = d.mapInArrow(run, f"id {dict(docs.dtypes)[id_]}, rep bigint, set array<bigint>").withColumn("rep", F.coalesce("rep", F.xxhash64("id")))
    all_ = cut(all_)
    reps = all_.where("size(set) > 0").groupBy("rep").agg(F.first("set").alias("set"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [bands(np.array(x, np.int64)) for x in b.column("set").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(np.repeat(np.arange(len(k)), BANDS))), pa.array([x for y in k for x in y], pa.int64())], names=["rep", "bucket"])

    met = cut(reps.mapInArrow(keys, "rep bigint, bucket bigint"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    m = met.join(shared, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.join(reps, "rep").select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "set").repartition("bucket", "i", "j")
    links = m.groupBy("bucket", "i", "j").applyInArrow(_links, "x bigint, y bigint").distinct()
    label = components(links)
    return all_.select("id", "rep").join(label, all_["rep"] == label["node"], "left").select("id", F.coalesce("label", "rep").alias("class"))
