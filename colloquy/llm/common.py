"""Free-text fields as a dictionary of distinct paragraphs, so that each paragraph is decoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import table

#: Characters of text that one decoding step takes together.
TOGETHER = 1_500_000


def fields(spark: SparkSession, d: str) -> DataFrame:
    """messages.content and conversations.full_text as (field, conversation_id, sequence, text), without rows whose key is NULL."""
    m = table(spark, d, "messages").where("conversation_id is not null and sequence is not null and content is not null")
    c = table(spark, d, "conversations").where("conversation_id is not null and full_text is not null")
    return m.select(F.lit("messages.content").alias("field"), "conversation_id", "sequence", F.col("content").alias("text")).unionAll(
        c.select(F.lit("conversations.full_text"), "conversation_id", F.lit(-1), "full_text")
    )


def paragraphs(texts: DataFrame) -> DataFrame:
    """Each paragraph of each text with its key columns, its number and a 128-bit key. A paragraph ends at an empty line; joined by two line feeds they give the text again."""
    p = texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(F.split("text", "\n\n")).alias("part", "piece"))
    return p.withColumn("k1", F.xxhash64("piece")).withColumn("k2", F.xxhash64(F.lit(7), "piece"))


def decoded(df: DataFrame, fn: Callable[[list[str]], list[list[tuple[int, int, str]]]], keys: tuple[str, ...] = ("k1", "k2"), text: str = "piece") -> DataFrame:
    """(keys..., spans) for the rows in whose text fn finds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
        for batch in batches:
            col = batch.column(text).to_pylist()
            sizes = np.cumsum([len(x) for x in col]) // TOGETHER
            for part in np.split(np.arange(len(col)), np.flatnonzero(np.diff(sizes)) + 1):
                if not len(part):
                    continue
                found = fn([col[i] for i in part])
                hit = [i for i, s in enumerate(found) if s]
                at = pa.array([int(part[i]) for i in hit], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], pa.array([[{"begin": a, "end": b, "label": x} for a, b, x in found[i]] for i in hit], kind)], names=[*keys, "spans"])

    types = dict(df.dtypes)
    return df.select(*keys, text).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", spans array<struct<begin:int,end:int,label:string>>")


def dictionary(parts: DataFrame) -> DataFrame:
    """One row for each distinct paragraph."""
    return parts.where("piece != ''").dropDuplicates(["k1", "k2"]).select("k1", "k2", "piece")


def replaced(texts: DataFrame, spans: DataFrame, mark: str) -> DataFrame:
    """Every text of texts with each span replaced by mark, in which %s is the label in capitals; all else is untouched. spans: (k1, k2, spans) by paragraph.

    Each text with a span is put together from its paragraphs; a text without one passes as it is. Texts are told apart by their key columns and their hash, so
    that rows of equal key keep their own texts."""
    keys = [c for c in texts.columns if c != "text"]
    t = texts.withColumn("text_hash", F.xxhash64("text")).withColumn("text_hash2", F.xxhash64(F.lit(3), "text"))
    hit = paragraphs(t).join(spans, ["k1", "k2"])
    hit = hit.select("text_hash", "text_hash2", "part", "spans").dropDuplicates(["text_hash", "text_hash2", "part"]).groupBy("text_hash", "text_hash2").agg(F.map_from_entries(F.collect_list(F.struct("part", "spans"))).alias("by_part"))
    joined = t.join(hit, ["text_hash", "text_hash2"], "left")
    # from the last span of a paragraph to the first, so that offsets stay right
    one = lambda p, s: F.aggregate(
        F.reverse(F.array_sort(s)), p, lambda acc, x: F.concat(F.substr(acc, F.lit(1), x["begin"]), F.format_string(mark, F.upper(x["label"])), F.substr(acc, x["end"] + 1))
    )
    parts = F.split("text", "\n\n")
    new = F.array_join(F.transform(parts, lambda p, i: F.when(F.map_contains_key("by_part", i), one(p, F.try_element_at("by_part", i))).otherwise(p)), "\n\n")
    return joined.select(*keys, F.when(F.col("by_part").isNull(), F.col("text")).otherwise(new).alias("text"))
