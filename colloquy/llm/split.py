"""Problem 1: splitting oversized items at natural boundaries.

Method: an item is worked in ranges of RANGE code points (a file in ranges of bytes), each with a halo long enough to decide every cut that begins in it. A worker
per range finds the boundaries and gives, for each place at which the first piece of the range may begin, where the first piece of the next range begins and how
many pieces lie between (places that run into one path share one entry). These tables are stitched range by range, in blocks, lengths are prefix-summed, and each
range then emits its own pieces by offset. No task holds a whole item of more than one range.

Pieces have at most `limit` code points and end at the strongest pause of their second half (an empty line, a line end, a sentence end, a clause, white space, in
this order); where there is none they end at the limit, but not inside a CRLF or before a combining mark. Each next piece begins `overlap` code points before the
end of the one before, so dropping the overlaps gives the text again.

NULL and empty texts have no piece; items within the limit are no case; rows of equal key and text count once, rows of equal key and other text are told apart by
text_id; extra columns are not used; empty tables give empty results.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import map_rows, table

LIMIT, OVERLAP, RANGE, BLOCK = 1500, 200, 65536, 512
#: From the strongest pause to the weakest.
PAUSES = [re.compile(p) for p in (r"\n[ \t\r]*\n\s*", r"\n", r"[.!?…][\"')\]]*\s+|[。！？]", r"[,;:]\s+|[、，；：]", r"\s+")]
Transfer = list[tuple[int, int, int]]


def next_end(text: str, start: int, limit: int = LIMIT, overlap: int = OVERLAP) -> int:
    """Where the piece that begins at start ends; text must reach past start + limit unless it ends there."""
    if len(text) - start <= limit:
        return len(text)
    most = start + limit
    for k, pause in enumerate(PAUSES):
        least = start + (max(limit // 2, overlap + 1) if k < len(PAUSES) - 1 else overlap + 1)
        end = max((e for m in pause.finditer(text, least, most) if (e := m.end()) <= most), default=0)
        if end:
            if text[end - 1] == "\r" and text[end] == "\n":
                end -= 1
            if end > start + overlap:
                return end
    end = most
    while end > most - 24 and end > start + overlap + 1 and (unicodedata.combining(text[end]) or text[end] in "‍️" or text[end - 1] == "‍" or text[end - 1] == "\r" and text[end] == "\n"):
        end -= 1
    return end


def chain(text: str, start: int, core: int, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], int]:
    """The pieces that begin at start or later but before core, and where the next one begins; -1 if there is none."""
    out = []
    while 0 <= start < core:
        end = next_end(text, start, limit, overlap)
        out.append((start, end))
        start = end - overlap if end < len(text) else -1
    return out, start


def transfer(text: str, core: int, limit: int = LIMIT, overlap: int = OVERLAP) -> Transfer:
    """(first entry, exit, pieces) for runs of entries that share both; entries are 0 to limit - overlap - 1. Exits are counted from core, -1 after the last piece."""
    known: dict[int, tuple[int, int]] = {}
    out: Transfer = []
    for entry in range(limit - overlap):
        at, path = entry, []
        while 0 <= at < core and at not in known:
            path.append(at)
            end = next_end(text, at, limit, overlap)
            at = end - overlap if end < len(text) else -1
        leave, n = known[at] if at in known else (at - core if at >= 0 else -1, 0)
        for p in reversed(path):
            n += 1
            known[p] = (leave, n)
        if entry >= core:
            leave, n = entry - core, 0
        if not out or out[-1][1:] != (leave, n) or entry >= core:
            out.append((entry, leave, n))
    return out


def follow(t: Transfer, entry: int) -> tuple[int, int]:
    if entry < 0:
        return -1, 0
    best = max((x for x in t if x[0] <= entry), key=lambda x: x[0])
    return best[1], best[2]


def compose(parts: list[Transfer], width: int = LIMIT - OVERLAP) -> Transfer:
    out: Transfer = []
    for entry in sorted({x[0] for x in parts[0]}):
        at, n = entry, 0
        for t in parts:
            at, k = follow(t, at)
            n += k
        if not out or out[-1][1:] != (at, n):
            out.append((entry, at, n))
    return out


_STEPS = "array<struct<entry:int,leave:int,n:bigint>>"


def _stitch(bounds: DataFrame) -> DataFrame:
    """(item, range, entry, first piece, code points before) from (item, range, core, steps). Blocks of ranges are composed first, then each item's blocks, so a
    task holds BLOCK ranges or an item's blocks, a few bytes each."""
    blocks = bounds.withColumn("block", F.floor(F.col("range") / BLOCK).cast("long"))

    def whole(pdf):  # one row for each block: its own transfer
        pdf = pdf.sort_values("range")
        steps = compose([[(s["entry"], s["leave"], s["n"]) for s in x] for x in pdf["steps"]])
        return pdf.head(1)[["item", "block"]].assign(core=pdf["core"].sum(), steps=[[{"entry": a, "leave": b, "n": c} for a, b, c in steps]])

    def entries(key: str):
        def run(pdf):
            pdf = pdf.sort_values(key)
            at, piece, before, rows = int(pdf["entry0"].iloc[0]), int(pdf["piece0"].iloc[0]), int(pdf["before0"].iloc[0]), []
            for x, core, steps in zip(pdf[key], pdf["core"], pdf["steps"]):
                rows.append((pdf["item"].iloc[0], x, at, piece, before))
                at, n = follow([(s["entry"], s["leave"], s["n"]) for s in steps], at)
                piece, before = piece + n, before + int(core)
            return type(pdf)(rows, columns=["item", key, "entry0", "piece0", "before0"])

        return run

    per_block = blocks.groupBy("item", "block").applyInPandas(whole, f"item string, block bigint, core bigint, steps {_STEPS}")
    at_block = per_block.withColumns({"entry0": F.lit(0), "piece0": F.lit(0).cast("long"), "before0": F.lit(0).cast("long")}).groupBy("item").applyInPandas(entries("block"), "item string, block bigint, entry0 int, piece0 bigint, before0 bigint")
    return blocks.join(at_block, ["item", "block"]).groupBy("item", "block").applyInPandas(entries("range"), "item string, range bigint, entry0 int, piece0 bigint, before0 bigint")


_CUTS = "array<struct<begin:int,end:int>>"


def _cut_single(df: DataFrame, limit: int, overlap: int) -> DataFrame:
    """df with the cuts of its column text, worked in Arrow batches; all other columns pass through."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [[{"begin": a, "end": b} for a, b in chain(x, 0, len(x), limit, overlap)[0]] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, kind)], names=[*batch.schema.names, "cuts"])

    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + f", cuts {_CUTS}")


def _from_ranges(ranges: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(item, piece, begin, text) from (item, range, core, text), text being the range and its halo, core the code points of the range itself."""

    def bound(r: dict) -> list[dict]:
        return [{"item": r["item"], "range": r["range"], "core": r["core"], "steps": [{"entry": a, "leave": b, "n": n} for a, b, n in transfer(r["text"], r["core"], limit, overlap)]}]

    at = _stitch(map_rows(ranges, bound, f"item string, range bigint, core bigint, steps {_STEPS}", 16))

    def emit(r: dict) -> list[dict]:
        cuts, _ = chain(r["text"], r["entry0"], r["core"], limit, overlap)
        return [{"item": r["item"], "piece": r["piece0"] + i, "begin": r["before0"] + a, "text": r["text"][a:b]} for i, (a, b) in enumerate(cuts)]

    return map_rows(ranges.join(at, ["item", "range"]).where("entry0 >= 0"), emit, "item string, piece bigint, begin bigint, text string", 16)


def pieces(items: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE) -> DataFrame:
    """(keys..., text_id, piece, begin, text) of every item longer than limit; begin is the offset in code points, text_id the SHA-256 of the whole text."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    t = items.select(*keys, F.col(text).alias("text")).where(F.length("text") > limit).withColumn("text_id", F.sha2("text", 256))
    t = t.dropDuplicates([*keys, "text_id"])
    one = _cut_single(t.where(F.length("text") <= range_chars), limit, overlap)
    one = one.select(*keys, "text_id", "text", F.posexplode("cuts").alias("piece", "cut"))
    one = one.select(*keys, "text_id", F.col("piece").cast("long").alias("piece"), F.col("cut.begin").cast("long").alias("begin"), F.substring("text", F.col("cut.begin") + 1, F.col("cut.end") - F.col("cut.begin")).alias("text"))
    large = t.where(F.length("text") > range_chars)
    ranges = large.select(F.col("text_id").alias("item"), "text").dropDuplicates(["item"]).select("item", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") - 1) / range_chars).cast("long"))).alias("range"))
    start = F.col("range").cast("int") * range_chars
    ranges = ranges.select("item", "range", F.least(F.lit(range_chars), F.length("text") - start).cast("long").alias("core"), F.substring("text", start + 1, F.lit(range_chars + limit + 64)).alias("text"))
    many = _from_ranges(ranges, limit, overlap).withColumnRenamed("item", "text_id")
    return one.unionByName(large.select(*keys, "text_id").join(many, "text_id").select(*one.columns))


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 1 << 20) -> DataFrame:
    """(item, piece, begin, text) of UTF-8 files on a file system that all workers mount; each worker reads its byte range and halo only. Broken bytes become
    U+FFFD. Files within the limit are one piece; empty files have none."""
    rows = [(p, r) for p in paths for r in range(-(-os.path.getsize(p) // range_bytes))]
    listed = spark.createDataFrame(rows, "item string, range bigint")
    halo = 4 * (limit + 64)

    def read(r: dict) -> list[dict]:
        at = r["range"] * range_bytes
        with open(r["item"], "rb") as f:
            f.seek(at)
            data = f.read(range_bytes + halo)
        lead = lambda i: next((j for j in range(i, min(i + 4, len(data))) if data[j] & 0xC0 != 0x80), i)
        a = lead(0) if at else 0
        b = lead(range_bytes) if len(data) > range_bytes else len(data)
        last = len(data)
        if last == range_bytes + halo:  # do not end inside a character
            while last > b and data[last - 1] & 0xC0 == 0x80:
                last -= 1
            last -= last > b
        core = data[a:b].decode("utf-8", "replace")
        return [{"item": r["item"], "range": r["range"], "core": len(core), "text": core + data[b:last].decode("utf-8", "replace")}]

    spread = listed.repartition(max(1, min(len(rows), 4096))) if rows else listed
    return _from_ranges(map_rows(spread, read, "item string, range bigint, core bigint, text string", 1), limit, overlap)


def items(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select(F.lit("messages.content").alias("field"), "conversation_id", F.col("sequence").alias("ply_start"), F.col("sequence").alias("ply_end"), F.col("content").alias("text"))
    e = table(spark, d, "exchanges").select(F.lit("exchanges.exchange_text"), "conversation_id", "ply_start", "ply_end", "exchange_text")
    return m.unionAll(e).where("conversation_id is not null and ply_start is not null and ply_end is not null")


KEYS = ["field", "conversation_id", "ply_start", "ply_end"]


def all_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces(items(spark, d), "text", KEYS)


def found(spark: SparkSession, d: str) -> DataFrame:
    """The items that come out as two pieces or more."""
    return all_pieces(spark, d).where("piece = 1").select(*KEYS).distinct()


FOUND_SQL = f"""
SELECT 'messages.content' AS field, conversation_id, sequence AS ply_start, sequence AS ply_end FROM messages
WHERE conversation_id IS NOT NULL AND sequence IS NOT NULL AND length(content) > {LIMIT}
UNION
SELECT 'exchanges.exchange_text', conversation_id, ply_start, ply_end FROM exchanges
WHERE conversation_id IS NOT NULL AND ply_start IS NOT NULL AND ply_end IS NOT NULL AND length(exchange_text) > {LIMIT}
"""
