"""Streams of file events and of messages, with Structured Streaming. Every transform also works on a batch frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, events, total) by windows of event time."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "events")


def quiet_batches(events: DataFrame, key: str | None, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, events): events closer together than gap are one batch, which ends when nothing came for that long."""
    e = events.withWatermark("ts", late) if late else events
    w = F.session_window("ts", gap)
    g = e.groupBy(w, key) if key else e.groupBy(w)
    return g.agg(F.count("*").alias("events")).select(*([key] if key else []), F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


_SEEN = "last_us bigint"


def _debounce(key: str, gap_us: int):
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(int(t) for b in batches for t in b["us"])
        out = []
        for t in times:
            if last is None or t - last >= gap_us:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "us": pd.Series(out, dtype="int64")})

    return run


def debounced_stream(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """(key, us) of the events accepted: those at least the gap after the last accepted one of their key. Keeps one number a key."""
    e = events.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kind = dict(events.dtypes)[key]
    return e.groupBy(key).applyInPandasWithState(_debounce(key, int(gap_seconds * 1e6)), f"{key} {kind}, us bigint", _SEEN, "append", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """The same of a batch. The chain of accepted events runs within runs of a key whose events follow each other within the gap, so a key of very many events is
    cut into such runs first, and no task holds more than one run's times."""
    from pyspark.sql import Window

    gap = int(gap_seconds * 1e6)
    e = events.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    before = F.lag("us").over(Window.partitionBy(key).orderBy("us"))
    e = e.withColumn("opens", F.coalesce((F.col("us") - before >= gap).cast("int"), F.lit(1)))
    e = e.withColumn("run", F.sum("opens").over(Window.partitionBy(key).orderBy("us").rowsBetween(Window.unboundedPreceding, 0)))
    times = e.groupBy(key, "run").agg(F.array_sort(F.collect_list("us")).alias("times"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    take = lambda a, t: F.when(a["last"].isNull() | (t - a["last"] >= gap), F.struct(t.alias("last"), F.concat(a["kept"], F.array(t)).alias("kept"))).otherwise(a)
    return times.select(key, F.explode(F.aggregate("times", start, take)["kept"]).alias("us"))


def read_new_files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream; changed files come as new versions."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def run_available(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Works all that is there and stops. batch is called once a batch, perhaps again after a failure, so it must write by key."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()


def tail_index(store, batch: DataFrame, version: int) -> None:
    """Indexes a batch of new messages (conversation_id, sequence, role, content): the touched conversations are segmented again whole, their exchanges replaced."""
    from colloquy.operators import mutations, segments

    m, x = store.table("messages"), store.table("exchanges")
    all_m = mutations.upsert(m, batch.dropDuplicates(["conversation_id", "sequence"]), ["conversation_id", "sequence"])
    touched = batch.select("conversation_id").distinct()
    again = all_m.join(touched, "conversation_id", "left_semi")
    fresh = segments.exchange_texts(again, segments.segments(again))
    store.commit({"messages": all_m, "exchanges": mutations.delete(x, touched, ["conversation_id"]).unionByName(fresh)})
