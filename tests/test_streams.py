from pyspark.sql import functions as F

from colloquy.operators import segments as SG
from colloquy.sources.store import Store
from colloquy.streaming import events as E

DATA = [(u, f"2024-01-01 00:00:{s:02d}") for u, times in ((1, (0, 1, 2, 3, 5, 9, 30)), (2, (7, 7, 8, 20))) for s in times]
WANT = [(1, 0), (1, 2), (1, 5), (1, 9), (1, 30), (2, 7), (2, 20)]


def frame(spark):
    return spark.createDataFrame(DATA, "user_id int, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))


def seconds(df):
    return sorted((r["user_id"], r["us"] // 1_000_000 % 60) for r in df.collect())


def test_debounce_counts_from_the_last_accepted(spark):
    assert seconds(E.debounced(frame(spark), "user_id", 2)) == WANT


def test_debounce_as_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark).write.parquet(src)
    out = []
    s = E.read_new_files(spark, src, "user_id int, ts timestamp_ntz")
    E.run_available(E.debounced_stream(s, "user_id", 2), str(tmp_path / "cp"), lambda df, n: out.extend(seconds(df)))
    assert sorted(out) == WANT


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    src, out = str(tmp_path / "in"), {}
    schema = "ts timestamp, event_type string, value double"
    for i, times in enumerate((["2024-01-01 00:00:00", "2024-01-01 05:00:00"], ["2024-01-01 00:10:00", "2024-01-01 05:30:00"])):
        spark.createDataFrame([(t, "a", 1.0) for t in times], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        df = E.tumbling(E.read_new_files(spark, src, schema), "1 hour", "10 minutes")
        E.run_available(df, str(tmp_path / "cp"), lambda b, n: out.update({r["start"].hour: r["events"] for r in b.collect()}), "update")
    assert out == {0: 1, 5: 2}


def test_tail_index_equals_the_batch(spark, tmp_path):
    m = spark.createDataFrame([("c", i, r, f"{r} says something long enough {i}") for i, r in enumerate(["user", "assistant", "user", "assistant", "user"])], "conversation_id string, sequence int, role string, content string")
    s = Store(spark, str(tmp_path / "store"))
    first = m.where("sequence < 3")
    s.commit({"messages": first, "exchanges": SG.exchange_texts(first, SG.segments(first))})
    E.tail_index(s, m.where("sequence >= 3"), 0)
    E.tail_index(s, m.where("sequence >= 3"), 0)  # once more, as after a failure
    want = SG.exchange_texts(m, SG.segments(m))
    assert sorted(map(tuple, s.table("exchanges").collect())) == sorted(map(tuple, want.collect()))
