"""Queries in the shape of streams, over the table of events."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from colloquy.core import new_path, table
from colloquy.plans.base import query
from colloquy.streaming import events as E


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return E.tumbling(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("WITH o AS (SELECT unnest([0, 1, 2, 3]) AS o) SELECT time_bucket(INTERVAL 15 MINUTE, ts) - o * INTERVAL 15 MINUTE AS start, count(*)::BIGINT AS events FROM events, o GROUP BY 1")
def events_sliding(spark, d):
    return E.sliding(table(spark, d, "events"), "1 hour", "15 minutes")


_SESSION = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL {0} THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL {0} AS "end", count(*)::BIGINT AS events FROM r GROUP BY user_id, run"""


@query(_SESSION.format("5 HOUR"))
def events_session(spark, d):
    return E.quiet_batches(table(spark, d, "events"), "user_id", "5 hours")


@query("""WITH e AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS opens FROM events), r AS (SELECT *, sum(opens) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS "end", count(*)::BIGINT AS events FROM r GROUP BY run""")
def quiet_period_batches(spark, d):
    return E.quiet_batches(table(spark, d, "events"), None, "5 minutes")


@query("""WITH RECURSIVE f AS (SELECT user_id, min(epoch_us(ts)) AS us FROM events GROUP BY 1 UNION ALL SELECT f.user_id, (SELECT min(epoch_us(e.ts)) FROM events e WHERE e.user_id = f.user_id AND epoch_us(e.ts) >= f.us + 86400000000::BIGINT) FROM f WHERE f.us IS NOT NULL) SELECT user_id, us FROM f WHERE us IS NOT NULL""")
def debounce_last_accepted(spark, d):
    return E.debounced(table(spark, d, "events"), "user_id", 86400)


@query("SELECT user_id, count(*)::BIGINT AS events, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1")
def stream_counts(spark, d):
    """The table read as a stream, all that is there, written by key, and read again."""
    out = new_path(spark, "stream")
    t = table(spark, d, "events")
    folder = f"{d}/events.parquet"
    # a single file cannot be a stream's source; its folder can, with a filter on the name
    src = spark.readStream.schema(t.schema).option("pathGlobFilter", "events.parquet" if os.path.isfile(folder) else "*.parquet").parquet(d if os.path.isfile(folder) else folder)
    agg = src.groupBy("user_id").agg(F.count("*").alias("events"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    E.run_available(agg, out + "/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/table"), "complete")
    return spark.read.parquet(f"{out}/table")
