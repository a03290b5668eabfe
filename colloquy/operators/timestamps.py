"""Problem 4: timestamps in mixed formats and zones, as one UTC instant each.

Method: the raw strings are reduced to a dictionary of distinct (text, zone) entries, each entry is parsed once through all formats, the dictionary is kept in
a table that grows by the entries not yet in it, and the instants are joined back to the rows. zone is NULL for a text that bears its own, so that a text
common to many projects is parsed once.

A NULL, empty or blank text denotes no instant. A local time that occurs twice means the earlier instant; one that the clocks skip, and an impossible date,
denote none. Repeated rows share an entry; other columns of the rows pass through whatever their names, as the dictionary's own are told apart.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import ZERO_WIDTH, map_rows, new_path, table

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{6}Z$"
EPOCH = datetime(1970, 1, 1)
MONTHS = {m: i // 2 % 12 + 1 for i, m in enumerate("jan january feb february mar march apr april may may jun june jul july aug august sep september oct october nov november dec december".split())} | {"sept": 9}
_MON = r"(?P<mon>[A-Za-z]{3,9})\.?"
_DAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?"
_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"\s*(?P<zone>.*)"
_SHAPES = [
    re.compile(p + _ZONE, re.DOTALL | re.ASCII | re.IGNORECASE)
    for date in (r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})", r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})", r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})", r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})", _DAY + r"(?P<d>\d{1,2})(?:st|nd|rd|th)?[\s-]" + _MON + r"[,\s-]\s*(?P<y>\d{4})", _DAY + _MON + r"\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})")
    for p in (date + r"(?:T|,?\s+(?:at\s+)?)" + _TIME, date + r"(?![\d:])")
] + [
    re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[T ](?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?" + _ZONE, re.DOTALL | re.ASCII | re.IGNORECASE),
    re.compile(_DAY + _MON + r"\s+(?P<d>\d{1,2})\s+" + _TIME + r"\s+(?:(?P<zone>[A-Za-z]{3,5})\s+)?(?P<y>\d{4})", re.ASCII | re.IGNORECASE),
]
_NUMBER = re.compile(r"(\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?", re.ASCII)
_OFFSET = re.compile(r"(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?\s*(?:\[[^\]]*\]|\([^)]*\))?", re.ASCII | re.IGNORECASE)
_UTC = re.compile(r"(?:Z|UTC|GMT|UT)\s*(?:\[[^\]]*\]|\([^)]*\))?", re.IGNORECASE)
_NAMED = re.compile(r"[\[(]?([A-Za-z]+(?:[_/+-][A-Za-z0-9_+-]+)+|[A-Z]{2,5})[\])]?")
_FIXED = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "WET": 0, "WEST": 1, "BST": 1, "JST": 9, "AEST": 10, "AEDT": 11}
_EDGE = re.compile(rf"^[\s{ZERO_WIDTH}]+|[\s{ZERO_WIDTH}]+$")


@lru_cache(None)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ValueError, OSError, KeyError):
        return None


def _local(t: datetime, zone: ZoneInfo) -> timedelta | None:
    """The UTC offset at that wall-clock time, the first where it occurs twice; None where the clocks skip it."""
    offset = t.replace(tzinfo=zone).utcoffset()
    back = (t - offset).replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
    return offset if back == t else None


def instant(text: str | None, home: str | None = None) -> int | None:
    """Microseconds since 1970-01-01 UTC. home: the zone that holds where the text has none."""
    s = _EDGE.sub("", text or "")
    if m := _NUMBER.fullmatch(s):
        whole, part = m[1], m[2] or ""
        scale = {13: 3, 16: 6, 19: 9}.get(len(whole), 0)
        digits = whole + part
        places = scale + len(part)
        return int(digits) // 10 ** (places - 6) if places >= 6 else int(digits) * 10 ** (6 - places)
    for shape in _SHAPES:
        if m := shape.fullmatch(s):
            break
    else:
        return None
    g = m.groupdict()
    month = MONTHS.get(g["mon"].lower()) if g.get("mon") else int(g["m"])
    hour = int(g.get("H") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"] in "pP")
    try:
        t = datetime(int(g["y"]), month or 0, int(g["d"]), hour, int(g.get("M") or 0), int(g.get("S") or 0))
    except ValueError:
        return None
    us, zone = int(((g.get("f") or "") + "000000")[:6]), g.get("zone") or ""
    if not zone:
        offset = _local(t, z) if home and (z := _zone(home)) else timedelta(0)
    elif _UTC.fullmatch(zone):
        offset = timedelta(0)
    elif z := _OFFSET.fullmatch(zone):
        hours, minutes, seconds = (int(x or 0) for x in z.groups()[1:])
        if hours > 18 or minutes > 59 or seconds > 59:
            return None
        offset = timedelta(hours=hours, minutes=minutes, seconds=seconds) * (1 if z[1] == "+" else -1)
    elif (z := _NAMED.fullmatch(zone)) and z[1].upper() in _FIXED:
        offset = timedelta(hours=_FIXED[z[1].upper()])
    elif z and (named := _zone(z[1])):
        offset = _local(t, named)
    else:
        return None
    return None if offset is None else ((t - offset - EPOCH) // timedelta(seconds=1)) * 1_000_000 + us


#: Texts that surely bear a zone or need none: a number, or an end of Z, UTC, GMT, an offset or a bracketed zone.
_OWN_ZONE = r"^\s*[0-9]+(?:[.][0-9]+)?\s*$|(?:Z|UTC|GMT|\]|:[0-9]{2}(?:[.,][0-9]+)?\s*(?:UTC|GMT)?[+-][0-9]{2}:?[0-9]{2})\s*$"
_ENTRY = "ts_text string, ts_zone string, instant_us bigint"


def entry_zone(text: Column, zone: Column) -> Column:
    return F.when(~text.rlike(_OWN_ZONE), zone)


def grown(spark: SparkSession, store: str, rows: DataFrame) -> DataFrame:
    """The dictionary at store, after the entries (ts_text, ts_zone) of rows that it lacks were parsed and appended. Appending is one committed job, so a lost
    executor leaves no half-written entry."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    new = rows.select("ts_text", "ts_zone").where("ts_text is not null").distinct()
    if there:
        old = spark.read.schema(_ENTRY).parquet(store).select(F.col("ts_text").alias("o_text"), F.col("ts_zone").alias("o_zone"))
        new = new.join(old, F.col("ts_text").eqNullSafe(F.col("o_text")) & F.col("ts_zone").eqNullSafe(F.col("o_zone")), "left_anti")
    map_rows(new, lambda r: [r | {"instant_us": instant(r["ts_text"], r["ts_zone"])}], _ENTRY, 4096).write.mode("append").parquet(store)
    return spark.read.schema(_ENTRY).parquet(store)


def normalised(rows: DataFrame, text: str, zone: str | None = None, store: str | None = None) -> DataFrame:
    """rows with instant_us, microseconds since 1970-01-01 UTC or NULL, for the column text; zone names the column of the zone that holds where text has none.

    A column instant_us that rows has already is replaced. store: the folder of the dictionary, kept between calls. Without one, a new folder in the shared directory is used."""
    spark = rows.sparkSession
    t = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(text).alias("ts_text"), entry_zone(F.col(text), F.col(zone) if zone else F.lit(None).cast("string")).alias("ts_zone"))
    entries = grown(spark, store or new_path(spark, "instants"), t).select(F.xxhash64("ts_text", "ts_zone").alias("o_hash"), F.col("ts_text").alias("o_text"), F.col("ts_zone").alias("o_zone"), "instant_us")
    t = t.withColumn("ts_hash", F.xxhash64("ts_text", "ts_zone"))
    on = (F.col("ts_hash") == F.col("o_hash")) & (F.col("ts_text") == F.col("o_text")) & F.col("ts_zone").eqNullSafe(F.col("o_zone"))
    return t.join(entries, on, "left").select(*[F.col("row").getField(c).alias(c) for c in rows.columns if c != "instant_us"], "instant_us")


# the tables' own fields


def zones(spark: SparkSession, d: str) -> DataFrame:
    """(conversation_id, time_zone) of the latest header row of each conversation whose project has a zone."""
    header = table(spark, d, "conversations").where("conversation_id is not null").groupBy("conversation_id").agg(F.max_by("project_id", F.coalesce("indexed_at", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("project_id"))
    named = table(spark, d, "project_settings").where("project_id is not null").groupBy("project_id").agg(F.max("time_zone").alias("time_zone"))
    return header.join(F.broadcast(named), "project_id").select("conversation_id", "time_zone")


def fields(spark: SparkSession, d: str, wanted: Column | None = None) -> DataFrame:
    """(field, conversation_id, sequence, text, time_zone), distinct, without rows whose key is NULL."""
    m = table(spark, d, "messages").where("sequence is not null").select(F.lit("messages.timestamp").alias("field"), "conversation_id", "sequence", F.col("timestamp").alias("text"))
    c = table(spark, d, "conversations").select(F.lit("conversations.created_at"), "conversation_id", F.lit(-1), "created_at")
    rows = m.unionAll(c).where("conversation_id is not null")
    rows = rows if wanted is None else rows.where(wanted)
    # only rows whose text may lack a zone need their conversation's
    own = F.col("text").isNull() | F.col("text").rlike(_OWN_ZONE)
    bare = rows.where(~own).join(zones(spark, d), "conversation_id", "left").select("field", "conversation_id", "sequence", "text", "time_zone")
    return bare.unionAll(rows.where(own).withColumn("time_zone", F.lit(None).cast("string")))


def found(spark: SparkSession, d: str) -> DataFrame:
    """(field, conversation_id, sequence, instant_us) of the texts that denote an instant and are not in canonical form."""
    t = fields(spark, d, F.col("text").isNotNull() & ~F.col("text").rlike(CANONICAL))
    return normalised(t, "text", "time_zone").where("instant_us is not null").select("field", "conversation_id", "sequence", "instant_us").distinct()


def instants(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct timestamp text of a key, with its instant or NULL."""
    return normalised(fields(spark, d), "text", "time_zone").select("field", "conversation_id", "sequence", "text", "instant_us").distinct()
