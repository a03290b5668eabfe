"""Problem 5: rows that fail to parse.

Method: every column of a line is loaded as nullable text (`as_text`), cast and constraint rules are evaluated as column expressions into an array of reasons
(`issues`), and the rows are split by whether that array is empty (`loaded`, `found`, `parse_issues`). Python only takes lines apart into text; all rules run in
the JVM.

Blank lines and csv headers (line 1 equal to the header) are neither loaded nor issues; a NULL line is blank. Rows with a NULL file_path or line_number are no
case. Lines delivered twice give one row. A file of another kind is an issue. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import BLANK, map_rows, table

HEADER = "file_path,conversation_id,status,file_size,mtime_ns,error_message,updated_at".split(",")
TYPES = ("user", "assistant", "file-history-snapshot", "session_meta", "response_item")
STATUS = ("indexed", "invalid", "pending", "skipped")
_CSV = re.compile(r'"((?:[^"]|"")*)"(?=,|$)|([^",]*)(?=,|$)')
_JSON_COLUMNS = ("type", "timestamp", "role", "content", "uuid", "parentUuid", "sessionId", "cwd")
#: Kinds are the JSON kind of a value: object, string, objects (an array of objects), other, or NULL if absent.
TEXT = "file_path string, line_number int, line string, dialect string, syntax string, fields int, " + ", ".join(f"c{i} string" for i in range(len(HEADER))) + ", " + ", ".join(f"j_{c} string" for c in _JSON_COLUMNS) + ", k_type string, k_timestamp string, k_body string, k_content string, content_json string, payload_json string"


def _refuse(s: str) -> None:
    raise ValueError(f"{s} is not JSON")


def _kind(x: object) -> str:
    if isinstance(x, dict):
        return "object"
    if isinstance(x, str):
        return "string"
    return "objects" if isinstance(x, list) and all(isinstance(o, dict) for o in x) else "other"


def _plain(x: object) -> str | None:
    return x if isinstance(x, str) else None


def _json_text(line: str) -> dict:
    try:
        o = json.loads(line, strict=False, parse_constant=_refuse, parse_int=lambda s: int(s) if len(s) < 4000 else Decimal(s))
    except RecursionError:
        return {"syntax": "nested too deeply"}
    except ValueError as e:
        return {"syntax": str(e)[:200]}
    if not isinstance(o, dict):
        return {"syntax": "not a JSON object"}
    out = {f"j_{c}": _plain(o.get(c)) for c in ("type", "timestamp", "uuid", "parentUuid", "sessionId", "cwd")}
    out |= {f"k_{c}": _kind(o[c]) for c in ("type", "timestamp") if c in o}
    body = o.get("payload" if o.get("type") == "response_item" else "message")
    if body is not None:
        out["k_body"] = _kind(body)
    if isinstance(body, dict):
        out["j_role"] = _plain(body.get("role"))
        if "content" in body:
            content = body["content"]
            out["k_content"], out["content_json"] = _kind(content), json.dumps(content, default=str)
            out["j_content"] = content if isinstance(content, str) else "\n\n".join(x["text"] for x in content if isinstance(x.get("text"), str)) if out["k_content"] == "objects" else None
    if "payload" in o:
        out["payload_json"] = json.dumps(o["payload"], default=str)
    return out


def _csv_text(line: str) -> dict:
    line, at, out = re.sub(r"\r?\n?\Z", "", line), 0, []
    while True:
        m = _CSV.match(line, at)
        if not m:
            return {"syntax": f"quotes are wrong at character {at}"}
        out.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        if m.end() == len(line):
            break
        at = m.end() + 1
    return {"fields": len(out)} | {f"c{i}": x for i, x in enumerate(out[: len(HEADER)])}


def as_text(lines: DataFrame) -> DataFrame:
    """Each line that is not blank, once, with every column as nullable text; headers have the dialect `header`."""

    def one(r: dict) -> list[dict]:
        path = r["file_path"].lower()
        if path.endswith(".csv"):
            got = _csv_text(r["line"].lstrip("﻿") if r["line_number"] == 1 else r["line"])
            header = r["line_number"] == 1 and [got.get(f"c{i}") for i in range(len(HEADER))] == HEADER and got.get("fields") == len(HEADER)
            return [r | {"dialect": "header" if header else "csv"} | got]
        if path.endswith(".jsonl"):
            return [r | {"dialect": "jsonl"} | _json_text(r["line"])]
        return [r | {"dialect": "other"}]

    rows = lines.where("file_path is not null and line_number is not null and line is not null").select("file_path", F.col("line_number").cast("int").alias("line_number"), "line").where(~F.col("line").rlike(BLANK))
    return map_rows(rows.distinct(), one, TEXT)


_ISO = r"^(\d{4})-?(\d\d)-?(\d\d)T(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?(Z|[+-]\d\d(?::?\d\d)?)$"


def iso_micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of an ISO 8601 date-time with zone on a real date, else NULL."""
    g = lambda i: F.regexp_extract(c, _ISO, i)
    n = lambda i: F.when(g(i) == "", F.lit(0)).otherwise(g(i).try_cast("int"))
    day = F.concat_ws("-", g(1), g(2), g(3)).try_cast("date")
    zone = F.regexp_replace(g(8), ":", "")
    zh, zm = F.coalesce(F.substring(zone, 2, 2).try_cast("int"), F.lit(0)), F.coalesce(F.substring(zone, 4, 2).try_cast("int"), F.lit(0))
    offset = F.when(zone == "Z", F.lit(0)).otherwise((zh * 60 + zm) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    micros = F.rpad(F.substring(g(7), 1, 6), 6, "0").try_cast("int")
    total = ((F.unix_date(day).cast("long") * 24 + n(4)) * 60 + n(5) - offset) * 60 + n(6)
    ok = c.rlike(_ISO) & day.isNotNull() & n(4).between(0, 23) & n(5).between(0, 59) & n(6).between(0, 59) & ((zone == "Z") | zh.between(0, 23) & zm.between(0, 59))
    return F.when(ok, total * 1_000_000 + micros)


def issues(text: DataFrame) -> DataFrame:
    """text with `issues`, the reasons why a line cannot be loaded, none where it can."""
    c = F.col
    absent = lambda x: F.coalesce(x, F.lit(""))
    sound = c("syntax").isNull()
    json_ok, csv_ok = (c("dialect") == "jsonl") & sound, (c("dialect") == "csv") & sound
    talk, item = json_ok & c("j_type").isin("user", "assistant"), json_ok & (c("j_type") == "response_item")
    object_ = absent(c("k_body")) == "object"
    full = csv_ok & (c("fields") == len(HEADER))
    digits = lambda i: full & ~c(f"c{i}").rlike("^[0-9]*$")
    rules = [
        (c("dialect") == "other", F.lit("neither jsonl nor csv")),
        (~sound, c("syntax")),
        (json_ok & ~absent(c("j_type")).isin(*TYPES), F.lit("type is missing or unknown")),
        (json_ok & c("k_timestamp").isNotNull() & iso_micros(c("j_timestamp")).isNull(), F.lit("timestamp is not an ISO 8601 date-time with zone on a real date")),
        (talk & ~object_, F.lit("message is not an object")),
        (talk & object_ & (absent(c("j_role")) != c("j_type")), F.lit("message.role is not type")),
        (talk & object_ & ~absent(c("k_content")).isin("string", "objects"), F.lit("message.content is neither a string nor an array of objects")),
        (item & ~object_, F.lit("payload is not an object")),
        (item & object_ & ~absent(c("j_role")).isin("user", "assistant"), F.lit("payload.role is neither user nor assistant")),
        (item & object_ & (absent(c("k_content")) != "objects"), F.lit("payload.content is not an array of objects")),
        (csv_ok & (c("fields") != len(HEADER)), F.concat(c("fields").cast("string"), F.lit(f" fields, not {len(HEADER)}"))),
        (full & ((absent(c("c0")) == "") | (absent(c("c1")) == "")), F.lit("file_path or conversation_id is empty")),
        (full & ~absent(c("c2")).isin(*STATUS), F.lit("status is unknown")),
        (digits(3), F.lit("file_size is not digits")),
        (digits(4), F.lit("mtime_ns is not digits")),
        (full & iso_micros(c("c6")).isNull(), F.lit("updated_at is not an ISO 8601 date-time with zone on a real date")),
    ]
    return text.withColumn("issues", F.array_compact(F.array(*[F.when(bad, why) for bad, why in rules])))


def checked(spark: SparkSession, d: str) -> DataFrame:
    return issues(as_text(table(spark, d, "raw_lines"))).where("dialect != 'header'")


def found(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, line_number) of the lines that fail."""
    return checked(spark, d).where(F.size("issues") > 0).select("file_path", "line_number").distinct()


def parse_issues(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, line_number, message): every reason of each line that fails."""
    return checked(spark, d).where(F.size("issues") > 0).select("file_path", "line_number", F.array_join("issues", "; ").alias("message")).distinct()


def loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines in typed fields; those of the other dialect are NULL."""
    t = checked(spark, d).where(F.size("issues") == 0)
    return t.select(
        "file_path", "line_number", "dialect", F.col("j_type").alias("type"), F.timestamp_micros(iso_micros(F.col("j_timestamp"))).alias("timestamp"), F.col("j_role").alias("role"), F.col("j_content").alias("content"), "content_json", "payload_json",
        F.col("j_uuid").alias("uuid"), F.col("j_parentUuid").alias("parent_uuid"), F.col("j_sessionId").alias("session_id"), F.col("j_cwd").alias("cwd"), F.col("c0").alias("source_path"), F.col("c1").alias("conversation_id"), F.col("c2").alias("status"),
        F.col("c3").try_cast("decimal(38,0)").alias("file_size"), F.col("c4").try_cast("decimal(38,0)").alias("mtime_ns"), F.when(F.col("c5") != "", F.col("c5")).alias("error_message"), F.timestamp_micros(iso_micros(F.col("c6"))).alias("updated_at"),
    )
