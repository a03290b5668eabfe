"""Problem 7: credentials in source code and prose.

Method: lexical tokens labelled by a linear-chain conditional random field with shape and context features (`crf`, `models.secret_lexer`); the Viterbi spans say
which literal characters are replaced. A span is then set to the bounds of the literal it lies in (quotes, separators and escapes stay, so the code around it stays
well-formed) and confirmed by a plain check of its value. Nothing is found by a path beside the model.

NULL texts and rows with a NULL key give no row; empty and blank texts pass unchanged; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common, crf, models

#: Characters that end a literal.
_STOP = set(" \t\r\n\"'`<>,;()[]{}")
_REFERENCE = re.compile(r"(?i)^(?:\$|\$?\{|%|<|\*{3,}|x{4,}$|your|change|replace|redact|example|placeholder|dummy|null$|none$|true$|false$|undefined$|process\.env|os\.|env\.|getenv|config|secrets?\.|args\.|self\.)|_here$|\*{4,}|\.\.\.$")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY")


def settled(text: str, begin: int, end: int, label: str) -> tuple[int, int] | None:
    """The span set to the literal it lies in, or None if it holds no literal value."""
    if label == "private_key":
        at = text.rfind("-----BEGIN", max(0, begin - 40), begin + 12)
        begin = at if at >= 0 else begin
        s = text[begin:end]
        while end < len(text) and text[end] == "-":
            end += 1
        body = re.sub(r"-----[A-Z ]+-----|\\[nr]|\s", "", s)
        return (begin, end) if _PEM.search(s) and len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 40 else None
    url = label == "password" and re.search(r"://[^\s/@:\"']*:\Z", text[max(0, begin - 60) : begin]) is not None
    while begin > 0 and text[begin - 1] not in _STOP and text[begin - 1] not in "=:&?" and not url:
        begin -= 1
    if begin < end and text[begin] in "=:":
        begin += 1
    stop = _STOP | {"@"} if url else _STOP | {"&"} if "&" not in text[begin:end] else _STOP
    while end < len(text) and text[end] not in stop and not (text[end] == "\\" and text[end + 1 : end + 2] in "nrt\"'"):
        end += 1
    while end > begin and text[end - 1] in " \t\r\n\"'`,;)":
        end -= 1
    while begin < end and text[begin] in " \t\r\n\"'`(":
        begin += 1
    v = text[begin:end]
    if len(v) < 4 or _REFERENCE.search(v):
        return None
    if label == "key_or_token" and (len(v) < 12 or not re.search(r"\d", v) and not re.search(r"[a-z].*[A-Z]|[A-Z].*[a-z]|^[A-Z]{16,}$", v) or re.match(r"\w+\(|https?:|data:", v)):
        return None
    if label == "password" and re.fullmatch(r"[A-Za-z_][\w.]*\([^)]*\)?|[a-z]+|[A-Z_]+", v):
        return None
    return begin, end


def find(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The (begin, end, kind) of the credentials in each text."""
    global _STATE
    if _STATE is None:
        _STATE = (models.secret_lexer(), models.model("secrets"))
    lexer, m = _STATE
    t = lexer(texts)
    out = []
    for x, marks in zip(texts, crf.spans(t, m.decode(t), len(texts))):
        got: list[tuple[int, int, str]] = []
        for a, b, k in marks:
            if (s := settled(x, a, b, m.labels[k])) and not (got and s[0] < got[-1][1]):
                got.append((*s, m.labels[k]))
        out.append(got)
    return out


_STATE = None


def found(spark: SparkSession, d: str) -> DataFrame:
    """(field, conversation_id, sequence, kind), distinct."""
    parts = common.paragraphs(common.fields(spark, d))
    spans = common.decoded(common.dictionary(parts), find)
    kinds = spans.select("k1", "k2", F.explode(F.array_distinct(F.transform("spans", lambda s: s["label"]))).alias("kind"))
    return parts.select("field", "conversation_id", "sequence", "k1", "k2").join(kinds, ["k1", "k2"]).select("field", "conversation_id", "sequence", "kind").distinct()


def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with each credential replaced by a bare word, which is valid inside quotes, in a URL and as a plain value."""
    texts = common.fields(spark, d)
    spans = common.decoded(common.dictionary(common.paragraphs(texts)), find)
    return common.replaced(texts, spans, "REDACTED_%s")
