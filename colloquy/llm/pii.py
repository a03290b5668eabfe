"""Problem 2: personal information in free text.

Method: a linear-chain conditional random field over word-shape, context and name-lexicon features (`crf`), trained from a small labelled table (`labelled`), decoded
by Viterbi in numpy batches. Texts are cut into paragraphs, each distinct paragraph is decoded once, whole. What the model marks is confirmed by a plain
check of its shape (`confirmed`); nothing is found by a path beside the model.

NULL texts and rows with a NULL key give no row; empty and blank texts have no entity and pass unchanged; repeated rows give the same entities; extra columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import table
from colloquy.llm import common, crf, models

_MASKED = re.compile(r"^[*xX\W]*$|\*{2,}|\[(?:EMAIL|PHONE|NAME|SSN|ADDRESS)\]")
_EMAIL = re.compile(r"(?is)[\w.+\-']+\s*(?:@|＠|%40|&#64;|[\[({]\s*at\s*[\])}]|\sat\s)\s*[\w\-]+.*[\w]")


def confirmed(text: str, begin: int, end: int, label: str, parts: dict[str, int]) -> bool:
    s = text[begin:end]
    if _MASKED.search(s):
        return False
    if label == "email":
        after = text[end : end + 2]
        return bool(_EMAIL.search(s)) and not re.match(r"(?i)(?:git|hg)\b", s) and not re.match(r":[\w/~]", after)
    digits = sum(c.isdigit() for c in s)
    if label == "phone":
        return 7 <= digits <= 18
    if label == "id_number":
        return digits >= 5
    if label == "street_address":
        return digits >= 1 and any(c.isalpha() for c in s)
    words = re.findall(r"[^\W\d_]+", s)
    return sum(len(w) > 1 for w in words) >= 2 or len(words) >= 2 or any(parts.get(w.lower(), 0) >= 2 for w in words) or bool(re.search(r"-san\b", s))


def finder(given: tuple[str, ...], family: tuple[str, ...]):
    """A function from texts to the (begin, end, entity type) found in each."""
    state: dict = {}

    def find(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if not state:
            state.update(lexer=models.pii_lexer(given, family), crf=models.model("pii"), parts=models.name_parts(given, family))
        t = state["lexer"](texts)
        m = state["crf"]
        found = crf.spans(t, m.decode(t), len(texts))
        return [[(a, b, m.labels[k]) for a, b, k in s if confirmed(x, a, b, m.labels[k], state["parts"])] for x, s in zip(texts, found)]

    return find


def names(spark: SparkSession, d: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The lexicon is a fixed table of some hundred rows."""
    rows = table(spark, d, "name_lexicon").where("name_part is not null").select("name_part", "part_kind").distinct().collect()
    return tuple(tuple(sorted(r["name_part"] for r in rows if r["part_kind"] == k)) for k in ("given", "family"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """(field, conversation_id, sequence, entity_type), distinct."""
    parts = common.paragraphs(common.fields(spark, d))
    spans = common.decoded(common.dictionary(parts), finder(*names(spark, d)))
    types = spans.select("k1", "k2", F.explode(F.array_distinct(F.transform("spans", lambda s: s["label"]))).alias("entity_type"))
    return parts.select("field", "conversation_id", "sequence", "k1", "k2").join(types, ["k1", "k2"]).select("field", "conversation_id", "sequence", "entity_type").distinct()


def masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text, with each entity replaced by a placeholder of its type and all else untouched."""
    texts = common.fields(spark, d)
    spans = common.decoded(common.dictionary(common.paragraphs(texts)), finder(*names(spark, d)))
    return common.replaced(texts, spans, "[%s]")
