"""Query texts: parsing and classification. A query is a short string given by a user, so both are plain functions on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

# Patterns and words by which a query is classified.
KEYWORD_PATTERNS = [
    r"\.\w+:\d+",
    r"\b\w+\.(py|ts|js|tsx|jsx|java|cpp|c|h|go|rs|rb|php|md|txt|json|toml|yaml|yml|sql|sh|bat|ps1|css|html)\b",
    r"\bline\s+\d+",
    r"error\s+code\s+\d+",
    r"\b[A-Z_]{5,}\b",
    r"\bfunction\s+\w+",
    r"\bclass\s+\w+",
    r"\bdef\s+\w+",
    r"\bimport\s+[\w.]+",
    r"\bfrom\s+[\w.]+\s+import",
    r"\bTODO\b|\bFIXME\b|\bNOTE\b|\bBUG\b",
    r"[/_]\w+[/_]",
]
SEMANTIC_TERMS = [
    "architecture", "pattern", "design", "approach", "strategy", "concept", "principle", "methodology", "framework", "paradigm", "philosophy", "rationale", "tradeoff", "pros and cons", "advantages", "disadvantages",
    "best practice", "anti-pattern", "recommendation", "guideline", "overview", "introduction", "explanation", "understanding", "why", "how does", "what is", "when to", "should i", "comparison", "difference between", "versus", "vs",
    "alternative", "option", "choice", "decide",
]
_CAPITALS = 4  # the pattern that must be matched in its own case
_QUESTIONS = ("how", "why", "what", "when", "where")


@dataclass
class Parsed:
    phrases: list[str] = field(default_factory=list)
    must: list[str] = field(default_factory=list)
    without: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    since: datetime | None = None
    until: datetime | None = None


_SPANS = {"today": 0, "last week": 7, "last 7 days": 7, "last 30 days": 30, "last month": 30, "last 3 months": 90}


def parse(query: str, now: datetime | None = None) -> Parsed:
    """Phrases in quotes, +must, -without (only where a word begins), a span of days, then AND, OR or bare words. now makes spans reproducible."""
    out = Parsed()

    def take(pattern: str, into: list[str], rest: str) -> str:
        into += [next(g for g in m.groups() if g) for m in re.finditer(pattern, rest)]
        return re.sub(pattern, " ", rest)

    rest = take(r'"([^"]+)"|(?<!\w)\'([^\']+)\'', out.phrases, query)
    rest = take(r"(?<!\S)\+(\w+)", out.must, rest)
    rest = take(r"(?<!\S)-(\w+)", out.without, rest)
    for words, days in _SPANS.items():
        if re.search(rf"\b{words}\b", rest, re.I):
            if out.since is None and now is not None:
                out.since, out.until = (now.replace(hour=0, minute=0, second=0, microsecond=0) if days == 0 else now - timedelta(days=days)), now
            rest = re.sub(rf"\b{words}\b", " ", rest, flags=re.I)
    rest = " ".join(rest.split())
    for glue, into in ((r"\s+AND\s+", out.must), (r"\s+OR\s+", out.should)):
        if re.search(glue, rest, re.I):
            into += [t.strip() for t in re.split(glue, rest, flags=re.I) if t.strip()]
            return out
    out.should = rest.split()
    return out


def classify(query: str) -> tuple[str, float, float, float]:
    """(keyword, semantic or balanced; keyword weight; semantic weight; confidence)."""
    low = query.lower()
    patterns = sum(bool(re.search(p, query, 0 if i == _CAPITALS else re.I)) for i, p in enumerate(KEYWORD_PATTERNS))
    path = any(c in query for c in "/\\.")
    keyword = 2.5 * patterns + 2.0 * any(c in query for c in "\"'") + 1.5 * (path and not any(t in low for t in ("architecture", "design", "pattern"))) + 1.0 * (len(query) < 15 and (path or patterns > 0))
    starts = low.startswith(tuple(q + " " for q in (*_QUESTIONS, "should", "can")))
    semantic = 2.0 * sum(t in low for t in SEMANTIC_TERMS) + 2.0 * (len(query) > 80 and any(q in low for q in _QUESTIONS))
    semantic += 4.0 if starts else 2.0 * any(q + " " in low for q in _QUESTIONS)
    total = keyword + semantic
    if not total:
        return "balanced", 0.5, 0.5, 0.3
    if keyword > 2 * semantic and not starts:
        return "keyword", 0.8, 0.2, min(0.9, keyword / (total + 1))
    if semantic > 1.5 * keyword or starts:
        return "semantic", 0.2, 0.8, min(0.9, semantic / (total + 1))
    return "balanced", 0.5, 0.5, 0.5
