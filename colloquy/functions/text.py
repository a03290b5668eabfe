"""Text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that make a word a path.
EXTENSIONS = (
    "py js ts tsx jsx json jsonl toml yaml yml md html css scss sql sh bash zsh cfg ini txt xml csv parquet lock env dockerfile "
    "rs go java c h cpp hpp rb php swift kt scala ex exs erl hs ml r jl vue svelte astro prisma graphql proto tf conf log pid sock wasm map"
).split()
# A path is looked for in a run of path characters, up to the last known extension in it; so no text is scanned twice, however long its runs are.
RUN = r"[A-Za-z0-9_./~\\-]+"
PATH = r"(?i)^(.*\.(?:" + "|".join(sorted(EXTENSIONS, key=len, reverse=True)) + r"))(?:[^A-Za-z0-9_].*)?$"
FENCE = r"(?s)```(?:[A-Za-z0-9_]+)?\n(.*?)```"
WORDS = "[^a-z0-9]+"


def words(text: Column) -> Column:
    """The lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def field_words(text: Column) -> Column:
    """Lower-case words, split at white space and at _ - / \\ . and :"""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[_\-/\\.:]", " "), r"\s+"), lambda w: w != "")


def _paths(text: Column) -> Column:
    runs = F.filter(F.regexp_extract_all(text, F.lit(RUN), 0), lambda r: r.contains("."))
    return F.filter(F.transform(runs, lambda r: F.regexp_extract(r, PATH, 1)), lambda p: p != "")


def file_paths(text: Column) -> Column:
    """Paths in order of first appearance, those in backticks first, with forward slashes and without a leading ./"""
    plain = lambda p: F.regexp_replace(F.translate(p, "\\", "/"), r"^\./", "")
    quoted = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), 1), _paths))
    return F.array_distinct(F.transform(F.concat(quoted, _paths(text)), plain))


def code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FENCE), 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path, empty if it has none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def all_phrases(text: Column, phrases: list[str]) -> Column:
    """Every phrase occurs, in any case."""
    out = F.lit(True)
    for p in phrases:
        out = out & F.lower(text).contains(p.lower())
    return out


def none_of(text: Column, terms: list[str]) -> Column:
    """No term occurs, in any case."""
    out = F.lit(True)
    for t in terms:
        out = out & ~F.lower(text).contains(t.lower())
    return out


def snippet(text: Column, phrases: list[str], terms: list[str], length: int = 200, before: int = 100) -> Column:
    """The part of a text around the first phrase that occurs, else around the first term, else its beginning; dots mark where it was cut."""
    low = F.lower(text)
    hits = [F.when(F.locate(p.lower(), low) > 0, F.locate(p.lower(), low)) for p in [*phrases, *terms]]
    at = F.coalesce(*hits, F.lit(0))
    begin = F.greatest(at - 1 - before, F.lit(0))
    end = F.least(at - 1 + length, F.length(text))
    around = F.concat(F.when(begin > 0, "...").otherwise(""), F.substr(text, begin + 1, end - begin), F.when(end < F.length(text), "...").otherwise(""))
    first = F.concat(F.substring(text, 1, length), F.when(F.length(text) > length, "...").otherwise(""))
    return F.when(at > 0, around).otherwise(first)


def short_hash(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def facet_id(type_: Column, text: Column) -> Column:
    return short_hash(type_, text)


def level_facet_id(type_: Column, level: Column, text: Column) -> Column:
    return short_hash(type_, level, text)


def room_id(type_: Column, key: Column, project: Column) -> Column:
    return short_hash(type_, key, F.coalesce(project, F.lit("")))


def exchange_id(conversation: Column, start: Column, end: Column) -> Column:
    """A stable id, so that indexing again gives the same one."""
    return F.md5(F.concat_ws("|", conversation, start.cast("string"), end.cast("string")))
