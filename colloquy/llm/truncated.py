"""Problem 10: text cut off by field limits or in transfer.

Method: intact values are cut artificially to make positives; a hashed logistic regression is trained on closing characters, punctuation, last words, open
structures and the length against the limits of the source; every record is scored. The model is fitted on a bounded sample (SAMPLE records, CUTS examples of each);
lengths at which a source cuts and the counts of words are taken over all records, and all records are scored.

NULL and blank texts are complete: they are never flagged and count as records of their source. A NULL source is a source of its own. Repeated rows get equal
scores. Extra columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.core import blank, map_rows, map_slices, new_path, table

SAMPLE, CUTS, BITS, EPOCHS, ROUNDS, THRESHOLD = 4000, 10, 18, 5, 3, 0.5
_WORD = re.compile(r"[^\W\d_぀-ヿ㐀-鿿]+|[぀-ヿ㐀-鿿]{1,2}(?=[^぀-ヿ㐀-鿿]*$)")
_TERMINAL = re.compile(r"[.!?…。！？][\"'”»)\]`*]*(?=\s|$)")
MARKS = ["...", "…", " ...", "[...]", " [truncated]", "... (truncated)", "...[truncated]", " (truncated)", "... [cut]", "<truncated>", " [message truncated]", "…[cut off]", " (cut off)", "[snip]", " [output cut]", "\n[remaining text omitted]", "\n... 12 more lines", " [cut]", "\n(rest omitted)", " <snip>", " [continues]", "\n[text cut here]", " (continued)", " [...more]", "\n--- truncated ---", " [abgeschnitten]", " [tronqué]", " (以下省略)", " [log truncated]", "\n--- message clipped ---", " [clipped]", " <more>", "\n[body shortened]"]
#: Beginnings of structures, to be cut anywhere after their first characters.
STRUCTURES = ['{"rows": [4, 93, 45, 86, 12, 7, 19, 3, 58, 60, 2]}', '{"tool": "a_b", "args": {"path": "c/d.md", "rows": [70, 31, 38, 93, 10, 50, 85, 45, 9]}}', '{"tool": "read_file", "args": {"path": "lib/a/b.py", "rows": [4, 93, 45, 86, 12, 7]}, "note": "Now the reader keeps each value once."}', "```python\ndef first(rows):\n    for item in second(rows):\n        raise KeyError(item)\n    return third(rows, 12)\n```", "```js\nasync function first(opts) {\n  const a = await second(opts.b);\n  if (!opts.c) return null;\n  // later\n  items.push({ id: 3, kind: 'a' });\n}\n```", "see https://a.invalid/b/cde_f?from=x&to=y%20z&lang=en#part", "```sql\nSELECT a_id, count(*) AS n\nFROM b_log\nWHERE c > 3\nGROUP BY a_id;\n```", '[{"id":12,"kind":"a","n":3},{"id":14,"kind":"b","n":9}]']
#: What a cut in transfer leaves: half an entity, half an escape, a broken character.
BROKEN = ["&am", "&#x2", "&quo", "&l", "&", "&#3", "&#x27", "&nbs", "&g", "%", "%2", "%E", "\ufffd", "\ufffd", "\\u00", "\\", "\\u", "%C3%", "%", "%2", "?from=", "&to=", "=", "?q=a&lang="]
_FIELDS = "doc_id bigint, source string, size int, label int, weight double, last_word string, before string, features array<int>"


def _h(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> (32 - BITS)


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]+", lambda m: "C" if m[0][0].isupper() else "c", re.sub(r"\d+", "9", s))


def opened(text: str) -> list[str]:
    """The structures that are open at the end of the text."""
    out, inside = [], len(re.findall(r"(?m)^\s*(?:[#/*>-]+\s*)?```", text)) % 2 == 1
    if inside:
        out.append("fence")
    # closed blocks are whole, whatever stands in them
    rest = text[text.rfind("```") + 3 :] if inside else re.sub(r"(?s)```[^\n]*\n.*?```", " ", text)
    tail = rest if inside else rest[rest.rfind("\n\n") + 2 :] if "\n\n" in rest else rest
    stack: list[str] = []
    pair = {")": "(", "]": "[", "}": "{"}
    bare = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|`[^`\n]*`", "", tail)
    for c in bare:
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and stack and stack[-1] == pair[c]:
            stack.pop()
    out += [f"bracket{c}" for c in sorted(set(stack))]
    line = rest.rsplit("\n", 1)[-1]
    if line.count("`") % 2 and not inside:
        out.append("tick")
    if re.sub(r"\\.", "", line).count('"') % 2:
        out.append("quote")
    if line.count("«") > line.count("»") or line.count("「") > line.count("」") or line.count("“") > line.count("”"):
        out.append("quotemark")
    if line.count("**") % 2:
        out.append("bold")
    return out


def features(text: str, source: str | None) -> tuple[list[int], str, str]:
    """Hashed features of how the text ends, its last word and the one before."""
    t = text.rstrip("\n\r")
    end = t.rstrip()
    end_stop = re.search(r"[^\w\s]*$", end)[0]
    stop = end_stop[-4:]
    words = _WORD.findall(end[-400:].lower())
    w = ["", "", "", *words][-3:]
    last = words[-1] if words else ""
    line = end.rsplit("\n", 1)[-1]
    head = re.match(r"\s*(#+|[-*+>|]|\d+[.)]|```|\d{4}-\d\d-\d\dT?|\w+:|[{}\[\]<@$/]|def|return|import)?", line)[1] or ""
    head = re.sub(r"\d+", "9", head)[:6]
    token = re.search(r"\S*$", end)[0][-24:]
    n = len(line.split())
    many = "0" if n < 2 else "1" if n < 4 else "2" if n < 8 else "3"
    open_ = opened(end)
    kind = "stop" if re.fullmatch(r"[.!?。！？][\"'”»)\]`*]*", stop) else "none" if not stop else stop
    before = end[: len(end) - len(re.search(r"\S*$", end)[0])].split()[-2:]
    closing = re.search(r"(?:\[|\(|<|---|\.\.\.|…)\s*([^\[\](){}<>\n]{0,40})[\])>.…-]{0,3}$", end)
    said = re.findall(r"[^\W\d_]+", closing[1].lower()) if closing else []
    broken = re.search(r"(?:&#?\w{0,5}|%[0-9A-Fa-f]?|\ufffd|\\u?[0-9a-f]{0,3})$", end)
    mark = re.search(r"(?i)(?:\[|\(|<|\.\.\.|…)\s*(?:message\s|output\s|text\s)?(?:truncated|cut|cut off|snip|gekürzt|tronqué|truncado|省略|continues|more|\.\.\.)[^\n]{0,12}$", end)
    dots = stop.endswith(("...", "…"))
    f = [
        ("bias",), ("c1", end[-1:]), ("c2", end[-2:]), ("kind", kind), ("stop", end_stop[-6:]), ("w1", w[2], kind), ("w2", w[1], w[2], kind), ("w3", w[0], w[1], w[2], kind), ("w1n", w[2]), ("token", _shape(token)[-8:]), ("head", head, kind, many), ("src", source, kind), ("src2", source, kind, head),
        ("many", many, kind), ("mark", bool(mark)), ("dots", dots, len(words) and len(words[-1]) > 2), ("space", len(t) != len(end), kind), ("open", bool(open_), kind), ("w1open", bool(open_), w[2]), ("nl", text.endswith("\n"), kind),
        ("ctx", *before, _shape(token)[-4:], kind), ("srcwords", source, min(len(text.split()), 10), kind), ("cjk", "\u3040" <= end[-1:] <= "\u9fff", "。" in text, kind), ("query", bool(re.search(r"[=&?%#]$", token)), "://" in token), ("any", bool(open_), "{" in token or "," in line), ("ctx1", *before[-1:], "/" in token, kind), ("broken", bool(broken), _shape(broken[0])[:2] if broken else ""), *[("said", x, bool(mark)) for x in said[:6]], ("closing", closing is not None and len(said) in (1, 2, 3), end.endswith(("]", ")", ">", "-"))),
        *[("open", o) for o in open_], *[("openk", o, kind) for o in open_], ("suffix", last[-3:], kind), ("len", min(len(last), 9), kind), ("mid", _shape(token)[-3:], kind), ("single", "\n" not in end, many, kind), ("path", bool(re.search(r"[/\\]", token)), bool(re.search(r"\.\w{1,4}$", token)), kind),
    ]
    return [_h(*x) for x in f], last, words[-2] if len(words) > 1 else ""


def _examples(r: dict) -> list[dict]:
    """One record of the sample as training examples: itself, complete beginnings of it, and beginnings cut anywhere."""
    text, limit, out = r["text"], r["limit"], []
    rnd = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))

    def add(t: str, label: int, at_limit: bool, weight: float) -> None:
        if t.strip():
            f, last, before = features(t, r["source"])
            out.append({"doc_id": r["doc_id"], "source": r["source"], "size": limit if at_limit and limit else -1, "label": label, "weight": weight, "last_word": last, "before": before, "features": f})

    at = lambda p: rnd.random() < p
    add(text, 0, at(0.12), -2.0)  # taken as intact so far as the model does not hold it to be cut
    ends = [m for m in _TERMINAL.finditer(text)]
    for m in rnd.sample(ends, min(len(ends), 4)):
        whole = text[: m.end()]
        if not opened(whole):
            add(whole, 0, at(0.12), 1.0)
            bare = text[: m.start()]
            if not bare.endswith(".") and m[0][0] != "?":
                add(bare, 0, at(0.12), 1.0)  # complete, without its full stop
    for m in rnd.sample(blocks, min(len(blocks), 2)) if (blocks := [x.start() for x in re.finditer(r"\n\n", text)]) else ():
        if not opened(text[:m]):
            add(text[:m], 0, at(0.12), 1.0)
    if len(text) > 12:
        for _ in range(CUTS):
            k = rnd.randrange(6, len(text))
            whole = text[:k]
            if re.search(r"[.!?。！？`)\]}\"'*\n]\s*$", whole) or re.match(r"[.!?。！？](?:\s|$)", text[k:]) or re.match(r"\n", text[k:]):
                if not opened(whole):
                    continue
            x = rnd.random()
            mark = rnd.choice(MARKS) if x < 0.16 else rnd.choice(BROKEN) if x < 0.30 else ""
            if mark and mark[0] in "%?=" or mark == "&to=":
                whole = (text[: rnd.choice(ends).end()] if ends else whole) + rnd.choice([" More on https://a.invalid/b/cd_e?f=", " see https://a.example/x/y_z?k=v&l=", " https://b.invalid/u?w=a"])
                whole = whole[: whole.rfind("?")] if mark[0] == "?" else whole[: whole.rfind("=")] if mark[0] in "=&" else whole
            elif mark.startswith("&") and at(0.6):
                whole = whole.rstrip() + " "
            add(whole + mark, 1, at(0.5) and not mark, 1.0)
        for m in rnd.sample(ends, min(len(ends), 1)):
            piece = rnd.choice(STRUCTURES)
            k = rnd.randrange(14, len(piece) - 3)
            if "://" not in piece or piece[k - 1] in "=&?%#" or piece[k - 1].isalpha() and at(0.3):
                add(text[: m.end()] + rnd.choice(["\n\n", "\n", " "]) + piece[:k], 1, at(0.5), 1.0)
        for m in rnd.sample(ends, min(len(ends), 2)):
            add(text[: m.end()] + rnd.choice(MARKS[3:] + BROKEN[-6:]), 1, False, 1.0)
    return out


def limits(docs: DataFrame) -> DataFrame:
    """(source, limit) for the lengths at which a source cuts: at least 4 records of a source have that length, more than 8 times as many as have any length within 3 % around it on average."""
    by = docs.groupBy("source", "size").agg(F.count("*").alias("n"))
    around = by.select(F.col("source").alias("s2"), F.col("size").alias("near"), F.col("n").alias("m"))
    spikes = by.where("n >= 4 and size >= 40")
    near = spikes.join(around, F.col("source").eqNullSafe(F.col("s2")) & F.col("near").between(F.col("size") * 0.97, F.col("size") * 1.03) & (F.col("near") != F.col("size")), "left")
    return near.groupBy("source", "size", "n").agg((F.coalesce(F.sum("m"), F.lit(0)) / (F.col("size") * 0.06)).alias("usual")).where("n > 8 * usual").select("source", F.col("size").alias("limit"))


def _with_counts(endings: DataFrame, words: DataFrame) -> DataFrame:
    """endings with in how many records their last word stands before the end."""
    return endings.join(words, endings["last_word"] == words["word"], "left").select(*[endings[c] for c in endings.columns], F.coalesce("seen", F.lit(0)).alias("seen"))


def _rows(pdf_rows: list[dict]) -> np.ndarray:
    """Feature rows with the features that come from whole-table counts added."""
    out = []
    for r in pdf_rows:
        seen = min(int(r["seen"]).bit_length(), 6) if r["last_word"] else 9
        cjk = bool(r["last_word"]) and "぀" <= r["last_word"][-1] <= "鿿"
        out.append([*r["features"], _h("seen", seen if not cjk else 8), _h("limit", bool(r["at_limit"])), _h("seenlen", seen, min(len(r["last_word"]), 8))])
    width = max(map(len, out))
    a = np.full((len(out), width), -1, np.int64)
    for i, x in enumerate(out):
        a[i, : len(x)] = x
    return a


def fit(rows: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.15, decay: float = 3e-5, seed: int = 3) -> np.ndarray:
    """Logistic regression by AdaGrad; the last weight, of the absent feature, stays 0."""
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), 256):
            i = order[lo : lo + 256]
            x = rows[i]
            p = 1 / (1 + np.exp(-w[x].sum(1)))
            g = np.repeat((p - label[i]) * weight[i], x.shape[1])
            at, inv = np.unique(x.ravel(), return_inverse=True)
            grad = np.bincount(inv, weights=g) + decay * len(i) * w[at]
            seen[at] += grad**2
            w[at] -= rate * grad / np.sqrt(seen[at])
            w[-1] = 0
    return w


def _balanced(label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights with as much on positives as on negatives."""
    ones, zeros = weight[label == 1].sum(), weight[label == 0].sum()
    return np.where(label == 1, weight * (zeros / max(ones, 1e-9)), weight) if ones and zeros else weight


def _floor(source: np.ndarray, p: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The least weight of a value of each source. Where the model holds a third of a source to be cut, its values rather end without a stop by habit, as titles do."""
    out = np.full(len(p), 0.02)
    for s in np.unique(source):
        own = raw & (source == s)
        if own.any() and (p[own] > 0.5).mean() > 1 / 3:
            out[own] = 0.5
    return out


def scored(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, score) of every record of docs, which has doc_id, source and the text."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "source", F.col(text).alias("text")).where(~blank(F.col("text"))).withColumn("size", F.length("text"))
    lim = limits(d)
    # words before the end of a record, by the number of records that have them
    inner = F.array_distinct(F.slice(F.reverse(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\W\d_぀-ヿ㐀-鿿]+)"), 1)), 2, 2_000_000_000))
    words = d.select(F.explode(inner).alias("word")).groupBy("word").agg(F.count("*").alias("seen")).where("seen > 1")
    at_limit = lim.select(F.col("source").alias("ls"), F.col("limit").alias("ll"))
    largest = lim.groupBy("source").agg(F.max("limit").alias("limit"))
    plain = d.join(at_limit, d["source"].eqNullSafe(at_limit["ls"]) & (d["size"] == at_limit["ll"]), "left_anti")
    picked = plain.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    with_limit = picked.join(largest.select(F.col("source").alias("ls"), "limit"), picked["source"].eqNullSafe(F.col("ls")), "left").select("doc_id", "source", "text", F.coalesce("limit", F.lit(0)).alias("limit"))
    path = new_path(spark, "endings")
    map_rows(with_limit.repartition(8), _examples, _FIELDS, 64).write.parquet(path + "/examples")
    examples = spark.read.parquet(path + "/examples")
    needed = examples.select(F.col("last_word").alias("word"))

    def ending(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            f, last, before = features(r["text"], r["source"])
            out.append({"doc_id": r["doc_id"], "source": r["source"], "size": r["size"], "label": 0, "weight": 1.0, "last_word": last, "before": before, "features": f})
        return out

    map_slices(d, ending, _FIELDS).write.parquet(path + "/records")
    records = spark.read.parquet(path + "/records")
    words = words.join(needed.unionAll(records.select("last_word")).distinct(), "word", "left_semi")
    rows = [r.asDict() | {"at_limit": r["size"] > 0} for r in _with_counts(examples, words).orderBy("doc_id", "label", "last_word", "size").toLocalIterator()]
    w = None
    if rows:
        x, y, k = _rows(rows), np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])
        raw, k, source = k < 0, np.abs(k), np.array([str(r["source"]) for r in rows])
        # first without the values themselves, then with each so far as the last model holds it to be intact
        w = fit(x[~raw], y[~raw], _balanced(y[~raw], k[~raw]))
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-w[x].sum(1)))
            own = np.where(raw, k * np.maximum(1 - p, _floor(source, p, raw)), k)
            w = fit(x, y, _balanced(y, own))

    def score(part: list[dict]) -> list[dict]:
        if not part:
            return []
        z = w[_rows(part)].sum(1) if w is not None else np.zeros(len(part))
        return [{"doc_id": r["doc_id"], "source": r["source"], "score": float(1 / (1 + np.exp(-v)))} for r, v in zip(part, z)]

    r = _with_counts(records, words)
    r = r.join(at_limit, r["source"].eqNullSafe(at_limit["ls"]) & (r["size"] == at_limit["ll"]), "left").select(*[r[c] for c in r.columns], F.col("ll").isNotNull().alias("at_limit"))
    return map_slices(r, score, "doc_id bigint, source string, score double", 4096)


def found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id) of the records scored as truncated."""
    return scored(table(spark, d, "documents")).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def shares(spark: SparkSession, d: str) -> DataFrame:
    """(source, records, truncated, truncated_share) of every source."""
    docs = table(spark, d, "documents")
    cut_ = scored(docs).where(F.col("score") >= THRESHOLD).select("doc_id", F.lit(1).alias("cut")).distinct()
    all_ = docs.select("doc_id", "source").join(cut_, "doc_id", "left")
    return all_.groupBy("source").agg(F.count("*").alias("records"), F.count("cut").alias("truncated")).withColumn("truncated_share", F.round(F.col("truncated") / F.col("records"), 6))
