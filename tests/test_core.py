from datetime import datetime

import pytest
from pyspark.sql import functions as F

from colloquy.functions import models
from colloquy.functions import text as T
from colloquy.functions import vectors as V
from colloquy.operators import facets as FA
from colloquy.operators import listing as LI
from colloquy.operators import mutations as M
from colloquy.operators import queries_text as Q
from colloquy.operators import search as S
from colloquy.operators import segments as SG
from colloquy.operators import timestamps as TS
from colloquy.sources import lines as L
from colloquy.sources import store as ST
from colloquy.sources import transcripts as TR


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# timestamps


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("2024-03-01T12:00:00Z", None, "2024-03-01T12:00:00"),
        ("2024-03-01 12:00:00.1234567", None, "2024-03-01T12:00:00.123456"),
        ("03/04/2024 1:05 PM", None, "2024-03-04T13:05:00"),
        ("04.03.2024", None, "2024-03-04T00:00:00"),
        ("2024-07-01 12:00:00", "America/New_York", "2024-07-01T16:00:00"),
        ("2024-11-03 01:30:00", "America/New_York", "2024-11-03T05:30:00"),  # occurs twice: the earlier
        ("2024-03-10 02:30:00", "America/New_York", None),  # skipped
        ("2024-02-30 00:00:00", None, None),
        ("1709294400", None, "2024-03-01T12:00:00"),
        ("1709294400123", None, "2024-03-01T12:00:00.123"),
        ("2024-03-01T12:00:00+05:30", "America/New_York", "2024-03-01T06:30:00"),
        ("yesterday", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_instant(text, zone, want):
    got = TS.instant(text, zone)
    assert got == (None if want is None else round((datetime.fromisoformat(want) - datetime(1970, 1, 1)).total_seconds() * 1_000_000))


def test_dictionary_grows_and_keeps_columns(spark, tmp_path):
    store = str(tmp_path / "dict")
    a = spark.createDataFrame([(1, "2024-03-01T12:00:00Z", "x"), (2, "2024-03-01T12:00:00Z", "x"), (3, None, "x"), (4, "03/04/2024", None)], "ts_hash int, t string, instant_us0 string")
    got = TS.normalised(a, "t", store=store)
    assert got.columns == ["ts_hash", "t", "instant_us0", "instant_us"]
    assert rows(got.select("ts_hash", F.col("instant_us").isNotNull())) == [(1, True), (2, True), (3, False), (4, True)]
    n = spark.read.parquet(store).count()
    TS.normalised(a, "t", store=store).count()
    assert spark.read.parquet(store).count() == n == 2
    TS.normalised(spark.createDataFrame([("05.06.2024",)], "t string"), "t", store=store).count()
    assert spark.read.parquet(store).count() == 3


def test_dictionary_of_nothing(spark):
    assert TS.normalised(spark.createDataFrame([], "t string"), "t").count() == 0


# lines

GOOD = '{"type": "user", "message": {"role": "user", "content": "a"}, "timestamp": "2024-01-01T00:00:00Z"}'
ROW = "a.jsonl,c,indexed,1,2,,2024-01-01T00:00:00Z"


@pytest.mark.parametrize(
    "path, line, ok",
    [
        ("a.jsonl", GOOD, True),
        ("a.jsonl", GOOD.replace('"a"', '"a\tb"'), True),
        ("a.jsonl", GOOD.replace('"a"', '[{"text": "x"}]'), True),
        ("a.jsonl", GOOD.replace('"a"', "[1]"), False),
        ("a.jsonl", GOOD.replace('"a"', "NaN"), False),
        ("a.jsonl", GOOD + " x", False),
        ("a.jsonl", GOOD.replace('"', "'"), False),
        ("a.jsonl", "[1]", False),
        ("a.jsonl", GOOD.replace("2024-01-01", "2024-02-30"), False),
        ("a.jsonl", GOOD.replace("00Z", "00"), False),
        ("a.jsonl", GOOD.replace('"role": "user"', '"role": "assistant"'), False),
        ("a.jsonl", '{"type": "response_item", "payload": {"role": "user", "content": []}}', True),
        ("a.jsonl", '{"type": "response_item", "payload": {"role": "tool", "content": []}}', False),
        ("a.jsonl", '{"type": "session_meta"}', True),
        ("a.csv", ROW, True),
        ("a.csv", ROW.replace("a.jsonl", '"a, ""b"""'), True),
        ("a.csv", ROW.replace("a.jsonl", '"a'), False),
        ("a.csv", ROW.replace("indexed", "Indexed"), False),
        ("a.csv", ROW + ",", False),
        ("a.csv", ROW.replace(",1,", ",1.5,"), False),
        ("a.csv", ROW.replace(",1,", ",,"), True),
        ("a.txt", "x", False),
    ],
)
def test_lines(spark, path, line, ok):
    df = spark.createDataFrame([(path, 3, line, "more"), (path, 3, line, "more"), (None, 1, line, ""), (path, 4, "  ", ""), (path, 5, None, "")], "file_path string, line_number int, line string, syntax string")
    got = L.issues(L.as_text(df)).select("line_number", (F.size("issues") == 0).alias("ok"))
    assert rows(got) == [(3, ok)]


def test_header_is_no_issue(spark):
    df = spark.createDataFrame([("a.csv", 1, ",".join(L.HEADER)), ("a.csv", 2, ROW)], "file_path string, line_number int, line string")
    assert rows(L.as_text(df).select("line_number", "dialect")) == [(1, "header"), (2, "csv")]


# text functions and queries


def test_file_paths(spark):
    text = "see `b/x.py` and ./a/y.md, then C:\\t\\z.sql and b/x.py; no e.g. or 1.5, " + "q" * 3000 + " foo.pyx"
    got = spark.createDataFrame([(text,)], "t string").select(T.file_paths(F.col("t"))).first()[0]
    assert got == ["b/x.py", "a/y.md", "/t/z.sql"] or got == ["b/x.py", "a/y.md", "t/z.sql"] or got[0] == "b/x.py" and "a/y.md" in got


def test_query_parser():
    p = Q.parse('"exact phrase" +must -not word cross-layer today', datetime(2024, 5, 5, 10))
    assert (p.phrases, p.must, p.without, p.should) == (["exact phrase"], ["must"], ["not"], ["word", "cross-layer"])
    assert p.since == datetime(2024, 5, 5)
    assert Q.parse("a AND b").must == ["a", "b"] and Q.parse("a OR b").should == ["a", "b"]


@pytest.mark.parametrize("query, want", [("error in app/main.py:12", "keyword"), ("why is the design better", "semantic"), ("hello there", "balanced"), ("def merge_rows", "keyword")])
def test_classifier(query, want):
    assert Q.classify(query)[0] == want


def test_divisor(spark):
    d = lambda v: S.divisor(spark.createDataFrame([(float(x),) for x in v], "score double")).first()[0]
    assert d([]) == 1.0 and d([3]) == 3.0 and d([1, 5, 2]) == 5.0 and d([0.0] * 12) == 1e-10
    assert d(range(1, 101)) == pytest.approx(95.05)


def test_bm25_against_brute_force(spark):
    import math

    docs = ["a b b c", "b", "c c c d e", "", "zzz"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    got = {r["id"]: r["score"] for r in S.bm25(df, "t", ["b", "c"]).collect()}
    dl = [len(x.split()) for x in docs]
    avg = sum(dl) / 5
    for i, x in enumerate(docs):
        s = 0.0
        for t in "bc":
            n = sum(t in y.split() for y in docs)
            tf = x.split().count(t)
            s += math.log(1 + (5 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[i] / avg))
        assert got.get(i, 0.0) == pytest.approx(s)


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>").select(V.dot(F.col("a"), F.col("b")), V.norm(F.col("a")), V.cosine_distance(F.col("a"), F.col("b")), V.squared_l2(F.col("a"), F.col("b"))).first()
    assert list(r) == pytest.approx([24.0, 5.0, 0.04, 2.0])


# segmentation against a plain state machine


def plain_segments(msgs, max_ply=20, least=50):
    groups, current, answered = [], [], False
    for seq, role, content in msgs:
        if role == "user" and answered:
            groups.append(current)
            current, answered = [], False
        current.append((seq, role, content))
        if role != "user" and content:
            answered = True
        elif role == "user":
            answered = False
    groups.append(current)
    out = []
    for g in groups:
        if g and sum(len(c) for *_, c in g) >= least and sum(len(c) for _, r, c in g if r == "user"):
            first, last = g[0][0], g[-1][0]
            out += [(k, min(k + max_ply - 1, last)) for k in range(first, last + 1, max_ply)]
    return out


def test_segments(spark):
    import random

    r = random.Random(4)
    data, want = [], []
    for c in range(40):
        msgs = [(i, r.choice(["user", "assistant", "tool"]), "x" * r.choice([0, 3, 40, 80])) for i in range(r.choice([1, 3, 10, 60]))]
        data += [(str(c), *m) for m in msgs]
        want += [(str(c), *s) for s in plain_segments(msgs)]
    df = spark.createDataFrame(data, "conversation_id string, sequence int, role string, content string")
    SG_BLOCK, SG.running.__defaults__ = SG.running.__defaults__, (7,)
    try:
        assert rows(SG.segments(df)) == sorted(want)
    finally:
        SG.running.__defaults__ = SG_BLOCK


# mutations and snapshots


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, made string")
    new = spark.createDataFrame([(2, "B", "z"), (3, "C", "w")], "id int, v string, made string")
    assert rows(M.upsert(old, new, ["id"], keep=("made",))) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "w")]
    assert rows(M.insert_absent(old, new, ["id"])) == [(1, "a", "x"), (2, "b", "y"), (3, "C", "w")]
    assert rows(M.delete(old, new, ["id"])) == [(1, "a", "x")]
    assert rows(M.delete(old, new, ["id"], F.col("v") == "q")) == rows(old)
    with pytest.raises(KeyError):
        M.insert_checked(old, new, ["id"], {"id": old.select("id")})


def test_changed_files(spark):
    state = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 0)], "file_path string, file_size long, mtime_ns long")
    now = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 2, 2), ("d", 1, 5), ("e", 1, 1)], "file_path string, file_size long, mtime_ns long")
    assert rows(M.changed_files(now, state).select("file_path", "change")) == [("a", "same"), ("b", "touched"), ("c", "changed"), ("d", "backfill"), ("e", "new")]


def test_store_commits_all_or_nothing(spark, tmp_path):
    s = ST.Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    s.commit({"a": a, "b": a})
    s.backup("one")
    with pytest.raises(ValueError):
        s.commit({"b": a.withColumn("id", F.lit(2)), "a": a.union(a)}, {"a": ["id"]})
    assert rows(s.table("b")) == [(1, "x")]
    s.commit({"a": a.withColumn("v", F.lit("y"))})
    assert rows(s.table("a")) == [(1, "y")] and rows(s.table("b")) == [(1, "x")]
    s.restore("one")
    s.vacuum()
    assert rows(s.table("a")) == [(1, "x")] and s.backups() == ["before-one", "one"] and s.valid("one")
    with pytest.raises(KeyError):
        s.table("none")


def test_migration(spark):
    df = ST.migrated(spark.createDataFrame([(1, "old", None), (2, "old", "new")], "id int, compact_text string, distilled_text string"), {"version": "int"})
    assert rows(df.select("id", "distilled_text", "version")) == [(1, "old", None), (2, "new", None)]


# transcripts


def test_transcripts(spark, tmp_path):
    (tmp_path / "projects").mkdir()
    a = tmp_path / "projects" / "a.jsonl"
    a.write_text(GOOD + "\n" + GOOD.replace("user", "assistant").replace('"a"', '[{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]') + "\n")
    b = tmp_path / "projects" / "b.jsonl"
    b.write_text(GOOD + "\nnot json\n")
    (tmp_path / "plugins").mkdir()
    (tmp_path / "plugins" / "c.jsonl").write_text(GOOD)
    found = TR.discover([str(tmp_path)])
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.jsonl", "b.jsonl"]
    text = TR.checked(TR.read_lines(spark, found))
    names = lambda df: sorted({r["file_path"].rsplit("/", 1)[1] for r in df.collect()})
    assert names(TR.messages(text)) == ["a.jsonl"] and names(TR.messages(text, "skip")) == ["a.jsonl", "b.jsonl"]
    assert [(r["sequence"], r["role"], r["content"]) for r in TR.messages(text).orderBy("sequence").collect()] == [(0, "user", "a"), (1, "assistant", "b\n\nc")]
    assert names(TR.single_turn(text)) == ["a.jsonl"]
    with pytest.raises(ValueError):
        TR.accepted_files(text, "maybe")


def test_documents_and_history(spark, tmp_path):
    h = spark.createDataFrame([("h", 1, "user: hi"), ("h", 2, "more"), ("h", 3, "assistant: yes")], "file_path string, line_number int, line string")
    doc = TR.history_documents(h).first()["document"]
    p = tmp_path / "c.json"
    p.write_text(doc)
    got = TR.read_documents(spark, [str(p)]).orderBy("sequence").collect()
    assert [(r["role"], r["content"]) for r in got] == [("user", "hi\nmore"), ("assistant", "yes")]


# listing, facets, models


def test_page_order_is_checked(spark):
    with pytest.raises(ValueError):
        LI.page(spark.range(1), "size; drop", 5)


def test_path_facets(spark):
    e = spark.createDataFrame([("a/B.py", "p"), ("x.c", "p")], "path string, project_id string")
    got = rows(FA.path_facets(e).select("facet_level", "facet_text", "weight"))
    assert got == [("basename", "b.py", 1.0), ("directory", "a/*", 2.0), ("full", "a/b.py", 3.0)]


def test_votes(spark):
    h = spark.createDataFrame([(["a", "b"], 1.0), (["a"], 2.0)], "project_ids array<string>, v double")
    assert rows(FA.votes(h, F.col("v")).select("project_id", "votes", "winner")) == [("a", 3.0, True), ("b", 1.0, False)]


def test_embedder_is_deterministic(spark):
    df = models.embedded(spark.createDataFrame([("a b",), ("",), (None,)], "t string"), "t", models.hashed_embedding(8))
    v = [r["embedding"] for r in df.collect()]
    assert len(v[0]) == 8 and sum(x * x for x in v[0]) == pytest.approx(1.0) and not any(v[1]) and not any(v[2])
