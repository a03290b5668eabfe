import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import duplicates, mixing, neighbours, packing, threads, tokens, truncated


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# threads


def test_pointer_jumping_finds_roots_orphans_and_cycles(spark):
    edges = [("a0", None)] + [(f"a{i}", f"a{i - 1}") for i in range(1, 70)] + [("b1", "gone"), ("b2", "b1"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "z"), ("s", "s")]
    df = spark.createDataFrame(edges, "id string, parent string").withColumn("tree", F.substring("id", 1, 1))
    got = threads.resolved(df, F.col("id"), F.col("parent"), F.lit(1))
    a, b = threads._hash(F.col("id"))
    j = {r["id"]: (r["state"], r["depth"]) for r in df.withColumn("a", a).withColumn("b", b).join(got, ["a", "b"]).collect()}
    assert all(j[f"a{i}"] == ("whole", i) for i in range(70))
    assert j["b1"] == ("orphan", 0) and j["b2"] == ("orphan", 1)
    assert {j[k][0] for k in "xyzws"} == {"cycle"}


def tables(spark, d, messages, headers):
    spark.createDataFrame(messages, "conversation_id string, sequence int, role string, content string, state string").write.parquet(f"{d}/messages.parquet")
    spark.createDataFrame([(h, 1) for h in headers], "conversation_id string, depth int").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([("user", "user"), ("human", "user"), ("assistant", "assistant"), ("tool", "tool")], "alias string, role string").write.parquet(f"{d}/role_aliases.parquet")


def test_conversations(spark, tmp_path):
    d = str(tmp_path)
    m = []
    good = [(0, "user", "hi"), (1, "assistant", "yes")]
    for c, turns in {
        "good": good, "spelled": [(0, " Human ", "hi"), (1, "assistant", "yes")], "repeat": [*good, (1, "assistant", "yes")], "tail": [*good, (2, "tool", "x"), (3, "assistant", "  ")],
        "gap": [(0, "user", "hi"), (2, "assistant", "yes")], "late": [(1, "user", "hi"), (2, "assistant", "yes")], "two": [*good, (1, "assistant", "no")], "roles": [*good, (1, "tool", "yes")], "unknown": [*good, (2, "wizard", "x")], "norole": [*good, (2, None, "x")],
        "blank": [(0, "user", "​ "), (1, "assistant", "yes")], "unanswered": [*good, (2, "user", "again")], "negative": [(-1, "user", "hi"), (0, "assistant", "yes")], "null": [(0, "user", None), (1, "assistant", "yes")],
    }.items():
        m += [(c, *t, "x") for t in turns]
    tables(spark, d, [*m, (None, 0, "user", "x", ""), ("good", None, "user", "x", "")], ["good", "header only", None])
    dropped = {"gap", "late", "two", "roles", "unknown", "norole", "blank", "unanswered", "negative", "null", "header only"}
    assert {r[0] for r in threads.found(spark, d).collect()} == dropped
    got = {r["conversation_id"]: [tuple(t) for t in r["turns"]] for r in threads.conversations(spark, d).collect()}
    assert set(got) == {"good", "spelled", "repeat", "tail"} and got["spelled"] == [(0, "user", "hi"), (1, "assistant", "yes")] and got["repeat"] == got["good"]


def test_no_messages(spark, tmp_path):
    tables(spark, str(tmp_path), [], ["h"])
    assert rows(threads.found(spark, str(tmp_path))) == [("h",)] and threads.conversations(spark, str(tmp_path)).count() == 0


# neighbours


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(ids[i] if ids else f"v{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")


def test_forest_recall_and_ties(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 16))
    x = np.concatenate([centres[i % 60] + 0.3 * r.normal(size=16) for i in range(1500)]).reshape(1500, 16).astype(np.float32)
    x[7] = x[8] = x[9] = x[10]  # equal vectors
    v = vectors(spark, x)
    got, want = {}, {}
    for into, df in ((got, neighbours.neighbours(v, 5, 16, leaf=64)), (want, neighbours.brute(v, v, 5, 16))):
        for row in df.collect():
            into.setdefault(row["id"], set()).add((row["neighbour"], row["similarity"]))
    least = {k: min(s for _, s in p) for k, p in want.items()}
    assert sum(sum(s >= least[k] for _, s in got[k]) for k in want) / sum(map(len, want.values())) > 0.9
    assert {n for n, s in got["v00007"] if s == 1.0} == {"v00008", "v00009", "v00010"}


def test_a_hot_group_of_equal_vectors(spark):
    x = np.ones((300, 8), np.float32)
    got = neighbours.neighbours(vectors(spark, x), 3, 8).where("id = 'v00001' or id = 'v00200'").collect()
    assert sorted((r["id"], r["rank"], r["neighbour"]) for r in got) == [("v00001", 1, "v00000"), ("v00001", 2, "v00002"), ("v00001", 3, "v00003"), ("v00200", 1, "v00000"), ("v00200", 2, "v00001"), ("v00200", 3, "v00002")]


def test_unusable_vectors_and_empty_tables(spark):
    bad = [("a", None), ("b", [1.0]), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", [1.0, None]), (None, [1.0, 1.0]), ("f", [1.0, 2.0]), ("f", [1.0, 2.0]), ("g", [2.0, 1.0])]
    df = spark.createDataFrame(bad, "id string, embedding array<float>")
    u = neighbours.usable(df, "id", "embedding", 2)
    assert sorted(r["id"] for r in u.collect()) == ["f", "g"]
    assert sorted((r["id"], r["neighbour"]) for r in neighbours.neighbours(u, 5, 2).collect()) == [("f", "g"), ("g", "f")]
    assert neighbours.neighbours(u.where("false"), 5, 2).count() == 0


# duplicates


def test_classes_against_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(60)]
        texts.append(base)
        for _ in range(r.randrange(4)):
            base = list(base)
            base[r.randrange(60)] = "new"
            texts.append(base)
    texts = [" ".join(t) for t in texts] + ["", "  ", "one two", "One, two!", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x["class"] for x in duplicates.classes(df).collect()}
    sets = [duplicates.shingles(t or "") for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if duplicates.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    assert set(got) == set(range(len(texts) - 1))
    for i in got:
        for j in got:
            assert (got[i] == got[j]) == (label[i] == label[j])


# packing


def test_best_fit_takes_the_tightest_compatible_container():
    assert packing.best_fit([6, 5, 4, 3], ["a"] * 4, [None] * 4, 10) == [0, 1, 0, 1]
    assert packing.best_fit([6, 5, 4, 3], ["a"] * 4, [1, None, 1, None], 10) == [0, 1, 1, 0]
    apart = frozenset({frozenset({"a", "b"})})
    assert packing.best_fit([5, 5], ["a", "b"], [None] * 2, 10, apart) == [0, 1] and packing.best_fit([5, 5], ["a", "c"], [None] * 2, 10, apart) == [0, 0]


def test_containers(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(999)) for _ in range(r.choice([3, 20, 60]))) for _ in range(120)]
    texts += ["the same text of some more words than five"] * 60 + ["", " ", None, "long " * 900]
    df = spark.createDataFrame([(i, r.choice(["s", "t", None]), t, "x") for i, t in enumerate(texts)], "doc_id long, source string, text string, sub string")
    for shard in (20_000, 40):
        got = packing.containers(df, 256, shard=shard).collect()
        used = {}
        for x in got:
            used[x["container"]] = used.get(x["container"], 0) + x["tokens"]
        assert max(used.values()) <= 256 and all(x["used"] == used[x["container"]] for x in got)
        count = tokens.counter()
        sizes = {i: count([t])[0] for i, t in enumerate(texts) if t is not None}
        for i, n in sizes.items():
            mine = sorted((x["piece"], x["begin"], x["tokens"]) for x in got if x["doc_id"] == i)
            assert sum(t for *_, t in mine) == n and len(mine) == max(1, -(-n // 256))
        assert len(used) <= 1.2 * -(-sum(sizes.values()) // 256) + 1
    assert packing.containers(df.where("false")).count() == 0


# mixing


def test_rates_invert_the_poisson_distribution():
    u = np.array([0.1, 0.5, 0.9])
    assert mixing.rates(u, 1) == pytest.approx(-np.log(u), rel=1e-6)
    assert (mixing.rates(u, 2) > mixing.rates(u, 1)).all()


def test_mixture_reaches_its_shares(spark, tmp_path):
    r = random.Random(6)
    docs = [(i, s, " ".join(["word"] * r.randrange(5, 40)), s) for i in range(900) for s in [("big" if i % 10 else "small")]] + [(1000, None, "x", ""), (1001, "other", "x", ""), (1002, "big", None, ""), (1003, "big", "", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, copies string")
    goal = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 3), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    got = mixing.drawn(df, goal)
    per = {x["source"]: (x["t"], x["m"]) for x in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m")).collect()}
    assert set(per) == {"big", "small"} and per["small"][1] <= 3 and per["big"][1] <= 2
    assert per["big"][0] / per["small"][0] == pytest.approx(2.0, rel=0.02)
    assert rows(got) == rows(mixing.drawn(df, goal))
    assert mixing.drawn(df.where("false"), goal).count() == 0 == mixing.drawn(df, goal.where("false")).count()


# truncated


def test_structures_that_are_open():
    assert truncated.opened("a\n```py\nx") and not truncated.opened("```py\nx(\n```") and truncated.opened('{"a": [1, 2') and not truncated.opened("f(x) done.")


def test_held_out_truncation(spark):
    r = random.Random(8)
    nouns, verbs = "queue cache parser ledger buffer window cursor header".split(), "drops keeps merges splits counts reads".split()
    whole = lambda: " ".join(f"The {r.choice(nouns)} {r.choice(verbs)} every {r.choice(nouns)} after the {r.choice(nouns)} is full." for _ in range(r.randrange(2, 9)))
    data, cut = [], set()
    for i in range(900):
        t = whole()
        if i % 9 == 0:
            t = t[: r.randrange(20, len(t) - 3)]
            if not t.endswith("."):
                cut.add(i)
        elif i % 9 == 1:
            t = f"Merge the {r.choice(nouns)}"
        data.append((i, "titles" if i % 9 == 1 else "notes", t, 1))
    df = spark.createDataFrame([*data, (901, "notes", None, 1), (902, None, " ", 1)], "doc_id long, source string, text string, size int")
    s = {x["doc_id"]: x["score"] for x in truncated.scored(df).collect()}
    got = {i for i, v in s.items() if v >= truncated.THRESHOLD}
    assert len(got & cut) / len(cut) > 0.85 and len(got & cut) / max(1, len(got)) > 0.85
    assert truncated.scored(df.where("false")).count() == 0
