import json
import os

import pytest

from colloquy.engine import MODES, Engine


def write(folder, name, turns):
    os.makedirs(folder, exist_ok=True)
    p = os.path.join(folder, name)
    with open(p, "w") as f:
        for i, (role, text) in enumerate(turns):
            f.write(json.dumps({"type": role, "message": {"role": role, "content": text}, "timestamp": f"2025-01-0{1 + i % 9}T00:00:00Z"}) + "\n")
    return p


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    e = Engine(spark, str(root / "store"))
    talk = lambda topic, file: [("user", f"Why does the {topic} fail in {file} every single time we run it?"), ("assistant", f"The {topic} in `{file}` is not stable, so the second pass sees other rows."), ("user", "Please fix it and add a test for that case."), ("assistant", "Done.")]
    paths = [write(str(root / "projects" / "alpha"), "a.jsonl", talk("parser", "core/parse.py")), write(str(root / "projects" / "beta"), "b.jsonl", talk("scheduler", "core/plan.py"))]
    bad = write(str(root / "projects" / "beta"), "bad.jsonl", talk("x", "y.py"))
    with open(bad, "a") as f:
        f.write("{broken\n")
    once = write(str(root / "projects" / "beta"), "once.jsonl", [("user", "one question"), ("assistant", "one answer")])
    stats = e.index([*paths, bad, once])
    assert (stats["new"], stats["invalid"], stats["excluded"]) == (2, 1, 1) and "line 5" in stats["examples"][0]
    assert e.index([*paths, bad, once])["unchanged"] == 4
    assert e.distill() > 0 and e.distill() == 0
    return e, paths


@pytest.mark.parametrize("mode", MODES)
def test_modes_find_the_conversation(engine, mode):
    got = engine[0].search("parser core/parse.py", mode, 5).collect()
    assert got and got[0]["conversation_id"] == "a"


def test_filters_cache_and_bad_modes(engine):
    e, _ = engine
    assert e.search("scheduler -stable", "keyword").count() == 0
    assert [r["conversation_id"] for r in e.search("scheduler", "keyword", projects=["beta"]).collect()] == ["b"]
    assert e.search("scheduler", "keyword") is e.search("scheduler", "keyword")
    assert e.search("!!", "keyword").count() == 0
    with pytest.raises(ValueError):
        e.search("x", "psychic")


def test_fallback_merge_rooms_listing(engine):
    e, _ = engine
    rows, tier = e.search_with_fallback("parser", ["alpha"])
    assert tier == "unscoped" and rows.count() == 2
    assert [r["project_id"] for r in e.related(["alpha"]).collect()] == ["beta"]
    assert {r["conversation_id"] for r in e.merged("parser").collect()} == {"a", "b"}
    room = e.find_rooms("CORE").first()
    assert e.walk_room(room["room_id"]).count() == room["object_count"]
    page, total = e.list("title", 1)
    assert total == 2 and page.count() == 1
    assert [r["role"] for r in e.view("a").collect()] == ["user", "assistant", "user", "assistant"]
    with pytest.raises(KeyError):
        e.view("none")


def test_growth_and_deletion(engine):
    e, paths = engine
    with open(paths[0], "a") as f:
        f.write(json.dumps({"type": "user", "message": {"role": "user", "content": "And now the lexer, which is even slower than all of that before."}}) + "\n")
    assert e.index(paths)["updated"] == 1
    assert e.view("a").count() == 5 and e.search("lexer", "keyword").first()["conversation_id"] == "a"
    gone = e.delete(["a"])
    assert gone["conversations"] == 1 and gone["messages"] == 5
    assert e.search("parser", "keyword").where("conversation_id = 'a'").count() == 0 and e.statistics().first()["conversations"] == 1
