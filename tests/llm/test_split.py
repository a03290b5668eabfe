import random

import pytest

from colloquy.llm import split


def words(n, seed=0, space=0.2):
    r = random.Random(seed)
    return "".join(r.choice(" \n.,;") if r.random() < space else r.choice("abcdéß字漢") for _ in range(n))


def brute(text, limit, overlap):
    return split.chain(text, 0, len(text), limit, overlap)[0]


@pytest.mark.parametrize("text", [words(5000), "x" * 4000, words(5000, 3, 0.01), "a\r\n" * 1500, "é" * 1200, "\n" * 3200])
def test_pieces_cover_and_overlap(text):
    cuts = brute(text, 1500, 200)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b - a <= 1500 for a, b in cuts)
    assert all(c == b - 200 for (_, b), (c, _) in zip(cuts, cuts[1:]))
    assert text == text[cuts[0][0] : cuts[0][1]] + "".join(text[a + 200 : b] for a, b in cuts[1:])


@pytest.mark.parametrize("seed", range(4))
def test_ranges_give_the_same_pieces(spark, seed):
    text = words(6000 + 37 * seed, seed, [0.2, 0.02, 0.0, 0.1][seed])
    df = spark.createDataFrame([("k", 1, text), ("k", 1, text), ("k", 2, "short"), ("n", 3, None), ("e", 4, "")], "a string, b int, text string")
    for size in (300, 1000, 5000, 100000):
        got = split.pieces(df, "text", ["a", "b"], 120, 20, size).orderBy("piece").collect()
        assert [(r["begin"], r["begin"] + len(r["text"])) for r in got] == brute(text, 120, 20)
        assert all(r["text"] == text[r["begin"] : r["begin"] + len(r["text"])] for r in got)


def test_files_by_byte_ranges(spark, tmp_path):
    text = words(9000, 9)
    p = tmp_path / "a.txt"
    p.write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    for size in (1000, 4096, 1 << 20):
        got = split.split_files(spark, [str(p), str(tmp_path / "empty.txt")], 200, 30, size).orderBy("piece").collect()
        assert [(r["begin"], r["text"]) for r in got] == [(a, text[a:b]) for a, b in brute(text, 200, 30)]


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        split.pieces(spark.createDataFrame([("a", "b")], "k string, text string"), "text", ["k"], 100, 60)
