"""Decontamination against greedy string tiling step by step."""

import random

import numpy as np
import pytest

from larderlake.llm import common
from larderlake.llm import decontaminate as D


def greedy(doc, item, least):
    """Marks the longest match of free words again and again, by comparing all positions."""
    fa, fb, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and fa[i + n] and fb[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n
        out.append(best)


def test_tiles():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(9) for _ in range(rng.randrange(0, 25))]
        doc = [rng.randrange(9) for _ in range(rng.randrange(0, 15))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(item) + 1)
            doc += item[a : a + rng.randrange(12)] + [rng.randrange(9)] * rng.randrange(2)
        least = rng.choice([1, 2, 3, 5])
        h = lambda x: common.mix(np.array(x, np.uint64))
        assert D.tile(h(doc), h(item), least) == greedy(doc, item, least), (doc, item, least)


def words(t):
    import re

    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (t or "").lower()).split()


def compare(spark, docs, bench, least=5):
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), least, 0.6).collect()
    assert len(got) == len(docs)
    for r in got:
        best = {}
        for d, t in docs:
            if d == r.doc_id:
                for i, x in bench:
                    w = words(x)
                    n = sum(y[2] for y in greedy(words(t), w, least)) if w else 0
                    if n:
                        best[i] = max(best.get(i, 0), n / len(w))
        top = max(best.values(), default=0.0)
        assert abs(r.coverage - top) < 1e-9 and r.item_id == min((i for i, v in best.items() if v == top), default=None)
        assert r.n_items == sum(v >= 0.6 for v in best.values()) and r.contaminated == (r.n_items > 0)
    return got


def test_reordered_passages(spark):
    item = [f"w{i}" for i in range(30)]
    parts = [item[20:30], item[0:9], item[10:19]]
    docs = [(1, "x y " + " z, ".join(" ".join(p) for p in parts) + " end"), (2, " ".join(item[:12])), (3, "nothing here at all of it"), (4, None), (5, ""), (6, "W0, w1; W2.w3-w4 (w5)\n" + " ".join(item[6:]).upper()), (6, "w0 w1 w2 w3 w4 w5"), (7, " ".join(item) * 2)]
    got = {r.doc_id: r for r in compare(spark, docs, [(10, " ".join(item)), (11, "short one"), (12, None), (13, ""), (14, " ".join(item[:6]))])}
    assert got[1].contaminated and got[2].contaminated and got[6].coverage == 1


def test_shared_windows(spark):
    """Items that share windows, and a bloom filter so small that it lets through what isn't there."""
    rng = random.Random(8)
    bench = [(i, " ".join(f"b{rng.randrange(40)}" for _ in range(20))) for i in range(8)]
    docs = [(i, " ".join([f"c{i}"] * 5 + bench[i % 8][1].split()[i % 7 :] + bench[(i + 3) % 8][1].split()[:9])) for i in range(12)]
    compare(spark, docs, bench)
    seeds = D.items_of(spark.createDataFrame(bench, "item_id long, text string")).selectExpr("explode(seeds) AS seed")
    df = spark.createDataFrame([*docs, (99, "nothing of it at all here " * 9)], "doc_id long, text string")
    assert {r.doc_id for r in D.candidates(df, D.bloom(seeds, 3)).collect()} == set(range(12)) | {99} and 99 not in {r.doc_id for r in D.candidates(df, D.bloom(seeds)).collect()}


@pytest.mark.parametrize("seeds", [1, 50, 1 << 20])
def test_ranges_of_diagonals(monkeypatch, seeds):
    monkeypatch.setattr(D, "SEEDS", seeds)
    test_tiles()


def test_many_equal_words():
    """20,000 equal words against an item of 1,000: all seed pairs would be some 20 million."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert D.tile(np.full(20_000, 7, np.uint64), np.full(1000, 7, np.uint64)) == [(0, 0, 1000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_short_and_unspaced_items(spark):
    """An item of few words is found where it is the whole text; scripts without spaces are tiled by letters."""
    bench = [(1, "Yes, sir"), (2, "今日は天気がいいですね"), (3, "« Où est la gare — demanda-t-il »")]
    docs = [(1, "yes sir!"), (2, "yes sir no sir"), (3, "はい。今日は天気がいいですね。本当に"), (4, "où est la gare，demanda t il"), (5, "今日は雨が降る"), (None, "Yes sir"), (6, "word " * 30_000)]
    got = {r.doc_id: r for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert [got[i].contaminated for i in (1, 2, 3, 4, 5, 6)] == [True, False, True, True, False, False] and got[3].item_id == 2 and got[4].coverage == 1


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x")], "doc_id long, text string, row int, words string").selectExpr("*", "row AS item_id", "words AS seeds", "row AS coverage")
    bench = spark.createDataFrame([(3, "a b c d e f", 5)], "item_id long, text string, doc_id int")
    assert [tuple(r) for r in D.decontaminate(docs, bench).collect()] == [(1, 1.0, 3, 1, True)]


@pytest.mark.parametrize("bench", [[], [(1, "a b")]])
def test_without_a_benchmark(spark, bench):
    got = D.decontaminate(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 0.0, None, 0, False)]
    assert D.decontaminate(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_documents(spark, sf):
    bench = [words(r.text) for r in spark.read.parquet(sf + "/benchmark.parquet").collect()]
    docs = spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in D.query(spark, sf).collect()}
    hits = 0
    for d, t in docs:
        w = words(t)
        text = " " + " ".join(w) + " "
        whole = any(f" {' '.join(b)} " in text for b in bench)
        near = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert not whole or got[d].coverage == 1.0
        assert got[d].coverage > 0 or not any(tuple(b[i : i + 5]) in near for b in bench for i in range(len(b) - 4))
        hits += whole
    assert hits and sum(r.contaminated for r in got.values()) >= hits
