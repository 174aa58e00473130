"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from larderlake.llm import common, ngram_join


def brute(rows, n, num, den):
    """{doc_id: (sizes, component)} by comparing every pair of rows."""
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets))


def compare(spark, rows, n, num, den):
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()
    assert sorted(map(tuple, got)) == brute(rows, n, num, den)


def near_group(rng, base, count, most, first=0):
    rows = []
    for i in range(count):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            k = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[k : k + 1] = [w[k], f"q{rng.randrange(50)}"] if kind == 0 else [] if kind == 1 else [f"q{rng.randrange(50)}"]
        rows.append((first + i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 1, 2), (2, 100, 100)])
def test_near_groups(spark, n, num, den):
    rng = random.Random(n)
    rows = near_group(rng, [f"w{i}" for i in range(60)], 60, 4) + near_group(rng, [f"w{rng.randrange(30)}" for i in range(150)], 60, 9, 100) + near_group(rng, ["a", "b", "c"], 20, 2, 200)
    rows += [(300 + i, " ".join(f"z{rng.randrange(200)}" for _ in range(rng.randrange(40)))) for i in range(60)]
    compare(spark, rows, n, num, den)


def changed(rng, base, share, own):
    """base with each word replaced, by one of its own, with a probability."""
    return " ".join(f"{own}x{i}" if rng.random() < share else w for i, w in enumerate(base))


def test_far_members_of_a_group_make_no_rows(spark, monkeypatch):
    """Long texts that share a list but are too far from each other: 512 cells can't tell, more cells can before a pair is a row."""
    made, partners = {}, ngram_join.partners

    def counted(rows, num, den, step):
        out = common.keep(partners(rows, num, den, step))
        made[step] = made.get(step, 0) + out.where("kind = 0").count()
        return out

    monkeypatch.setattr(ngram_join, "partners", counted)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(1500)]
    rows = [(i, changed(rng, base, 0.15, i)) for i in range(60)]
    compare(spark, rows, 1, 80, 100)
    assert "all" in made and made["near"] + made["all"] < len(rows), made


@pytest.mark.parametrize("most", [64, 512, 4096])
def test_links_among_far_members(spark, monkeypatch, most):
    """Chains of links within a group whose other members are far, sizes on both sides of a power of two of cells, and more than CELLS."""
    monkeypatch.setattr(ngram_join, "CELLS", most)
    rng = random.Random(most)
    rows = []
    for i in range(24):
        w = changed(rng, [f"w{i}" for i in range(rng.randrange(480, 560))], 0.16, i)
        rows.append((10 * i, w))
        for j in range(1, rng.randrange(5)):
            w = changed(rng, w.split(), rng.choice([0.02, 0.09, 0.12]), f"{i}y{j}")
            rows.append((10 * i + j, w))
    compare(spark, rows, 1, 80, 100)


def test_apart_by():
    """Differences of folded cells are those of cells counted at the smaller width, and never more than the sets'."""
    rng = np.random.default_rng(4)
    width = np.array([8, 16, 64, 64, 32, 8])
    cells = np.zeros((6, 64), np.uint8)
    for i, w in enumerate(width):
        cells[i, :w] = rng.integers(0, 256, w)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    for i, j, d in zip(a, b, ngram_join.apart_by(a, b, cells, width)):
        w = min(width[i], width[j])
        x, y = (np.bitwise_xor.reduce(cells[k, : width[k]].reshape(-1, w)) for k in (i, j))
        assert d == np.bitwise_count(x ^ y).sum(dtype=np.int64)


def test_blocks_and_groups(spark, monkeypatch):
    """Lists longer than a block are compared block against block."""
    monkeypatch.setattr(ngram_join, "LIST", 8)
    monkeypatch.setattr(ngram_join, "GROUP", 20)
    monkeypatch.setattr(common, "ROWS", 7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(7)
    rows = near_group(rng, [f"w{i}" for i in range(80)], 90, 8) + near_group(rng, [f"v{i}" for i in range(70)], 40, 3, 500)
    try:
        compare(spark, rows, 3, 85, 100)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "one"), (8, "ONE"), (7, "one two"), (6, "One\x0btwo"), (2, "é à ü x"), (1, "É à ü x"), (11, "é à ü x"), (12, "x " * 3000), (13, "x " * 2000), (10, "one two")]
    compare(spark, rows, 3, 90, 100)


def test_repeated_ids_and_nulls(spark):
    a, b = "a b c d e f g", "t u v w x y z"
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (None, a)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]


def test_empty(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {x: find(x) for x in parent if x in got} and set(parent) - set(got) <= loops


def test_prefix_is_enough():
    """Sets that link share a token of their prefixes, whatever the order."""
    rng = random.Random(1)
    for _ in range(300):
        num, den = rng.choice([(90, 100), (80, 100), (1, 2)])
        u = rng.sample(range(60), 40)
        a, b = {x for x in u if rng.random() < 0.9}, {x for x in u if rng.random() < 0.9}
        if a and b and den * len(a & b) >= num * len(a | b):
            k = [int(ngram_join.prefix_size(np.array([len(x)]), num, den)[0]) for x in (a, b)]
            assert set(sorted(a)[: k[0]]) & set(sorted(b)[: k[1]])
