"""Targets and quotas against plain versions; the mix's promises."""

import heapq
import random

from larderlake.llm import mixing


def highest_quotients(votes, seats):
    out = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def test_sainte_lague():
    rng = random.Random(4)
    for _ in range(300):
        votes = [rng.choice([0, rng.random() * 10 ** rng.randrange(6)]) for _ in range(rng.randrange(1, 12))]
        seats = rng.randrange(0, 400)
        assert mixing.sainte_lague(votes, seats) == highest_quotients(votes, seats)
    assert mixing.sainte_lague([], 5) == [] and mixing.sainte_lague([0, 0], 5) == [0, 0] and mixing.sainte_lague([1, 1, 1], 2) == [1, 1, 0]


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    got = mixing.targets([100, 1, 50], [1, 2, 3])
    assert got == [37.0, 3.0, 111.0] or sum(got) == 151 and got[1] == 3 and all(g <= 3 * s for g, s in zip(got, [100, 1, 50]))
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(0, 50) ** rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))]
        w = [i % 3 + 1 for i in range(len(s))]
        t = mixing.targets(s, w)
        assert abs(sum(t) - sum(s)) < 1e-6 * max(1, sum(s)) and all(x <= 3 * y + 1e-9 for x, y in zip(t, s))
        free = [x / v for x, v, y in zip(t, w, s) if x < 3 * y - 1e-9]
        assert not free or max(free) - min(free) < 1e-6 * max(free)


def promises(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0].source_size
        yield sum(r.taken for r in own), own[0].target


def test_documents(spark, sf):
    rows = mixing.query(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r["size"] == len(docs[r.doc_id].text.encode().split()) for r in rows)
    for taken, target in promises(rows):
        assert abs(taken - target) <= max(16, 0.01 * target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.query(spark, sf).collect()))


def test_edges(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d " * 50, None), (5, "e\x0bf", "é"), (5, "e\x0bf", "é"), (None, "g", "z"), (6, "h " * 5000, "z")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for taken, target in promises(got):
        assert abs(taken - target) <= 1
    assert {r.source: r.target for r in got}["é"] == min(12.0, {r.source: r.target for r in got}["é"])
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert {r.taken for r in mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()} == {0}


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    rows = [(i, "w " * (i % 37), "big" if i % 3 else f"s{i % 5}") for i in range(600)]
    for block in (0, 7, 64):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=block).collect()
        for taken, target in promises(got):
            assert abs(taken - target) <= max(1, block)


def test_small_sources_get_their_words(spark):
    """A source that is a millionth of another still takes what its target says."""
    rows = [(i, "w " * 20000, "big") for i in range(100)] + [(1000, "v " * 100, "small"), (1001, "u u u", "tiny")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.source: [sum(x.taken for x in got if x.source == r.source), r.target] for r in got}
    assert by["small"][1] == 300 and abs(by["small"][0] - 300) <= 3 and by["tiny"] == [9, 9]


def test_drawn_blocks(spark, monkeypatch):
    """taken by marking every word of every drawn block."""
    monkeypatch.setattr(mixing, "DRAWN", 8)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 150)
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 8, 9, 40]), rng.choice("aab")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    order = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(42, doc_id, xxhash64(text)) AS h").collect()}
    size = {d: len(t.split()) for d, t, _ in rows}
    shards = {}
    for i, source in enumerate(sorted({s for _, _, s in rows})):
        own = [d for d, _, s in rows if s == source]
        n = max(1, -(-sum(size[d] for d in own) // 150))
        for d in own:
            shards.setdefault((i, order[d] % n), []).append(d)
    for (i, k), own in shards.items():
        own.sort(key=lambda d: order[d])
        words = [d for d in own for _ in range(size[d])]
        rounds, rest = divmod(sum(got[d].taken for d in own), len(words)) if words else (0, 0)
        blocks, step, first = mixing._draw(i, k, len(words) // 8, 42)
        at = sorted(range(blocks), key=lambda x: (step * x + first) % blocks) + [blocks]
        assert len(set(at)) == blocks + 1
        drawn = [w for x in at for w in words[8 * x : 8 * (x + 1)]][:rest]
        for d in own:
            assert got[d].taken == rounds * size[d] + drawn.count(d), (i, k, d)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5, "q")], "doc_id long, text string, source string, size int, _d string").selectExpr("*", "size AS taken", "_d AS _s", "size AS target")
    assert [tuple(r)[2:] for r in mixing.mix(df).collect()] == [("x", 2, 2, 2.0, 2)]
