"""Repeated passages against every window of every text."""

from collections import defaultdict

from larderlake.llm import repeats


def brute(rows, least):
    words = {}
    for d, t in rows:
        words[d] = (t or "").encode().lower().split()
    at = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            at[tuple(w[i : i + least])].add((d, i))
    out = {d: (len(w), set(), set()) for d, w in words.items()}
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                out[d][1].update(range(i, i + least))
            for d, i in sorted(places)[1:]:
                out[d][2].update(range(i, i + least))
    return out


def compare(spark, rows, least):
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string"), least, 5 if least < 20 else 8).collect()
    want = brute(rows, least)
    assert len(got) == len(want)
    for r in got:
        n, a, b = want[r.doc_id]
        assert r.n_words == n
        for spans, w in ((r.repeated, a), (r.removable, b)):
            assert {i for x in spans for i in range(x.start, x.end)} == w, r.doc_id
            assert all(x.end < y.start for x, y in zip(spans, spans[1:]))


def test_whole_documents(spark, sf):
    compare(spark, [(r.doc_id, r.text) for r in spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text").collect()], 50)


def test_edges(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, a), (2, a.upper()), (3, b + " " + a[:40]), (4, None), (5, ""), (6, "x " * 500), (7, "é\x0bü ö " * 40), (8, "y " + b), (9, a + " q " + a)]
    compare(spark, rows, 10)


def test_left_extension_is_complete(spark):
    """Neighbours by the right context alone would miss what only some share on the left."""
    u, v = [f"u{i}" for i in range(12)], [f"v{i}" for i in range(14)]
    rows = [(i, " ".join((u if i % 2 else [f"r{i}_{j}" for j in range(12)]) + v + [f"s{i * 7 % 10}_{j}" for j in range(5)])) for i in range(10)]
    compare(spark, rows, 20)


def test_hot_passage_and_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 100)
    p = " ".join(f"p{i}" for i in range(60))
    compare(spark, [(i, f"{i} {p} z{i}") for i in range(300)] + [(1000 + i, " ".join(f"k{i}_{j}" for j in range(80))) for i in range(50)], 50)


def test_null_ids(spark):
    p = " ".join(f"p{i}" for i in range(60))
    got = {r.doc_id: r for r in repeats.repeats(spark.createDataFrame([(None, p), (-1, "a " + p), (3, None)], "doc_id long, text string")).collect()}
    assert got[None].removable == [] and [tuple(x) for x in got[-1].removable] == [(1, 61)] and got[3].n_words == 0


def test_empty(spark):
    assert repeats.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_tables_give_the_same(spark, monkeypatch):
    """Slots that are taken again and again, a bit map that lets all seeds through, groups of a few suffixes, slices of a few texts."""
    import random

    from larderlake.llm import common

    monkeypatch.setattr(repeats, "SLOTS", 3)
    monkeypatch.setattr(repeats, "BITS", 3)
    monkeypatch.setattr(repeats, "GROUP", 7)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        a = rng.randrange(150)
        rows.append((rng.randrange(10_000) * 200 + i, " ".join([f"r{rng.randrange(9)}" for _ in range(rng.randrange(6))] + base[a : a + rng.randrange(5, 60)] + [f"t{rng.randrange(9)}" for _ in range(rng.randrange(6))] + base[:30])))
    for size, hot in ((common.SLICE, 50_000), (300, 50_000), (common.SLICE, 1), (300, 4)):
        monkeypatch.setattr(common.slices, "__defaults__", (common.LOWER, size))
        monkeypatch.setattr(repeats, "HOT", hot)
        compare(spark, rows, 12)
        compare(spark, rows, 20)


def test_one_passage_in_every_document(spark, monkeypatch):
    """A passage in all documents costs a few rows a task, not one a document."""
    p = " ".join(f"p{i}" for i in range(150))
    rows = [(i, f"a{i} b{i} {p} c{i} d{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    ones = repeats.np.full(1 << repeats.BITS >> 3, 255, repeats.np.uint8)
    kinds = {r.kind: r["count"] for r in repeats.suffixes(df, 50, 8, (ones, ones)).where("kind <> 4 or n = 1").groupBy("kind").count().collect()}
    assert kinds[1] == 2000 and kinds[2] > 2000 and kinds[4] < 400  # windows with copies that go on
    compare(spark, rows, 50)
    monkeypatch.setattr(repeats, "HOT", 100)
    compare(spark, rows, 50)
