"""Kneser-Ney against a version with dicts; scores against sums over characters; held-out documents."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from larderlake.llm import common, quality


def brute(counts, a, order):
    """p(symbol | context) by recursion over dicts of n-gram tuples."""
    levels = {order: Counter({g: c for g, c in counts.items() if c})}
    for n in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in levels[n + 1]:
            before[g[1:]].add(g[0])
        levels[n] = Counter({g: len(s) for g, s in before.items()})
    disc = {}
    for n, c in levels.items():
        k = Counter(c.values())
        n1, n2, n3, n4 = (k[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [0, 1 - 2 * y * n2 / n1 if n1 else 0, 2 - 3 * y * n3 / n2 if n2 else 0, 3 - 4 * y * n4 / n3 if n3 else 0]
        disc[n] = [min(max(x, 0), i) for i, x in enumerate(d)]

    def p(g, size=a):
        if not g:
            return 1 / size
        n, lower = len(g), p(g[1:], size)
        own = [levels[n].get(g[:-1] + (w,), 0) for w in range(a)]
        total = sum(own)
        if not total:
            return lower
        cut = [disc[n][min(c, 3)] for c in own]
        return (max(own[g[-1]] - cut[g[-1]], 0) + sum(cut) * lower) / total

    return p


def padded(text):
    return [quality.PAD] * (quality.ORDER - 1) + [ord(c) for c in text]


def model_of(texts):
    """log p of each character of a text, from n-grams of code points counted in dicts."""
    n = quality.ORDER
    letters = {c: i for i, c in enumerate(sorted({c for t in texts for c in padded(t)}))}
    seen = {ord(c) for t in texts for c in t}
    counts = Counter(tuple(letters[c] for c in padded(t)[i : i + n]) for t in texts for i in range(len(t)))
    # the uniform distribution is over the characters seen as last ones, and one for all others
    p = brute(counts, len(letters) + 1, n)
    size = len(seen) + 1

    def value(g):
        return p(g, size)

    def log_p(text):
        x = [letters.get(c, len(letters)) for c in padded(text)]
        return [max(math.log(value(tuple(x[i : i + n])) or 1e-99), -20) for i in range(len(text))]

    return log_p


def texts_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_model(spark):
    rng = random.Random(3)
    for alphabet in ("ab", "abc é", "the 𝒳漢\n"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(12)] + ["", None]
        model, never = quality.kneser_ney(quality.counts_of(texts_of(spark, texts)))
        rows = model.collect()
        known = quality.Known([np.array([quality.keyed(r.order, np.array([r.context], np.int64).view(np.uint64), np.array([r["last"]], np.uint64))[0] for r in rows], np.uint64).tobytes()],
            *[[np.array([np.nan if r[c] is None else max(math.log(r[c]) if r[c] else -99, -99) for r in rows], np.float32).tobytes()] for c in ("p", "left")], never)
        want = model_of([t for t in texts if t])
        for t in [*texts[:4], "zz" + alphabet, "ab ab" * 4, "漢a" * 3]:
            if not t:
                continue
            (s,) = common.slices(pa.array([t]), None)
            context, last, _ = quality.grams(s)
            assert np.allclose(known.log_p(context, last), want(t), atol=1e-4), (alphabet, t)


def test_probabilities_sum_to_one(spark):
    """What a context gives to all characters and to one never seen is 1."""
    texts = ["abracadabra", "bar cab", "abba abba c"]
    want = model_of(texts)
    for context in ("", "a", "ab", "abr", "zzz", "cab"):
        total = sum(math.exp(want(context + c)[-1]) for c in [*sorted({c for t in texts for c in t}), "~"])
        assert abs(total - 1) < 1e-9


def test_grams():
    texts = ["ab", None, "", "é😀Z\n 7!", "a" * 5]
    for s in common.slices(pa.array(texts), None):
        context, last, begin = quality.grams(s)
        for i, t in enumerate(texts):
            c = padded(t or "")
            want = [((c[k] << 42) + (c[k + 1] << 21) + c[k + 2], c[k + 3]) for k in range(len(t or ""))]
            assert list(zip(context[begin[i] : begin[i + 1]].tolist(), last[begin[i] : begin[i + 1]].tolist())) == want


def test_scores(spark, monkeypatch):
    """Against the version with dicts; small slices, shards and slots give the same."""
    rows = [(1, "the cat sat on the mat", "en"), (2, "the dog sat on the log", "en"), (3, "$$$ ### QQQ", "en"), (4, None, "en"), (5, "", None), (6, "the cat", None), (7, "la la la", "fr"), (3, "$$$ ### QQQ", "en"), (None, "the mat", "xx"), (8, "the cat sat 漢 " * 500, "en")]
    labels = [(1, 1, 0), (2, 1, None), (3, 0, 0), (7, 1, 1), (1, 1, 0), (99, 1, 0), (None, 1, 0)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, threshold string")
    log_p = model_of([rows[0][1], rows[1][1]])
    for size, shard, slots in ((32_000_000, 1 << 18, 20), (30, 4, 3)):
        monkeypatch.setattr(quality, "SLICE_BYTES", size)
        monkeypatch.setattr(quality, "SHARD", shard)
        monkeypatch.setattr(quality, "SLOTS", slots)
        got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), short=0.2, held=0).collect()
        assert len(got) == len(rows)
        by = {(r.doc_id, r.lang): r for r in got}
        for d, t, lang in rows:
            r = by[d, lang]
            if not t:
                assert r.log_perplexity is None and r.accepted and r.n_characters == 0
                continue
            assert r.n_characters == len(t) and abs(r.log_perplexity + sum(log_p(t)) / len(t)) < 1e-4
        assert by[1, "en"].trusted and not by[7, "fr"].trusted and by[1, "en"].accepted and not by[3, "en"].accepted and by[6, None].accepted


def test_large_counts(spark):
    """Counts beyond 32 bits stay what they are."""
    counts = spark.createDataFrame([(0, 97, 2**31 + 5), (0, 98, 2**40)], "context long, last int, n long")
    model, _ = quality.kneser_ney(counts)
    p = {r["last"]: r.p for r in model.where("order = 4").collect()}
    assert abs(p[97] - (2**31 + 5) / (2**31 + 5 + 2**40)) < 1e-6


def test_bands(spark):
    """Where a language and band have trusted texts enough, their quantiles hold without allowance, on both sides."""
    rng = random.Random(4)
    words = "the cat sat on a mat and dogs ran by our old red barn while rain fell over hills".split()
    text = lambda n, junk=0: " ".join("".join(rng.choice("qxzjkw") for _ in range(4)) if rng.random() < junk else rng.choice(words) for _ in range(n))
    rows = [(i, text(40), "en") for i in range(400)] + [(1000 + i, text(40, 0.15), "en") for i in range(50)] + [(2000 + i, (words[i % 10] + " ") * 45, "en") for i in range(20)]
    labels = [(i, 1, 0) for i in range(400)]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sum(not r.accepted for r in got if 1000 <= r.doc_id < 2000) >= 48
    assert sum(r.accepted for r in got if r.doc_id < 1000) >= 0.98 * 400
    low = min(r.log_perplexity for r in got if r.trusted and 128 <= r.n_characters < 256)
    dull = [r.accepted for r in got if r.doc_id >= 2000 and 128 <= r.n_characters < 256 and r.log_perplexity < low]
    assert dull and not any(dull)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    some = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    assert quality.classify(some, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first().accepted


def test_documents(spark, sf):
    labels = {r.doc_id: r for r in spark.read.parquet(sf + "/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    bad = [not got[d].accepted for d, r in labels.items() if r.quality == 0]
    good = [got[d].accepted for d, r in labels.items() if r.quality == 1]
    assert sum(bad) > 0.85 * len(bad) and sum(good) > 0.985 * len(good)
