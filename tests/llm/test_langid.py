"""Language ID: features, Viterbi against all paths, held-out accuracy, mixed texts."""

import itertools
import random

import numpy as np
import pyarrow as pa

from larderlake.llm import common, langid


def test_code_points():
    texts = ["aé€😀z", "", "漢字 abc", None]
    for s in common.slices(pa.array(texts), None):
        cp, begin = langid.code_points(s.buf, s.offs)
        assert ["".join(map(chr, cp[i:j])) for i, j in zip(begin, begin[1:])] == [t or "" for t in texts]


def test_features():
    texts = ["ab, c", "", "1 2", "é x"]
    for s in common.slices(pa.array(texts), None):
        key, script, at, begin = langid.features(s)
        assert np.diff(begin).tolist() == [2, 0, 0, 2] and np.diff(np.append(at, len(key))).tolist() == [3, 2, 2, 2]
        assert key[at[1]] != key[at[3]] and (script[at] == langid.NAMES.index("latin")).all()


def test_viterbi():
    rng = np.random.default_rng(2)
    for k, pen in ((3, 1.0), (2, 0.3), (3, 5.0)):
        sizes = [4, 0, 1, 6, 3]
        scores = rng.normal(size=(sum(sizes), k)).astype(np.float32)
        begin = np.append(0, np.cumsum(sizes))
        path = langid.viterbi(scores, begin, pen)
        for i, j in zip(begin, begin[1:]):
            value = lambda p: sum(scores[i + t, x] for t, x in enumerate(p)) - pen * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            if j > i:
                assert abs(value(path[i:j]) - max(map(value, itertools.product(range(k), repeat=j - i)))) < 1e-4
    assert len(langid.viterbi(np.zeros((0, 2), np.float32), np.array([0, 0]), 1)) == 0


def test_documents(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    got = langid.query(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and 150 < len(held) < 350
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_mixed_texts_and_edges(spark):
    rng = random.Random(1)
    en, de, ru = ([a + b for a in x for b in y] for x, y in ((("the", "ing", "wh", "of"), ("er", "ed", "ly")), (("sch", "ung", "ö"), ("heit", "keit", "ß")), (("при", "ого", "ств"), ("ет", "на"))))
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(w, 30), lang) for i, (w, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 20)]
    model = langid.fit(spark.createDataFrame([*rows, (99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    odd = [(1, text(en, 40) + " " + text(de, 20) + ". " + text(ru, 10), 7), (2, None, 7), (3, "", 7), (4, "123 !!", 7), (5, text(ru, 1).upper(), 7), (6, "漢字", 7), (7, "a", 7), (7, "a", 7), (8, (text(de, 9) + "\n") * 3000, 7)]
    got = langid.label(spark.createDataFrame(odd, "doc_id long, text string, score int"), model).orderBy("doc_id").collect()
    assert [s.lang for s in got[0].spans] == ["en", "de", "ru"] and [s.start for s in got[0].spans] == [0, 40, 60] and got[0].spans[2].end == 70 and got[0].lang_pred == "en" and 0.3 < got[0].score < 0.8
    assert [(r.lang_pred, r.score, r.spans) for r in got[1:4]] == [("und", 0.0, [])] * 3
    assert (got[4].lang_pred, got[4].score) == ("ru", 1.0) and got[5].lang_pred in model.langs and got[8].lang_pred == "de" and len(got) == len(odd)
    none = langid.label(spark.createDataFrame(odd[:1], "doc_id long, text string, score int"), langid.fit(spark.createDataFrame([], "text string, lang string"))).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert langid.label(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
