"""The pipeline, stage by stage, against brute-force versions on its own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from larderlake.llm import common, quality

from .test_decontaminate import greedy, words
from .test_ngram_join import brute as near
from .test_mixing import promises
from .test_pii import brute as personal


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, small):
    docs = spark.read.parquet(small + "/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(small + "/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources to target weights"]

    kept = common.keep(P.STAGES[0][1](spark, docs, small))
    verdict = {r.doc_id: r.accepted for r in quality.classify(docs, labels).collect()}
    assert rows(kept) == [r for r in rows(docs) if verdict[r[0]]] and kept.columns == columns
    assert kept.count() < docs.count()

    one = common.keep(P.STAGES[1][1](spark, kept, small))
    first = {d for d, _, c in near([(r.doc_id, r.text) for r in kept.collect()], 5, 80, 100) if c == d}
    assert rows(one) == [r for r in rows(kept) if r[0] in first] and one.columns == columns

    clean = common.keep(P.STAGES[2][1](spark, one, small))
    bench = [words(r.text) for r in spark.read.parquet(small + "/benchmark.parquet").collect()]
    leaks = set()
    for d, t in one.select("doc_id", "text").collect():
        w = words(t)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for b in bench:
            if any(tuple(b[i : i + 5]) in grams for i in range(len(b) - 4)) and sum(x[2] for x in greedy(w, b, 5)) >= 0.6 * len(b):
                leaks.add(d)
    assert rows(clean) == [r for r in rows(one) if r[0] not in leaks] and clean.columns == columns

    safe = common.keep(P.STAGES[3][1](spark, clean, small))
    own = [(r.doc_id, r.text) for r in clean.collect()]
    want = personal(own)
    by = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == columns and len(by) == len(own)
    for i, (d, t) in enumerate(own):
        assert (by[d].text == t) == (not want[i][0] and not want[i][1]) and by[d].n_chars == len(by[d].text)
        assert not any(v in by[d].text for _, _, _, v in want[i][0])

    mixed = P.STAGES[4][1](spark, safe, small).collect()
    assert len(mixed) == len(own)
    for taken, target in promises(mixed):
        assert abs(taken - target) <= 2
    assert rows(P.run(spark, small)) == sorted(map(tuple, mixed), key=repr)


def test_edges(spark, small, tmp_path):
    """Nulls, repeated rows, an extra column, an empty table."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, component string"
    some = [(1, "some words that stand here once more", "en", "a", 3, "x"), (1, "some words that stand here once more", "en", "a", 3, "x"), (2, None, None, None, None, None), (None, "mail a@b.cc now and then", "de", None, 5, "y"), (3, "", "fr", "b", 0, None)]
    for data in (some, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES[:-1]:
            docs = common.keep(stage(spark, docs, str(tmp_path)))
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        out = P.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.count() == (4 if data else 0)
        if data:
            assert docs.where(F.col("text").contains("[EMAIL]")).count() == 1
