"""Token counts against the tokenizer itself, and scans of real flat files."""

import numpy as np
from larderlake.llm import tokens


def test_documents(spark, small):
    docs = spark.read.parquet(small + "/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tokens.query(spark, small).collect()}
    e = tokens.encoder()
    assert got == {r.doc_id: len(e.encode_ordinary(r.text)) for r in docs.select("doc_id", "text").collect()}


def test_small_blocks_and_odd_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 3)
    rows = [(1, None), (2, ""), (3, "<|endoftext|> plain"), (4, "x " * 5000), (None, "a"), (5, "é" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    e = tokens.encoder()
    for name, size in (("one", 1 << 20), ("several", 4)):
        tokens.write_files(df, f"file://{tmp_path}/{name}", size=size)
        blocks = tokens.cut(tokens.written(spark, f"file://{tmp_path}/{name}", "tokens"), block=7)
        got = [(r.n_tokens, r.ended) for r in tokens.scan(blocks).orderBy("file", "document").collect()]
        assert got == [(len(e.encode_ordinary(t or "")), True) for _, t in rows]


def test_blocks_of_a_table(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> plain"), (4, "x " * 5000), (None, "a"), (5, "é" * 300)]
    blocks = tokens.write_blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), block=7)
    e = tokens.encoder()
    got = [(r.document, r.n_tokens, r.ended) for r in tokens.scan(blocks).orderBy("document").collect()]
    assert got == [(i, len(e.encode_ordinary(t or "")), True) for i, (_, t) in enumerate(rows)]


def test_clashing_names_and_repeated_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b", 3, 4)] * 2, "doc_id long, text string, file int, n_tokens int").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in tokens.query(spark, str(tmp_path)).collect()] == [(1, 2), (1, 2)]


def test_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, "a b"), (-1, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_tokens for r in tokens.query(spark, str(tmp_path)).collect()} == {None: 2, -1: 1}


def test_flat_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 4)
    rng = np.random.default_rng(1)
    want = {}
    for name, sizes, rest in (("a.bin", [0, 0, 5, 1, 400, 3], 0), ("b.bin", rng.integers(0, 90, 60).tolist(), 11), ("c.bin", [], 9), ("d.bin", [], 0)):
        x = np.concatenate([np.append(rng.integers(0, 50256, n), 50256) for n in sizes] + [rng.integers(0, 50256, rest)]).astype("<u2")
        (tmp_path / name).write_bytes(x.tobytes())
        want[name] = [(n, True) for n in sizes] + [(rest, False)] * (rest > 0)
    for block in (1, 4, 13, 1 << 18):
        got = {}
        for r in sorted(tokens.scan(tokens.read_files(spark, str(tmp_path), block=block)).collect(), key=lambda r: (r.file, r.document)):
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.n_tokens, r.ended))
        assert got == {k: v for k, v in want.items() if v}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert tokens.query(spark, str(tmp_path)).count() == 0
    tokens.write_files(spark.read.parquet(str(tmp_path / "documents.parquet")), f"file://{tmp_path}/files")
    assert tokens.scan(tokens.cut(tokens.written(spark, f"file://{tmp_path}/files", "tokens"))).count() == 0
