"""Token counts of documents in flat, unindexed token files.

A file is token ids back to back, an end-of-document id after each document,
and no index. It is read in blocks that know nothing of documents. Each block
is searched for the id as a whole array; a prefix scan over the blocks of a
file, in two levels, then gives each block the documents before it and the
tokens that its first document has in earlier blocks.

write_files() makes such files with Spark's own text writer, one value a file,
so they can lie in any file system that Spark has; the writer's line end, one
byte, is no whole token. The query keeps its files' blocks in Parquet instead:
one value a file took more memory than an executor of the check has. The
vocabulary file must be there on every executor.
"""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, keep, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: Fixed value: the pattern that splits a text before byte-pair merges in this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 18  # tokens
RUN = 1024  # blocks of one run of the first level
FILE = 1 << 20  # tokens of a flat file, from which a new one begins after a document
NULL_ID = -(1 << 63)  # stands for a null doc_id in a side list
_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file, once for each process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def write_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, block: int = BLOCK) -> DataFrame:
    """Tokenises docs (doc_id, text) to flat files, one for each partition: (file, block, tokens, ids).

    tokens: little-endian uint16 ids of one block, cut without regard to
    documents. ids: the file's side list, the int64 doc_ids in the order of
    the documents, in rows with null tokens where `block` is the place of the
    first. Null text: no token, its end id alone. Null doc_id: NULL_ID.
    """

    def run(it):
        encode, file, at, listed = encoder(vocabulary).encode_ordinary, TaskContext.get().partitionId(), 0, 0
        held, n = [], 0
        for b in it:
            for text in b["text"].to_pylist():
                x = np.array([*encode(text or ""), end], "<u2")
                held.append(x)
                n += len(x)
                if n >= block:
                    x = np.concatenate(held)
                    full = len(x) // block
                    yield {"file": [file] * full, "block": list(range(at, at + full)), "tokens": [x[i * block : (i + 1) * block].tobytes() for i in range(full)], "ids": [None] * full}
                    held, at = [x[full * block :]], at + full
                    n = len(held[0])
            ids = np.array([NULL_ID if x is None else x for x in b["doc_id"].to_pylist()], "<i8")
            yield {"file": [file], "block": [listed], "tokens": [None], "ids": [ids.tobytes()]}
            listed += len(ids)
        if n:
            yield {"file": [file], "block": [at], "tokens": [np.concatenate(held).tobytes()], "ids": [None]}

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "file long, block long, tokens binary, ids binary")


def write_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, size: int = FILE) -> None:
    """Tokenises docs (doc_id, text) to flat files below a path, in folders kind=tokens/file=n and kind=ids/file=n.

    tokens: little-endian uint16 ids. ids: the side list, the int64 doc_ids in
    the order of the documents. A partition's documents go to one file until
    it has `size` tokens, then to the next. Null and empty texts: their end id
    alone. Null doc_id: NULL_ID. Repeated rows are documents of their own;
    other columns don't matter.
    """

    def run(it):
        encode, file = encoder(vocabulary).encode_ordinary, TaskContext.get().partitionId() << 24
        held, ids, n = [], [], 0

        def out():
            return {"kind": ["tokens", "ids"], "file": [file, file], "data": [np.concatenate(held).tobytes(), np.array(ids, "<i8").tobytes()]}

        for b in it:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                held.append(np.array([*encode(text or ""), end], "<u2"))
                ids.append(NULL_ID if doc is None else doc)
                n += len(held[-1])
                if n >= size:
                    yield out()
                    held, ids, n, file = [], [], 0, file + 1
        if ids:
            yield out()

    files = batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "kind string, file long, data binary")
    files.select("kind", "file", F.col("data").cast("string").alias("value")).write.partitionBy("kind", "file").text(path)


def written(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, content) of the files of one kind that write_files wrote, read whole by Spark: they are small."""
    found = spark.read.format("binaryFile").load(path)
    if "kind" not in found.columns:  # no document, no file
        return spark.createDataFrame([], "file long, content binary")
    return found.where(F.col("kind") == kind).select(F.col("file").cast("long"), "content")


def cut(files: DataFrame, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, tokens) of whole files (file, content) in blocks of `block` tokens. Bytes beyond the last whole token are left out."""

    def run(it):
        for b in it:
            for file, x in zip(b["file"].to_pylist(), b["content"].to_pylist()):
                n = -(-(len(x) // width) // block)
                yield {"file": [file] * n, "block": list(range(n)), "tokens": [x[i * block * width : min((i + 1) * block, len(x) // width) * width] for i in range(n)]}

    return batches(files.select("file", "content"), run, "file long, block long, tokens binary")


def read_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, tokens) of the flat files under a path: ranges of `block` tokens, each read by its own task.

    Only names and lengths are listed; each range is opened by its URI on the
    executor. Bytes beyond the last whole token are left out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    files = files.withColumn("_n", F.expr(f"(length div {width} + {block - 1}) div {block}")).where("_n > 0")
    ranges = files.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("block")).repartition(F.col("file"), F.col("block"))

    def run(it):
        from pyarrow import fs

        for b in it:
            out = []
            for name, i in zip(b["file"].to_pylist(), b["block"].to_pylist()):
                system, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
                with system.open_input_file(at) as f:
                    f.seek(i * block * width)
                    x = f.read(block * width)
                out.append(x[: len(x) // width * width])
            yield {"file": b["file"], "block": b["block"], "tokens": out}

    return batches(ranges, run, "file string, block long, tokens binary")


def scan(blocks: DataFrame, end: int = END, kind: str = "<u2") -> DataFrame:
    """(file, document, n_tokens, ended) of every document in the blocks (file, block, tokens) of flat files.

    document: its place in the file from 0. n_tokens: without the end id.
    ended: false for tokens at a file's end that no end id follows; they
    count as a document, no tokens at all don't. Null or empty blocks hold no
    token. Blocks must be numbered in the order of the file.
    """
    name = blocks.schema["file"].dataType.simpleString()

    def search(it):
        for b in it:
            n, seps, head, tail, inner = [], [], [], [], []
            for x in b["tokens"].to_pylist():
                x = np.frombuffer(x or b"", kind)
                at = np.flatnonzero(x == end)
                n.append(len(x))
                seps.append(len(at))
                head.append(int(at[0]) if len(at) else len(x))
                tail.append(len(x) - 1 - int(at[-1]) if len(at) else 0)
                inner.append((np.diff(at) - 1).astype("<i8").tobytes())
            yield {"file": b["file"], "block": b["block"], "n": n, "seps": seps, "head": head, "tail": tail, "inner": inner}

    found = batches(blocks.select("file", "block", "tokens").where("tokens is not null"), search, f"file {name}, block long, n long, seps long, head long, tail long, inner binary")
    found = keep(found.withColumn("run", F.expr(f"block div {RUN}")))  # the blocks are read once
    # within a run: tokens and documents before each block, and where the document after the last end before it begins
    inside = Window.partitionBy("file", "run").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    own = found.drop("inner").withColumn("_at", F.coalesce(F.sum("n").over(before), zero)).withColumn("_first", F.coalesce(F.sum("seps").over(before), zero))
    own = own.withColumn("_open", F.when(F.col("seps") > 0, F.col("_at") + F.col("n") - F.col("tail")))
    # over a file's runs the same, from a row a run
    runs = own.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("_open").alias("open"))
    along = Window.partitionBy("file").orderBy("run")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_at", F.coalesce(F.sum("n").over(earlier), zero)).withColumn("run_first", F.coalesce(F.sum("seps").over(earlier), zero))
    runs = runs.withColumn("run_open", F.max(F.col("run_at") + F.col("open")).over(earlier)).withColumn("run_last", F.lead("run").over(along).isNull())
    own = own.withColumn("_before", F.max("_open").over(before)).withColumn("_last", F.lead("block").over(inside).isNull())
    at = F.col("run_at") + F.col("_at")
    scanned = own.join(runs.select("file", "run", "run_at", "run_first", "run_open", "run_last"), ["file", "run"]).select(
        "file", "block", (F.col("run_first") + F.col("_first")).alias("first"), (at - F.coalesce(F.col("run_at") + F.col("_before"), "run_open", zero)).alias("carry"), (F.col("run_last") & F.col("_last")).alias("last"),
    )
    scanned = found.join(scanned, ["file", "block"])

    def stitch(it):
        for b in it:
            rows = {"file": [], "document": [], "n_tokens": [], "ended": []}
            for file, n, seps, head, tail, inner, first, carry, last in zip(*(b[x].to_pylist() for x in ("file", "n", "seps", "head", "tail", "inner", "first", "carry", "last"))):
                sizes = [carry + head, *np.frombuffer(inner, "<i8").tolist()] if seps else []
                rest = tail if seps else carry + n
                ended = [True] * len(sizes)
                if last and rest:
                    sizes.append(rest)
                    ended.append(False)
                rows["file"] += [file] * len(sizes)
                rows["document"] += range(first, first + len(sizes))
                rows["n_tokens"] += sizes
                rows["ended"] += ended
            yield rows

    return batches(scanned.select("file", "n", "seps", "head", "tail", "inner", "first", "carry", "last"), stitch, f"file {name}, document long, n_tokens long, ended boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: writes all documents as token files to the shared folder, scans them, names the documents by the side lists."""
    stored = keep(write_blocks(table(spark, sf_dir, "documents")))

    def listed(it):
        for b in it:
            for file, first, ids in zip(*(b[x].to_pylist() for x in ("file", "block", "ids"))):
                x = np.frombuffer(ids, "<i8")
                yield {"file": [file] * len(x), "document": range(first, first + len(x)), "doc_id": x}

    ids = batches(stored.where("ids is not null").select("file", "block", "ids"), listed, "file long, document long, doc_id long")
    return ids.join(scan(stored), ["file", "document"]).select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_tokens")
