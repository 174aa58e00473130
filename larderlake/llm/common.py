"""What the text operators share: words and hashes of whole Arrow batches, shared tables, dense counters, components.

A batch's texts stay one byte buffer. Words, hashes and n-grams are arrays over
that buffer, so no Python object is made per word. Slices of at most SLICE
bytes (one document at least) bound the memory, whatever a batch holds.
"""

from __future__ import annotations

import atexit
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 500_000
MAX_DOCS = 4096  # documents in a slice, so that an index takes 12 bits
ROWS = 1000  # rows of an Arrow batch, at most
CHUNK = 1 << 16  # counters in one row of a dense counter
HUB = 1_000_000  # links from which a node's are split over tasks

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    if len(_powers.get("up", ())) < max(n, 1):
        m = max(n, SLICE + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(m, base, U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a Karp-Rabin polynomial over `values`."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up, out=out[1:])
    return out


def windows(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever its place."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


class Slice:
    """Some documents of a batch: `at` their rows in it, `buf` their bytes, `offs` where each begins."""

    def __init__(self, at: slice, buf: np.ndarray, offs: np.ndarray):
        self.at, self.buf, self.offs, self.n = at, buf, offs, len(offs) - 1

    def words(self, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, cut at `cuts` too, and where each document's words begin (n + 1)."""
        ink = ~WHITE[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.offs] = True
        if cuts is not None:
            edge[cuts] = True
        first, last = ink & edge[:-1], ink & edge[1:]
        first[1:] |= ink[1:] & ~ink[:-1]
        last[:-1] |= ink[:-1] & ~ink[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, np.searchsorted(s, self.offs)

    def hashes(self, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each word, and where each document's words begin."""
        s, e, begin = self.words(cuts)
        return windows(rolling(BYTE[self.buf]), s, e), begin


def slices(column: pa.Array, table: np.ndarray | None = LOWER, size: int = SLICE):
    """Cuts a string column into slices; null counts as empty. table: maps each byte."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + MAX_DOCS, len(column))
        buf = data[offs[i] : offs[j]]
        yield Slice(slice(i, j), table[buf] if table is not None else buf, offs[i : j + 1] - offs[i])
        i = j


def ngrams(h: np.ndarray, begin: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and the document of each. short: fewer words make one shingle of them all."""
    count = np.diff(begin)
    many = np.maximum(count - n + 1, (count > 0).astype(count.dtype) if short else 0)
    doc = np.repeat(np.arange(len(count)), many)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + begin[doc]
    return windows(rolling(h), first, np.minimum(first + n, begin[doc + 1])), doc


def distinct(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 52-bit tokens of each document in order of (document, token)."""
    key = np.sort((doc.astype(U) << U(52)) | (g >> U(12)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return key & U((1 << 52) - 1), (key >> U(52)).astype(np.int64)


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a string column compressed, for shuffles of whole texts: about two thirds of what Spark's own codec leaves."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    lower_batches(df.sparkSession)
    out = StructType([StructField(f.name, BinaryType()) if f.name == column else f for f in df.schema.fields])

    def run(it):
        for b in it:
            own = pa.array([None if x is None else zlib.compress(x.encode(), 1) for x in b[column].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([own if f.name == column else b.column(i) for i, f in enumerate(b.schema)], names=b.schema.names)

    return df.mapInArrow(run, out)


def unpacked(column: pa.Array) -> pa.Array:
    """The strings of a column that is packed, or not."""
    if not pa.types.is_binary(column.type):
        return column
    return pa.array([None if x is None else zlib.decompress(x).decode() for x in column.to_pylist()], pa.string())


# Shared tables


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, as in tests, one under /tmp is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/larderlake-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a shared folder, if the session still lives."""
    try:
        jvm, p = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        del jvm
    except Exception:  # the session has ended
        pass


def keep(df: DataFrame, codec: str = "zstd", scratch: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors.

    It stays until the session ends, or until the caller forgets the folder,
    which is added to `scratch`.
    """
    path = shared_dir(df.sparkSession)
    if scratch is not None:
        scratch.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_batches(spark: SparkSession) -> None:
    """Texts may be long, so a batch of the default 10,000 rows may not fit in a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


def batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow of a function from an iterator of batches to dicts of columns. Batches get at most ROWS rows."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    lower_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)

    def run(it):
        for out in function(it):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


# Dense counters: a fixed number of counters, summed over all tasks


def counted(df: DataFrame, count, width: int) -> DataFrame:
    """Sums counters over the whole input. count: from an iterator of batches to an array of `width` counts.

    A task sends one compressed row for each CHUNK of counters that isn't zero;
    rows of one chunk are summed where they meet. What moves is bounded by
    tasks times width, and no key is hot.
    """

    def run(it):
        c = count(it)
        parts = [(i, c[i * CHUNK : (i + 1) * CHUNK]) for i in range(-(-width // CHUNK))]
        parts = [(i, x) for i, x in parts if x.any()]
        yield {"chunk": [i for i, _ in parts], "counts": [zlib.compress(x.astype(np.int64).tobytes(), 1) for _, x in parts]}

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for i, x in zip(b["chunk"].to_pylist(), b["counts"].to_pylist()):
                x = np.frombuffer(zlib.decompress(x), np.int64)
                sums[i] = sums[i] + x if i in sums else x
        yield {"chunk": list(sums), "counts": [zlib.compress(x.tobytes(), 1) for x in sums.values()]}

    parts = batches(df, run, "chunk int, counts binary")
    return batches(parts.repartition("chunk"), add, "chunk int, counts binary")


def dense(df: DataFrame, width: int, kind=np.int64) -> np.ndarray:
    """The counters on the driver; their number is fixed, so their size is bounded."""
    out = np.zeros(-(-width // CHUNK) * CHUNK, kind)
    for i, x in df.toLocalIterator():
        x = np.frombuffer(zlib.decompress(bytes(x)), np.int64)
        out[i * CHUNK : i * CHUNK + len(x)] = x
    return out[:width]


def bit_map(df: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits on the driver, packed: those that the column `at` of df names are set. Their number is fixed, so their size is bounded."""
    size = min(CHUNK, 1 << bits)

    def gathered(chunks: dict[int, np.ndarray]):
        return {"chunk": list(chunks), "bits": [zlib.compress(x.tobytes(), 1) for x in chunks.values()]}

    def mark(it):
        c = np.zeros(1 << bits, bool)
        for b in it:
            c[b["at"].to_numpy(zero_copy_only=False)] = True
        some = np.flatnonzero(c.reshape(-1, size).any(1))
        yield gathered({int(i): np.packbits(c[i * size : (i + 1) * size]) for i in some})

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for i, x in zip(b["chunk"].to_pylist(), b["bits"].to_pylist()):
                x = np.frombuffer(zlib.decompress(x), np.uint8)
                sums[i] = sums[i] | x if i in sums else x
        yield gathered(sums)

    parts = batches(df.select("at"), mark, "chunk int, bits binary").repartition("chunk")
    out = np.zeros(1 << bits >> 3, np.uint8)
    for i, x in batches(parts, add, "chunk int, bits binary").collect():
        x = np.frombuffer(zlib.decompress(bytes(x)), np.uint8)
        out[i * (size >> 3) : i * (size >> 3) + len(x)] = x
    return out


# Connected components


def components(links: DataFrame, rounds: int = 60, scratch: list[str] | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b). Nodes without a link are absent.

    Large-star and small-star steps alternate until nothing changes; all
    steps are joins and minima over the link table, each written to the
    shared folder. The number of steps grows with the logarithm of the size.
    Self-links and null ends are ignored. Where there are HUB links or more a
    node may have so many that they fill a task: then the minima are written
    before they are joined, so that the join is between plain shuffles and
    Spark splits a hub's rows over several tasks.
    """
    spark, before, own = links.sparkSession, None, []
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), scratch=own)
    links_left = edges.count()
    for _ in range(rounds):
        passing: list[str] = []
        low_of = lambda df, m: keep(df.groupBy("u").agg(m), scratch=passing).hint("merge") if links_left >= HUB else df.groupBy("u").agg(m)  # noqa: E731, B023
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        large = both.where("v > u").join(low_of(both, F.least(F.min("v"), F.first("u")).alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = low_of(large, F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = keep(small, scratch=own)
        forget(spark, own.pop(0))
        for path in passing:
            forget(spark, path)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        links_left = now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    if scratch is not None:
        scratch += own
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
