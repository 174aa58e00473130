"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and marks; in scripts without spaces each
letter is a word. Windows of `least` words are hashed by Karp-Rabin in both
the documents and the benchmark (a text of fewer words is one window), and
joined: equal windows are the seeds. For each document and item with a seed
the longest match of unmarked words is marked, again and again, until none of
`least` words is left. Marked words over the item's words is its coverage,
whatever the order of the passages.

Only documents with a window in a bloom filter of the benchmark's windows, of
fixed size, go to the join, so a benchmark of any size takes one scan of the
documents and nothing of it but the filter is broadcast by hint.
"""

from __future__ import annotations

import heapq
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U, batches, bit_map, keep, ngrams, rolling, slices, table, windows

LEAST = 5
COVERAGE = 0.6
BITS = 24  # of the bloom filter: 2 MB, whatever the benchmark
SEEDS = 1_000_000  # seed pairs looked at together; more are looked at a range of diagonals at a time
#: ASCII that is neither letter nor digit separates words; so do white space and controls.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32
#: Unicode ranges of scripts that put no space between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF))
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point below 0x30000: 1 for a separator, 2 for a letter that is a word, else 0."""
    if not _kinds:
        x = np.fromiter((unicodedata.category(chr(i))[0] not in "LNM" for i in range(0x30000)), np.uint8, 0x30000)
        for low, high in UNSPACED:
            own = x[low : high + 1]
            own[own == 0] = 2
        _kinds.append(x)
    return _kinds[0]


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def normal_hashes(s) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words (of lower-cased text), and where each document's begin."""
    buf = s.buf
    at = np.flatnonzero(buf >= 0xC2)
    if not len(at):
        return s.hashes()
    n = 2 + (buf[at] >= 0xE0) + (buf[at] >= 0xF0)
    cp = (buf[at] & (0xFF >> (n + 1))).astype(np.int64)
    for k in range(1, 4):
        more = k < n
        cp[more] = cp[more] << 6 | buf[at[more] + k] & 63
    kind = kinds()[np.minimum(cp, 0x2FFFF)]
    for k in range(4):
        buf[at[(kind == 1) & (k < n)] + k] = 32
    own = kind == 2
    return s.hashes(np.concatenate([at[own], at[own] + n[own]]))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, U)
    i = np.arange(len(h) - n + 1)
    return windows(rolling(h), i, i + n)


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest runs of equal hashes on each diagonal."""
    order = np.lexsort((np.arange(len(b)), b))
    values, first = np.unique(b[order], return_index=True)
    rank = np.searchsorted(values, a)
    has = np.flatnonzero(values[np.minimum(rank, len(values) - 1)] == a)
    rank = rank[has]
    size = len(b) + 1
    key = np.repeat(np.arange(len(values)), np.diff(np.append(first, len(b)))) * size + order  # ascending: by hash, then place
    many = np.diff(np.append(first, len(b)))[rank].sum()
    width = len(a) + len(b) if many <= SEEDS else max(1, SEEDS // len(b))
    out = []
    for low in range(-len(b) + 1, len(a), width):  # diagonals: place in a less place in b
        x = np.searchsorted(key, rank * size + np.clip(has - low - width + 1, 0, len(b)), "left")
        y = np.searchsorted(key, rank * size + np.clip(has - low, -1, len(b) - 1), "right")
        count = np.maximum(y - x, 0)
        i = np.repeat(has, count)
        if not len(i):
            continue
        j = order[np.repeat(x, count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)]
        by = np.lexsort((i, i - j))
        i, j = i[by], j[by]
        at = np.flatnonzero(np.append(True, (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1)))
        out.append((i[at], j[at], np.diff(np.append(at, len(i)))))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length) of tiles that don't overlap, longest first.

    Ties: the match that begins first in doc, then in item. doc and item are
    arrays of word hashes.
    """
    if len(doc) < least or len(item) < least:
        return []
    s, t, n = _runs(window_hashes(doc, least), window_hashes(item, least))
    n = n + least - 1
    order = np.lexsort((t, s, -n))
    whole = zip(n[order].tolist(), s[order].tolist(), t[order].tolist())
    free_a, free_b = np.ones(len(doc), bool), np.ones(len(item), bool)
    heap: list[tuple[int, int, int]] = []  # what marks have left of matches
    out = []
    following = next(whole, None)
    while heap or following:
        if following and (not heap or (-following[0], *following[1:]) <= heap[0]):
            (n, s, t), following = following, next(whole, None)
        else:
            n, s, t = heapq.heappop(heap)
            n = -n
        open_ = free_a[s : s + n] & free_b[t : t + n]
        if open_.all():
            free_a[s : s + n] = False
            free_b[t : t + n] = False
            out.append((s, t, n))
            continue
        # what is left of it waits for its turn by its own length
        edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
        for x, y in zip(edge[::2], edge[1::2]):
            if y - x >= least:
                heapq.heappush(heap, (-int(y - x), s + int(x), t + int(x)))
    return out


def items_of(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(item_id, words, seeds): each item's word hashes as uint64, and its distinct windows. Items without a word are left out."""

    def run(it):
        for b in it:
            for s in slices(lowered(b["text"]), PLAIN):
                h, begin = normal_hashes(s)
                w, doc = ngrams(h, begin, least)
                ends = np.searchsorted(doc, np.arange(s.n + 1))
                some = [i for i in range(s.n) if begin[i + 1] > begin[i]]
                ids = b["item_id"][s.at.start : s.at.stop]
                yield {"item_id": ids.take(pa.array(some, pa.int64())), "words": [h[begin[i] : begin[i + 1]].tobytes() for i in some], "seeds": [np.unique(w[ends[i] : ends[i + 1]]).view(np.int64) for i in some]}

    return batches(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), run, "item_id long, words binary, seeds array<bigint>")


def bloom(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """Two parts of each window's hash, its top bits and the next, in one bit map."""
    parts = F.array(F.shiftrightunsigned("seed", 64 - bits), F.shiftrightunsigned("seed", 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1)))
    return bit_map(seeds.select(F.explode(parts).alias("at")), bits)


def candidates(docs: DataFrame, there: np.ndarray, least: int = LEAST) -> DataFrame:
    """(row, doc_id, words, seeds) of each row of docs (doc_id, text) with a window in the bloom filter: its word hashes, and those windows."""
    shared = docs.sparkSession.sparkContext.broadcast(there)
    size = int(np.log2(len(there) * 8))

    def run(it):
        bits, row = shared.value, TaskContext.get().partitionId() << 33
        for b in it:
            for s in slices(lowered(b["text"]), PLAIN):
                h, begin = normal_hashes(s)
                w, doc = ngrams(h, begin, least)
                hit = np.arange(len(w))
                for shift in (64 - size, 64 - 2 * size):
                    at = (w[hit] >> U(shift) & U((1 << size) - 1)).astype(np.int64)
                    hit = hit[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
                some, first = np.unique(doc[hit], return_index=True)
                seeds = [np.unique(w[x]).view(np.int64) for x in np.split(hit, first[1:])] if len(some) else []
                yield {"row": row + np.arange(len(some)), "doc_id": b["doc_id"][s.at.start : s.at.stop].take(pa.array(some)), "words": [h[begin[i] : begin[i + 1]].tobytes() for i in some], "seeds": seeds}
                row += len(some)

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "row long, doc_id long, words binary, seeds array<bigint>")


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, doc_id, item_id, covered, item_words, coverage, tiles) for each row of docs and item with a tile.

    tiles: array of (doc_start, item_start, length) in words, longest first.
    An item of fewer than `least` words matches texts of the same words alone.
    Texts without a word match nothing. Items of one item_id are items of
    their own; a null item_id stays null.
    """
    items = keep(items_of(benchmark, least).withColumn("item", F.monotonically_increasing_id()))
    seeds = keep(items.select(F.explode("seeds").alias("seed"), "item"))
    found = keep(candidates(docs, bloom(seeds), least))
    pairs = found.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row", "item").distinct()
    both = pairs.join(items.select("item", "item_id", F.col("words").alias("own")), "item").join(found.select("row", "doc_id", "words"), "row")

    def run(it):
        for b in it:
            rows = {x: [] for x in ("covered", "item_words", "coverage", "tiles")}
            for doc, item in zip(b["words"].to_pylist(), b["own"].to_pylist()):
                doc, item = np.frombuffer(doc, U), np.frombuffer(item, U)
                tiles = tile(doc, item, min(least, len(item)))
                n = sum(x[2] for x in tiles)
                for k, v in zip(rows, (n, len(item), n / len(item), [{"doc_start": x, "item_start": y, "length": z} for x, y, z in tiles])):
                    rows[k].append(v)
            yield {"row": b["row"], "doc_id": b["doc_id"], "item_id": b["item_id"], **rows}

    return batches(both.select("row", "doc_id", "item_id", "words", "own"), run, "row long, doc_id long, item_id long, covered int, item_words int, coverage double, tiles array<struct<doc_start:int,item_start:int,length:int>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, coverage, item_id, n_items, contaminated) of each document.

    coverage: the highest of any item, 0 without a match; item_id: the smallest
    item with it, else null; n_items: items with coverage at the threshold or
    above; contaminated: whether there is one. One row for each row of docs;
    rows of the same doc_id get the results of all of them. Without a
    benchmark nothing is contaminated. Null doc_id: no match is reported.
    Texts of any length are tiled whole; other columns don't matter, nor does
    the order of the rows.
    """
    found = keep(matches(docs, benchmark, least).drop("tiles"))
    best = found.groupBy("doc_id").agg(F.max("coverage").alias("coverage"), F.max(F.struct("coverage", -F.col("item_id")))["col2"].alias("_i"), F.countDistinct(F.when(F.col("coverage") >= coverage, F.col("item_id"))).alias("n_items"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(best, "doc_id", "left")
    return out.select("doc_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), (-F.col("_i")).alias("item_id"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce(F.col("n_items") > 0, F.lit(False)).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document against every benchmark item."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
