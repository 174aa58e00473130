"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded selection.

Blocks go to sources by the highest quotients target / (2k + 1), and a
source's blocks to its shards by the highest quotients of the shards' sizes.
A shard's documents stand in a seeded order and form one stream of words, cut
into blocks of DRAWN words; of these as many are drawn, by a seeded
permutation, as the shard's quota needs after whole rounds, and of the next
one the words that are left. So every count is an integer, shards are
independent tasks, and a hot source has many shards.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, table

WORD = r"[^\x20\x09-\x0D]+"
SHARD_WORDS = 200_000
MAX_SHARDS = 1 << 16  # bounds what the driver sees besides a row for each source
MOST = 3  # times a source's size
DRAWN = 1024  # words of a block of a shard's stream
FINE = 100  # blocks that the smallest target has at least, so far as blocks have words


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; one above `most` times its size stops there, the excess is reshared."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        above = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in above or free:
            out[i] = float(most * sizes[i]) if above else unit * weights[i]
        if not above:
            break
        left -= sum(most * sizes[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1); ties go to the earlier. No votes at all: no seats."""
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    n = len(votes)
    # with divisor total / (seats - n / 2) or more, rounding gives no more than `seats`: these seats are certain
    unit = total / (seats - n / 2) if seats > n else None
    out = [int(v / unit + 0.5) if unit else 0 for v in votes]
    if sum(out) > seats:
        out = [0] * n
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, out)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), block: int = 0, seed: int = 42, most: int = MOST) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken) of each row of docs.

    Needs doc_id, text and source; other columns don't matter. Size: words of the text, null or empty 0.
    Sources by code point, null last as a source of its own; weights repeat.
    The targets share all words; none is above `most` times its source.
    taken: the words that the mix takes of this row, repeats counted, at most
    `most` times its size. block: words of a block of the quotas, 0: a 65,536th
    of all words or a hundredth of the smallest target, whichever is less, at
    least 1 and at most 1024. Repeated rows are rows of their own; an empty
    table gives an empty one. Reruns give the same. A very long text is as
    many blocks as it takes.

    The driver gets one row for each source and for each shard (at most
    MAX_SHARDS more than sources).
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    slim = keep(docs.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.xxhash64("text").alias("_t"), size.alias("size")))
    found = {r[0]: r[1] for r in slim.groupBy("_s").agg(F.sum("size")).toLocalIterator()}
    names = sorted((x for x in found if x is not None)) + [None] * (None in found)
    sizes = [found[x] for x in names]
    total = sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    block = block or max(1, min(1024, total // 65536, int(min((g for g in goal if g > 0), default=0)) // FINE))
    quota = sainte_lague(goal, round(total / block))
    each = max(SHARD_WORDS, total // MAX_SHARDS)
    shards = [max(1, -(-x // each)) for x in sizes]
    sources = spark.createDataFrame([(x, i, n, s, g) for i, (x, n, s, g) in enumerate(zip(names, shards, sizes, goal))], "_s string, _i int, _n int, source_size long, target double")
    placed = slim.join(sources, slim["_s"].eqNullSafe(sources["_s"])).drop(sources["_s"])
    placed = placed.withColumn("_h", F.xxhash64(F.lit(seed), "_d", "_t")).withColumn("_k", F.expr("int(pmod(_h, _n))"))
    cells: dict[int, dict[int, int]] = {}
    for i, k, s in placed.groupBy("_i", "_k").agg(F.sum("size")).toLocalIterator():
        cells.setdefault(i, {})[k] = s
    rows = []
    for i, own in cells.items():
        ks = sorted(own)
        words_of = {k: min(q * block, most * own[k]) for k, q in zip(ks, sainte_lague([own[k] for k in ks], quota[i]))}
        left = quota[i] * block - sum(words_of.values())  # what full shards leave goes to those with room
        for k in ks:
            more = min(left, most * own[k] - words_of[k])
            words_of[k] += more
            left -= more
            s, words = own[k], words_of[k]
            rounds, rest = divmod(words, s) if s else (0, 0)
            rows.append((i, k, rounds, rest, *_draw(i, k, s // DRAWN, seed)))
    quotas = spark.createDataFrame(rows, "_i int, _k int, _rounds long, _rest long, _blocks long, _step long, _from long")
    run = Window.partitionBy("_i", "_k").orderBy("_h", "_d", "_t").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.withColumn("_e", F.sum("size").over(run)).withColumn("_b", F.col("_e") - F.col("size")).join(quotas, ["_i", "_k"])
    # a block's place in the seeded order; the words beyond the last whole block come after all blocks
    place = "if(x < _blocks, pmod(_step * x + _from, greatest(_blocks, 1L)), _blocks)"
    until = f"least(_e, x * {DRAWN} + greatest(0L, if(x < _blocks, least({DRAWN}L, _rest - {place} * {DRAWN}), _rest - _blocks * {DRAWN})))"
    part = F.expr(f"if(size = 0 or _rest = 0, 0L, aggregate(sequence(_b div {DRAWN}, least(_blocks, (_e - 1) div {DRAWN})), 0L, (a, x) -> a + greatest(0L, {until} - greatest(_b, x * {DRAWN}))))")
    return at.select(F.col("_d").alias("doc_id"), F.col("_t").alias("text_hash"), F.col("_s").alias("source"), "size", "source_size", "target", (F.col("_rounds") * F.col("size") + part).alias("taken"))


def _draw(source: int, shard: int, blocks: int, seed: int) -> tuple[int, int, int]:
    """(blocks, step, from): block x stands at (step * x + from) mod blocks in a shard's seeded order."""
    rng = random.Random(f"{seed}:{source}:{shard}")
    step = 1
    if blocks > 2:
        while math.gcd(step := rng.randrange(1, blocks), blocks) > 1:
            pass
    return blocks, step, rng.randrange(max(blocks, 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: mixes all documents with the weights 1, 2, 3."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")
