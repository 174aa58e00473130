"""Quality classifier: interpolated modified Kneser-Ney over characters, learned from trusted texts.

The n-grams are of ORDER code points. Counts, continuation counts, discounts
and probabilities are tables, summed and joined by n-gram; the model is a row
for each n-gram seen, with its log probability and the weight of what is left
to shorter ones. Its rows lie in shards by the n-gram's hash.

A task's documents are slices. Of a slice the distinct n-grams go to their
shards, are joined there with the model in one sorted pass, and the
probabilities found come back to the slice's texts. So nothing of the model
is broadcast, what is gathered grows with the corpus, and a frequent n-gram
costs a row a slice.

A document's perplexity is compared with two quantiles of the trusted
documents' in its language and band of length; see `classify`. Trusted
documents of a fixed part of the ids aren't learned from: the upper quantile
is theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, batches, bit_map, keep, lower_batches, mix, packed, slices, table, unpacked
from .langid import code_points

ORDER = 4
WIDE = 21  # bits of a code point
POINT = (1 << WIDE) - 1
PAD = 10  # a text follows three line ends
LEAST_LOG = -20.0
#: Text bytes of a slice, n-grams of a shard (about, at most), slots of a task's table of n-grams met before, as bits.
SLICE_BYTES, SHARD, SLOTS = 32_000_000, 1 << 18, 20
#: Bits of the bloom filter of the ids to learn from: 2 MB, whatever the corpus.
BITS = 24
#: Share of trusted documents below the quantile; what is allowed beyond it in log perplexity, and besides for short texts, over the root of their length.
QUANTILE, SLACK, SHORT = 0.99, 0.05, 3.0
#: Share of trusted documents below the lower quantile, and how many of those not learned from a band needs to have quantiles of its own.
LOWEST, BAND_LEAST = 0.005, 50
#: One in HELD trusted documents, by the CRC of its id, isn't learned from.
HELD = 4


def grams(s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character the three before it (the nearest in the lowest bits) and itself; where each document's begin."""
    cp, begin = code_points(s.buf, s.offs)
    cp = cp.astype(U)
    at = np.arange(len(cp)) - np.repeat(begin[:-1], np.diff(begin))
    context = np.zeros(len(cp), U)
    for k in range(1, ORDER):
        back = np.full(len(cp), PAD, U)
        back[k:] = cp[:-k]
        back[at < k] = PAD
        context |= back << U(WIDE * (k - 1))
    return context, cp, begin


def keyed(order: int, context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each n-gram of an order: its first characters, the nearest in the lowest bits, and its last."""
    low = context & U((1 << WIDE * (order - 1)) - 1)
    return mix((low + U(order)) * U(0x9E3779B97F4A7C15) ^ mix(last + U(order << 32)))


class Met:
    """N-grams met before, with a value each, in slots by hash: one that finds its slot taken is looked up anew, which costs time alone."""

    def __init__(self):
        self.keys, self.values = np.zeros(1 << SLOTS, U), np.zeros(1 << SLOTS, np.float32)

    def new(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, whether the key isn't in its slot)."""
        at = (key >> U(64 - SLOTS)).astype(np.int64)
        return at, self.keys[at] != key


def counts_of(texts: DataFrame) -> DataFrame:
    """(context, last, n): how often each n-gram of the highest order stands in `text`, packed or not. Null and empty texts count for nothing."""

    def run(it):
        held: list[tuple] = []

        def merged():
            context, last, n = (np.concatenate(x) for x in zip(*held))
            key = keyed(ORDER, context, last)
            _, first, same = np.unique(key, return_index=True, return_inverse=True)
            return context[first], last[first], np.bincount(same, n).astype(np.int64)

        for b in it:
            for s in slices(unpacked(b["text"]), None):
                context, last, _ = grams(s)
                _, first, n = np.unique(keyed(ORDER, context, last), return_index=True, return_counts=True)
                held.append((context[first], last[first], n))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield dict(zip(("context", "last", "n"), (held[0][0].view(np.int64), held[0][1].astype(np.int32), held[0][2])))
                        held = []
        if held:
            context, last, n = merged()
            yield {"context": context.view(np.int64), "last": last.astype(np.int32), "n": n}

    lower_batches(texts.sparkSession)
    return batches(texts.select("text"), run, "context long, last int, n long").groupBy("context", "last").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Discounts for counts of 1, 2 and 3 or more, from how many n-grams have the counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return [min(max(x, 0.0), top) for x, top in zip(d, (1.0, 2.0, 3.0))]


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """The model of counts (context, last, n): (order, context, last, p, left), and the probability of a character never seen.

    p: the interpolated probability of the n-gram's last character, null where
    the n-gram isn't one of its order. left: what an n-gram, as a context,
    leaves to the next shorter one; null where nothing follows it. Lower
    orders count the distinct characters before an n-gram; the lowest is
    interpolated with the uniform distribution over all characters seen and
    one for those that weren't.
    """
    spark, counts = counts.sparkSession, keep(counts)
    levels, rows = {order: counts}, []
    for k in range(order - 1, 0, -1):
        low = F.col("context").bitwiseAND(F.lit((1 << WIDE * (k - 1)) - 1)).alias("context")
        levels[k] = keep(levels[k + 1].groupBy(low, "last").agg(F.count("*").alias("n")))
    found = None
    for k, level in levels.items():
        one = level.agg(F.lit(k).alias("k"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.sum("n").alias("total"), F.count("*").alias("rows"))
        found = one if found is None else found.union(one)
    seen = {r.k: r for r in found.collect()}  # a row an order
    uniform = 1.0 / (seen[1]["rows"] + 1)
    below, never = None, uniform
    for k in range(1, order + 1):
        d = discounts(*(float(seen[k][f"n{i}"]) for i in (1, 2, 3, 4)))
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        level = levels[k]
        if k == 1:
            total = seen[1].total
            left = sum(x * y for x, y in zip(d, (seen[1].n1, seen[1].n2, seen[1]["rows"] - seen[1].n1 - seen[1].n2))) / total if total else 1.0
            never = left * uniform
            p = level.select("context", "last", ((F.col("n") - cut) / F.lit(float(total or 1)) + F.lit(never)).alias("p"))
        else:
            context = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut")).select("context", "total", (F.col("cut") / F.col("total")).alias("left"))
            shorter = below.select(F.col("context").alias("_c"), F.col("last").alias("_l"), F.col("p").alias("_p"))
            low = F.col("context").bitwiseAND(F.lit((1 << WIDE * (k - 2)) - 1))
            p = level.join(context, "context").join(shorter, (low == F.col("_c")) & (F.col("last") == F.col("_l"))).select("context", "last", ((F.col("n") - cut) / F.col("total") + F.col("left") * F.col("_p")).alias("p"))
            last = F.col("context").bitwiseAND(F.lit(POINT)).cast("int")
            rows.append(context.select(F.lit(k - 1).alias("order"), F.shiftrightunsigned("context", WIDE).alias("context"), last.alias("last"), F.lit(None).cast("double").alias("p"), "left"))
        below = keep(p)
        rows.append(below.select(F.lit(k).alias("order"), "context", "last", "p", F.lit(None).cast("double").alias("left")))
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    del spark
    return out.groupBy("order", "context", "last").agg(F.max("p").alias("p"), F.max("left").alias("left")), never


def sharded(model: DataFrame, least: int = 1) -> tuple[DataFrame, int]:
    """(shard, keys, p, left): the model's shards, a row each, sorted by key; and the bits of a shard's number. p, left: logs as float32, NaN for null."""

    def hashed(it):
        for b in it:
            order, context, last, p, left = (b[c].to_numpy(zero_copy_only=False) for c in ("order", "context", "last", "p", "left"))
            key = np.zeros(len(order), U)
            for k in range(1, ORDER + 1):
                i = order == k
                key[i] = keyed(k, context[i].view(U), last[i].astype(U))
            with np.errstate(divide="ignore"):
                yield {"key": key.view(np.int64), "p": np.log(p.astype(float)).astype(np.float32), "left": np.maximum(np.log(left.astype(float)), LEAST_LOG * 2).astype(np.float32)}

    rows = keep(batches(model, hashed, "key long, p float, left float"))
    bits = max(0, math.ceil(math.log2(max(rows.count() / SHARD, least, 1))))
    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)

    def run(it):
        held: list[tuple] = []

        def out():
            shard = int(held[0][0])
            key, p, left = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            by = np.argsort(key.view(U))
            return {"shard": [shard], "keys": [key[by].tobytes()], "p": [p[by].tobytes()], "left": [left[by].tobytes()]}

        for b in it:
            shard, key, p, left = (b[c].to_numpy(zero_copy_only=False) for c in ("shard", "key", "p", "left"))
            for part in np.split(np.arange(len(shard)), np.flatnonzero(shard[1:] != shard[:-1]) + 1):
                if not len(part):
                    continue
                if held and held[0][0] != shard[part[0]]:
                    yield out()
                    held = []
                held.append((shard[part[0]], key[part], p[part], left[part]))
        if held:
            yield out()

    rows = rows.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard")
    return batches(rows.select("shard", "key", "p", "left"), run, "shard int, keys binary, p binary, left binary"), bits


def needed(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The keys of all that the probabilities of some n-grams of the highest order may need: they and their ends, and the contexts of both. Ascending."""
    out = []
    for k in range(1, ORDER + 1):
        out.append(keyed(k, context, last))
        if k < ORDER:
            out.append(keyed(k, context >> U(WIDE), context & U(POINT)))
    return np.unique(np.concatenate(out))


def requests(docs: DataFrame, bits: int) -> DataFrame:
    """(shard, slice, size, keys): the distinct n-grams of each slice of docs (text), by the model's shards; size: the slice's bytes."""

    def run(it):
        number, size, met, held = TaskContext.get().partitionId() << 24, 0, Met(), []

        def out():
            key = needed(*(np.concatenate(x) for x in zip(*held)))
            shard = (key >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            some, first = np.unique(shard, return_index=True)
            return {"shard": some.astype(np.int32), "slice": np.full(len(some), number), "size": np.full(len(some), size), "keys": [x.tobytes() for x in np.split(key, first[1:])]}

        for b in it:
            for s in slices(b["text"], None):
                context, last, _ = grams(s)
                key = keyed(ORDER, context, last)
                at, new = met.new(key)
                met.keys[at[new]] = key[new]
                _, first = np.unique(key[new], return_index=True)
                held.append((context[new][first], last[new][first]))
                size += len(s.buf)
            if size >= SLICE_BYTES:
                yield out()
                number, size, met, held = number + 1, 0, Met(), []
        if size:
            yield out()

    return batches(docs.select("text"), run, "shard int, slice long, size long, keys binary")


def blocks(docs: DataFrame) -> DataFrame:
    """(slice, keys): the rows of docs (doc_id, lang, text) in compressed Arrow batches, cut into the slices of requests()."""

    def run(it):
        number, size = TaskContext.get().partitionId() << 24, 0
        for b in it:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield {"slice": [number], "keys": [out.getvalue().to_pybytes()]}
            size += sum(len(s.buf) for s in slices(b["text"], None))
            if size >= SLICE_BYTES:
                number, size = number + 1, 0

    return batches(docs.select("doc_id", "lang", "text"), run, "slice long, keys binary")


def answers(model: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    """(slice, size, keys, p, left): what the model has of the n-grams asked for.

    Both sides meet by shard, sorted so that a shard's model comes first and
    its requests stream past it. Where there are more tasks than shards, a
    shard's requests are dealt over several copies of its model.
    """
    parts = int(model.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, parts // (4 << bits))
    none = F.lit(None).cast("binary")
    left = model.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("slice"), F.lit(0).cast("long").alias("size"), "keys", "p", "left")
    right = asked.select("shard", F.pmod("slice", F.lit(salts)).cast("int").alias("salt"), "slice", "size", "keys", none.alias("p"), none.alias("left"))
    # the requests first: a union's first tasks keep the numbers that the slices are named by
    rows = right.unionByName(left).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "slice")

    def run(it):
        at, keys, values = None, np.zeros(0, U), (np.zeros(0, np.float32),) * 2
        for b in it:
            out = {x: [] for x in ("slice", "size", "keys", "p", "left")}
            for r in zip(*(b[c].to_pylist() for c in ("shard", "salt", "slice", "size", "keys", "p", "left"))):
                own = np.frombuffer(r[4], U)
                if r[2] < 0:
                    at, keys, values = r[:2], own, tuple(np.frombuffer(x, np.float32) for x in r[5:])
                    continue
                if at != r[:2]:
                    at, keys, values = r[:2], np.zeros(0, U), (np.zeros(0, np.float32),) * 2
                i = np.searchsorted(keys, own)
                hit = i < len(keys)
                hit[hit] = keys[i[hit]] == own[hit]
                for c, v in zip(out, (r[2], r[3], own[hit].tobytes(), *(x[i[hit]].tobytes() for x in values))):
                    out[c].append(v)
            yield out

    return batches(rows.select("shard", "salt", "slice", "size", "keys", "p", "left"), run, "slice long, size long, keys binary, p binary, left binary")


class Known:
    """The model's rows that a slice needs."""

    def __init__(self, keys: list[bytes], p: list[bytes], left: list[bytes], never: float):
        key = np.frombuffer(b"".join(keys), U)
        by = np.argsort(key)
        self.keys, self.never = key[by], never
        self.p, self.left = (np.frombuffer(b"".join(x), np.float32)[by] for x in (p, left))

    def of(self, values: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        if not len(self.keys):
            return np.full(len(key), np.nan, np.float32)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, values[i], np.float32(np.nan))

    def log_p(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams of the highest order: of the longest end that was seen, and what is left to it."""
        out = np.full(len(last), np.log(max(self.never, 1e-300)), np.float32)
        for k in range(1, ORDER + 1):
            if k > 1:  # what the context leaves, if it was seen
                out = out + np.nan_to_num(self.of(self.left, keyed(k - 1, context >> U(WIDE), context & U(POINT))), nan=0.0)
            p = self.of(self.p, keyed(k, context, last))
            out = np.where(np.isnan(p), out, p)
        return np.maximum(out, LEAST_LOG).astype(np.float32)


def perplexities(docs: DataFrame, model: DataFrame, never: float) -> DataFrame:
    """(doc_id, lang, n_characters, log_perplexity) of each row of docs (doc_id, lang, text); null without characters.

    The documents are read twice, for their n-grams and for their texts. Both
    reads must cut them into the same partitions, as reads of files do; a
    slice that differs in size is an error.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lower_batches(docs.sparkSession)
    shards, bits = sharded(model, min(parts, 256))
    found = answers(shards, requests(docs, bits), bits)
    none = F.lit(None).cast("binary")
    texts = blocks(docs).select("slice", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("size"), "keys", none.alias("p"), none.alias("left"))
    rows = texts.unionByName(found.select("slice", F.lit(0).alias("kind"), "size", "keys", "p", "left"))
    rows = rows.repartition(parts, "slice").sortWithinPartitions("slice", "kind")

    def run(it):
        at, held, known, met, left_of = None, [], None, None, 0

        def check():
            if left_of:
                raise RuntimeError("the two reads of the documents differ; write them to a table first")

        for b in it:
            for number, kind, size, keys, p, left in zip(*(b[c].to_pylist() for c in ("slice", "kind", "size", "keys", "p", "left"))):
                if number != at:
                    check()
                    at, held, known, left_of = number, [], None, 0
                if kind == 0:
                    held.append((keys, p, left))
                    left_of = size
                    continue
                if known is None:
                    known, met, held = Known(*([x[i] for x in held] for i in range(3)), never), Met(), []
                for own in pa.ipc.open_stream(keys):
                    n, total = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows)
                    for s in slices(own["text"], None):
                        context, last, begin = grams(s)
                        left_of -= len(s.buf)
                        key = keyed(ORDER, context, last)
                        place, new = met.new(key)
                        log_p = met.values[place]
                        if new.any():
                            _, first, same = np.unique(key[new], return_index=True, return_inverse=True)
                            fresh = known.log_p(context[new][first], last[new][first])
                            log_p[new] = fresh[same]
                            met.keys[place[new][first]], met.values[place[new][first]] = key[new][first], fresh
                        sums = np.append(0, np.cumsum(log_p, dtype=np.float64))
                        n[s.at] = np.diff(begin)
                        total[s.at] = sums[begin[1:]] - sums[begin[:-1]]
                    yield {"doc_id": own["doc_id"], "lang": own["lang"], "n_characters": n, "log_perplexity": pa.array(np.where(n > 0, -total / np.maximum(n, 1), 0.0), pa.float64(), mask=n == 0)}
        check()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches(rows, run, f"doc_id {kind}, lang string, n_characters long, log_perplexity double")


def listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) with one of the ids (doc_id), texts packed. A bloom filter of the ids, of fixed size, keeps most others from the shuffle."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS).cast("int")

    shared = docs.sparkSession.sparkContext.broadcast(bit_map(ids.select(place.alias("at")), BITS))  # 2 MB
    rows = docs.select("doc_id", "text", place.alias("_at"))

    def run(it):
        for b in it:
            at = b["_at"].to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))

    some = rows.mapInArrow(run, rows.schema).drop("_at")
    # a shuffle at every size: the labels grow with the documents
    return packed(some).join(ids.hint("merge"), "doc_id", "left_semi")


def held_out(doc_id: str, held: int = HELD) -> Column:
    """Whether a document is one of those that the model doesn't learn from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(held)) == 0 if held else F.lit(False)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, short: float = SHORT, held: int = HELD) -> DataFrame:
    """(doc_id, lang, n_characters, log_perplexity, threshold, trusted, accepted) of each row of docs (doc_id, text, lang).

    Trusted: labelled with quality 1 and toxic 0 (null toxic: 0). The model
    learns from all of them whose id's CRC-32 modulo `held` isn't 0; the upper
    quantile is that of the others (held 0: it learns from all, and the
    quantile is theirs; a column held_out of the labels: what it says). A band of length is a power of two of characters.
    threshold: the quantile of those documents' log perplexity in the row's
    language and band, if it has BAND_LEAST of them; such rows must not be
    below the LOWEST quantile of all trusted ones there either (one repeated
    word is predicted too well). In other bands the quantile of the language,
    plus slack, plus `short` over the root of the row's number of characters
    (short texts vary more); of all trusted ones where the language has none
    or is null. Accepted: not above the threshold, nor below the lower
    quantile. Without text, without trusted documents: accepted. Very long
    texts are scored whole, a piece of their characters at a time. Repeated
    rows stay, repeated labels count once; an empty table gives an empty one;
    other columns don't matter.
    """
    given = [F.col("held_out")] if "held_out" in labels.columns else [held_out("doc_id", held).alias("held_out")]
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id", *given).where("doc_id is not null").groupBy("doc_id").agg(F.max("held_out").alias("held_out"))
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    learn = (good.where("not held_out") if held else good).select("doc_id")
    model, never = kneser_ney(counts_of(listed(base, learn)))
    scored = keep(perplexities(base, model, never))
    scored = scored.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    out_of = F.col("held_out") if held else F.lit(True)
    band = F.floor(F.log2(F.greatest("n_characters", F.lit(1)))).cast("int")
    known = scored.where("trusted and log_perplexity is not null").withColumn("own", F.when(out_of, F.col("log_perplexity")))
    cut = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(100_000))
    # a row for each language; as a local relation Spark knows its size before it chooses the join
    own = docs.sparkSession.createDataFrame(known.where("lang is not null").groupBy("lang").agg((cut("own", quantile) + F.lit(slack)).alias("_own")).collect(), "lang string, _own double")
    whole = known.agg(F.coalesce(cut("own", quantile), cut("log_perplexity", quantile)) + F.lit(slack)).first()[0]
    by_band = known.where("lang is not null").groupBy("lang", band.alias("band")).agg(cut("own", quantile).alias("_high"), cut("log_perplexity", LOWEST).alias("_low"), F.count("own").alias("n"))
    # a row for each language and power of two
    bands = docs.sparkSession.createDataFrame(by_band.where(F.col("n") >= BAND_LEAST).drop("n").collect(), "lang string, band int, _high double, _low double")
    loose = F.coalesce("_own", F.lit(whole).cast("double")) + F.lit(float(short)) / F.sqrt(F.greatest("n_characters", F.lit(1)))
    out = scored.join(own, "lang", "left").withColumn("band", band).join(bands, ["lang", "band"], "left").withColumn("threshold", F.coalesce("_high", loose))
    fits = (F.col("log_perplexity") <= F.col("threshold")) & (F.col("log_perplexity") >= F.coalesce("_low", F.col("log_perplexity")))
    return out.select("doc_id", "lang", "n_characters", "log_perplexity", "threshold", "trusted", F.coalesce(fits, F.lit(True)).alias("accepted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: scores every document with a model of the trusted ones."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
