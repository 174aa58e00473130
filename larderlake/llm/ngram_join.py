"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once.

A document's set is its distinct shingles. Equal sets are one class, which
goes on once. The tokens of a class are ordered rare-first: by the mean log document
frequency of a shingle's words, from a sketch of all words of the corpus (any
order gives the same links, a rare-first one gives few candidates). Words are
few beside shingles, so the sketch tells common from rare at any size of the
corpus. Classes that link share a token of their prefixes.
Members of a prefix token's list are compared by

* length: the smaller set has at least t times the larger's tokens,
* position: tokens before and after the shared one can't reach the overlap,
* suffix: the sets' differences in fixed cells of the hash range, whose sum
  bounds the Hamming distance from below (the suffix filter's partition, with
  fixed pivots; it needs BITS bits for a set instead of the set).

Pairs that pass are compared by as many cells as suit their size, and whole
sets are fetched only for those that pass this too. For components no list
with more such pairs than members is expanded into them: first each member is
verified against the member of its block with the most partners, and those of
a list's blocks against each other, then each against its nearest, and only
what still lies in different components, and wasn't tested, is verified pair
by pair. These later comparisons have the members' cells beside them, so a pair
that cells rule out is never a row: the members of a large group that are too far
from each other have as many pairs as the square of its size. Lists are dealt by ranges of (token, size, id), so those of a hot
token lie in many tasks; of two blocks only those that hold different
components are brought together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, batches, components, counted, dense, distinct, forget, keep, lower_batches, mix, ngrams, slices, table

SKETCH = 22  # bits: 4M counters, 4 MB when sent to the tasks, whatever the corpus
BITS = 512
CELLS = 4096  # cells of a set, at most, beside each of its places in the lists that are compared again
LIST = 1024  # members of a block of a list
GROUP = 100_000  # members compared at once, one list block (or pair of blocks) at least
FINE = 4 << 20  # bytes of cells compared at once
GATHER = 50_000  # rows cut into blocks at once
PAIRS = 1_000_000  # pairs that a task holds before it sends them on


def shingles(column: pa.Array, n: int):
    """Of each slice of a column: (slice, tokens, document of each), tokens distinct and ascending within a document."""
    for s in slices(column):
        h, begin = s.hashes()
        yield s, *distinct(*ngrams(h, begin, n))


def sketch(docs: DataFrame, bits: int = SKETCH) -> np.ndarray:
    """Log2 of the number of documents of the words of each counter, from all documents."""

    def count(it):
        c = np.zeros(1 << bits, np.int32)
        for b in it:
            for _, token, _ in shingles(b["text"], 1):
                x, k = np.unique((token >> U(52 - bits)).astype(np.int64), return_counts=True)
                c[x] += k.astype(np.int32)
        return c

    lower_batches(docs.sparkSession)
    c = dense(counted(docs.select(F.col("text").cast("string").alias("text")), count, 1 << bits), 1 << bits)
    return np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.uint8) + 1, 0).astype(np.uint8)


def ordered(column: pa.Array, n: int, rarity: np.ndarray):
    """Like shingles, but tokens carry their rarity in the top 6 of 52 bits, so they are in rare-first order."""
    shift = U(52 - int(np.log2(len(rarity))))
    for s in slices(column):
        h, begin = s.hashes()
        one, _ = ngrams(h, begin, 1)
        log = np.append(0, np.cumsum(rarity[((one >> U(12)) >> shift).astype(np.int64)], dtype=np.int64))
        g, doc = ngrams(h, begin, n)
        count = np.diff(begin)
        many = np.bincount(doc, minlength=s.n)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + begin[doc]
        size = np.minimum(n, count[doc])
        kind = np.minimum((log[first + size] - log[first]) * 2 // np.maximum(size, 1), 63).astype(U)
        yield s, *distinct((kind << U(58)) | (g >> U(6)), doc)


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)


def cell_count(n: np.ndarray) -> np.ndarray:
    """Cells for a set of n tokens: the power of two at or above 2n, 64 at least."""
    return np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def sets(docs: DataFrame, n: int, num: int, den: int, rarity: np.ndarray) -> DataFrame:
    """(doc_id, n, s1, s2, bits, cells, prefix): size, set hash of 128 bits, parities of BITS cells and of about 2n, and the prefix rare-first."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(it):
        for b in it:
            ids = b["doc_id"]
            for s, token, doc in ordered(b["text"], n, shared.value):
                size = np.bincount(doc, minlength=s.n)
                begin = np.append(0, np.cumsum(size))
                m = mix(token)
                sums = [np.append(U(0), np.cumsum(x)) for x in (m, mix(m ^ U(0x9E3779B97F4A7C15)))]
                s1, s2 = ((x[begin[1:]] - x[begin[:-1]]).view(np.int64) for x in sums)
                cell = (m >> U(64 - int(np.log2(BITS)))).astype(np.int64)
                odd = np.bincount(doc * BITS + cell, minlength=s.n * BITS).reshape(s.n, BITS) & 1
                bits = np.packbits(odd.astype(np.uint8), axis=1)
                wide = cell_count(size)
                low = np.cumsum(wide) - wide
                own = np.bincount(np.repeat(low, size) + (m & U(0xFFFFFFFF)).astype(np.int64) % np.repeat(wide, size), minlength=int(wide.sum())) & 1
                blob = np.packbits(own.astype(np.uint8)).tobytes()
                k = prefix_size(size, num, den)
                at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[:-1], k)
                yield {"doc_id": ids[s.at.start : s.at.stop], "n": size, "s1": s1, "s2": s2, "bits": [x.tobytes() for x in bits], "cells": [blob[i // 8 : (i + j) // 8] for i, j in zip(low.tolist(), wide.tolist())], "prefix": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)).astype(np.int32)), pa.array(token[at].view(np.int64)))}

    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, s1 long, s2 long, bits binary, cells binary, prefix array<bigint>")


def folded(known: DataFrame) -> DataFrame:
    """(id, n, cells) of known (doc_id, n, cells), with CELLS cells at most."""

    def run(it):
        for b in it:
            cells = [np.frombuffer(x, np.uint8) for x in b["cells"].to_pylist()]
            yield {"id": b["doc_id"], "n": b["n"], "cells": [np.bitwise_xor.reduce(x.reshape(-1, min(len(x), CELLS // 8))).tobytes() for x in cells]}

    return batches(known.select("doc_id", "n", "cells"), run, "id long, n long, cells binary").distinct()


def apart_by(a: np.ndarray, b: np.ndarray, cells: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Differing cells of the pairs (a, b) of rows of cells, of which the first `width` bytes count. The larger set's are folded to the smaller's."""
    out = np.zeros(len(a), np.int64)
    least = np.minimum(width[a], width[b])
    for w in np.unique(least[least > 0]).tolist():
        at = np.flatnonzero(least == w)
        for k in range(0, len(at), max(1, FINE // cells.shape[1])):
            i = at[k : k + max(1, FINE // cells.shape[1])]
            # what is beyond a row's width is zero, so folding leaves narrow rows as they are
            x = cells[a[i]] ^ cells[b[i]]
            x = np.bitwise_xor.reduce(x.reshape(len(i), -1, w), axis=1)
            out[i] = np.bitwise_count(x).sum(1, dtype=np.int64)
    return out


def tokens_of(docs: DataFrame, n: int) -> DataFrame:
    """(id, tokens): the whole set of each document, as ascending uint64."""

    def run(it):
        for b in it:
            for s, token, doc in shingles(b["text"], n):
                begin = np.searchsorted(doc, np.arange(s.n + 1))
                data = token.tobytes()
                yield {"id": b["doc_id"][s.at.start : s.at.stop], "tokens": [data[8 * i : 8 * j] for i, j in zip(begin[:-1].tolist(), begin[1:].tolist())]}

    return batches(docs, run, "id long, tokens binary")


def blocks(rows: DataFrame, order: list[str], size: int, save) -> DataFrame:
    """rows with (blk, open): each token's rows, in the order of `order` (token first), in blocks of `size`.

    The rows are dealt by ranges of the whole order, so a hot token's rows lie
    in many tasks, and are counted there; what the tasks before have of it is
    added after, for tokens that may go on in another task alone. open: the
    token has more than one block. Tokens that one row alone has are left out.
    save: keeps a table.
    """
    from pyspark import TaskContext
    from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType
    from pyspark.sql.window import Window

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at_token = rows.columns.index(order[0])

    def gathered(it):
        held, count = [], 0
        for b in it:
            held.append(b)
            count += b.num_rows
            if count >= GATHER:
                yield held
                held, count = [], 0
        yield held

    def run(it):
        part = TaskContext.get().partitionId()
        waits, out, first, last = None, 0, None, None  # rows of the last token that may be its only ones; how many of it are out; the task's first token

        def cut(t, ended):
            nonlocal waits, out, first
            token = t.column(at_token).to_numpy(zero_copy_only=False)
            first = token[0] if first is None else first
            begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(begins, len(token)))
            before = np.zeros(len(begins), np.int64)
            before[0] = out
            total = before + length
            edge = (token[begins] == first) | (before > 0)
            hold = not ended and before[-1] == 0 and total[-1] <= size
            edge[-1] |= not hold  # it may go on in the next task
            go = edge | (total > 1)
            if hold:
                go[-1] = False
            row = np.repeat(go, length)
            at = np.arange(len(token)) - np.repeat(begins - before, length)
            kept = t.filter(pa.array(row)).combine_chunks()
            waits, out = (t.slice(int(begins[-1])), 0) if hold else (None, int(total[-1]))
            own = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in kept.columns]
            more = [pa.array(at[row], pa.int64()), pa.array(np.repeat(edge, length)[row], pa.bool_()), pa.array(np.repeat(total > size, length)[row], pa.bool_())]
            return pa.RecordBatch.from_arrays([*own, *more, pa.array(np.full(int(row.sum()), part, np.int32))], names=[*kept.column_names, "_at", "_edge", "_many", "_part"])

        for held in gathered(it):
            t = pa.Table.from_batches(held) if held else None
            if t is None or not t.num_rows:
                continue
            if waits is not None:
                t = pa.concat_tables([waits, t])
            elif t.column(at_token)[0].as_py() != last:
                out = 0
            last = t.column(at_token)[-1].as_py()
            yield cut(t, False)
        if waits is not None:
            yield cut(waits, True)

    lower_batches(rows.sparkSession)
    own = [StructField("_at", LongType()), StructField("_edge", BooleanType()), StructField("_many", BooleanType()), StructField("_part", IntegerType())]
    found = save(rows.mapInArrow(run, StructType([*rows.schema.fields, *own])))
    one = Window.partitionBy("token")
    ends = found.where("_edge").groupBy("token", "_part").agg(F.count("*").alias("_n"))
    ends = ends.select("token", "_part", (F.sum("_n").over(one.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(one).alias("_total"))
    found = found.join(ends, ["token", "_part"], "left").where("_total is null or _total > 1")
    at = ((F.coalesce("_before", F.lit(0)) + F.col("_at")) / size).cast("long").alias("blk")
    return found.select(*rows.columns, at, F.coalesce(F.col("_total") > size, "_many").alias("open"))


def tasks(members: DataFrame, num: int, den: int) -> DataFrame:
    """Members (with blk, open, label) with `sub` and `side`: one task for a list of one block, else one for each two blocks that hold different labels and lengths that can link."""
    one = members.where("not open").select("*", F.lit(0).cast("long").alias("sub"), F.lit(0).alias("side"))
    rest = members.where("open")
    ends = rest.groupBy("token", "blk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("from"), F.max("label").alias("to"))
    a, b = (ends.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("blk", "low", "high", "from", "to")]) for x in "ab")
    same = "a_from = a_to and a_from = b_from and a_from = b_to"
    two = a.join(b, "token").where(f"a_blk <= b_blk and a_high * {den} >= b_low * {num} and b_high * {den} >= a_low * {num} and not ({same})")
    two = two.select("token", "a_blk", "b_blk", F.xxhash64("a_blk", "b_blk").alias("sub"))
    left = rest.join(two, (rest.token == two.token) & (rest.blk == two.a_blk)).select(rest["*"], two["sub"], F.when(F.col("a_blk") == F.col("b_blk"), 0).otherwise(1).alias("side"))
    right = rest.join(two.where("a_blk < b_blk"), (rest.token == two.token) & (rest.blk == F.col("b_blk"))).select(rest["*"], "sub", F.lit(2).alias("side"))
    return one.unionByName(left).unionByName(right)


def partners(rows: DataFrame, num: int, den: int, step: str) -> DataFrame:
    """Compares the members of each task (token, sub) that differ in `label`: (kind, token, id, n, pos, bits, open, other).

    Kind 0 is a pair (id, other) that the filters leave. Step `first`: of a
    list that has no more such pairs than members all pairs; of any other, each
    member with the partner that has the most partners, and the members with
    a partner as rows of kind 1, to be compared again. Members of open lists
    always are of kind 1, and one of each block, the one with the most
    partners, of kind 2 too. Step `reps` takes these: like `first`, but only
    LIST neighbours by size are compared, and no member comes back. Step
    `near`: each member with its nearest partner. Step `all`: all pairs.
    Rows of these two have `cells` (of `folded`) too, a further filter.
    So all steps but `all` give no more rows than three times the members,
    and `all` gives pairs that their cells don't rule out, if CELLS is enough
    for their sizes.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = step in ("near", "all")
    names = ["token", "sub", "side", "id", "n", "pos", "bits", "label", "open", *(["cells"] if fine else [])]
    rows = rows.select(*names).repartition(parts, "token", "sub").sortWithinPartitions("token", "sub", "n", "id")

    def each(part, end, i):
        """(i, j, differing cells) of the surviving pairs whose first member is among i, a distance in the list at a time."""
        token, sub, side, own, n, pos, bits, label, _, cells, width = part
        d = 0
        while True:
            d += 1
            i = i[end[i] > i + d]
            if not len(i) or (step == "reps" and d > LIST):
                return
            i = i[n[i] * den >= n[i + d] * num]  # lists ascend in n: a length that fails stays out
            j = i + d
            ok = (label[i] != label[j]) & (own[i] != own[j]) & ((side[i] == 0) | (side[i] != side[j]))
            a, b = i[ok], j[ok]
            if not len(a):
                continue
            need = (num * (n[a] + n[b]) + num + den - 1) // (num + den)
            ok = np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need
            a, b, need = a[ok], b[ok], need[ok]
            differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
            ok = differ <= n[a] + n[b] - 2 * need
            if fine and ok.any():
                a, b, need, differ = a[ok], b[ok], need[ok], differ[ok]
                differ = np.maximum(differ, apart_by(a, b, cells, width))
                ok = differ <= n[a] + n[b] - 2 * need
            if ok.any():
                yield a[ok], b[ok], differ[ok]

    def out(kind, part, i, other=None):
        token, _, _, own, n, pos, bits, _, several, _, _ = part
        none = np.zeros(len(i), np.int64)
        if kind == 0:
            return {"kind": none.astype(np.int32), "token": none, "id": own[i], "n": none, "pos": none.astype(np.int32), "bits": [None] * len(i), "open": none.astype(bool), "other": own[other]}
        data = bits.view(np.uint8).reshape(len(bits), -1)[i]
        return {"kind": np.full(len(i), kind, np.int32), "token": token[i], "id": own[i], "n": n[i], "pos": pos[i].astype(np.int32), "bits": [x.tobytes() for x in data], "open": several[i], "other": none}

    def work(held):
        part = [np.concatenate(x) for x in zip(*held)]
        token, sub, _, own, _, _, _, _, several, _, _ = part
        k = len(token)
        at = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (sub[1:] != sub[:-1])))
        length = np.diff(np.append(at, k))
        end = np.repeat(at + length, length)
        where = np.repeat(np.arange(len(at)), length)
        ids, local = np.unique(own, return_inverse=True)
        spot = np.zeros(len(ids), np.int64)
        spot[local] = np.arange(k)
        done = np.zeros(0, np.int64)  # pairs that are out, as numbers

        def pairs(a, b):
            """Rows of the pairs that aren't out yet."""
            nonlocal done
            key = np.unique(np.minimum(local[a], local[b]) * len(ids) + np.maximum(local[a], local[b]))
            key = key[~np.isin(key, done, assume_unique=True)]
            done = key if step == "all" else np.union1d(done, key)
            if len(key):
                yield out(0, part, spot[key // len(ids)], spot[key % len(ids)])

        if step == "all":
            found, count = [], 0
            for a, b, _ in each(part, end, np.arange(k)):
                found.append((a, b))
                count += len(a)
                if count >= PAIRS:
                    yield from pairs(*map(np.concatenate, zip(*found)))
                    found, count = [], 0
            if found:
                yield from pairs(*map(np.concatenate, zip(*found)))
            return
        least, near = np.full(k, 1 << 30), np.full(k, -1)
        if step == "near":
            for i, j, differ in each(part, end, np.arange(k)):
                for x, y in ((i, j), (j, i)):  # each has one partner at this distance
                    up = differ < least[x]
                    least[x[up]], near[x[up]] = differ[up], y[up]
            i = np.flatnonzero(near >= 0)
            yield from pairs(i, near[i])
            return
        degree, many, found = np.zeros(k, np.int64), np.zeros(len(at), np.int64), []
        for a, b, _ in each(part, end, np.arange(k)):
            degree[a] += 1
            degree[b] += 1
            w = many[where[a]] <= length[where[a]]
            many += np.bincount(where[a], minlength=len(at))
            if w.any():
                found.append((a[w], b[w]))
        full = (many > length)[where]  # members of lists that have more pairs than members
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield from pairs(a[~full[a]], b[~full[a]])
        if full.any():
            # the partner with the most partners (the earlier of equal ones)
            rank = degree * k - np.arange(k)
            best, hub = np.full(k, np.iinfo(np.int64).min), np.full(k, -1)
            for i, j, _ in each(part, end, np.flatnonzero(full)):
                for x, y in ((i, j), (j, i)):
                    up = rank[y] > best[x]
                    best[x[up]], hub[x[up]] = rank[y[up]], y[up]
            i = np.flatnonzero(hub >= 0)
            yield from pairs(i, hub[i])
        if step == "reps":
            return
        i = np.flatnonzero(several | (full & (degree > 0)))
        if len(i):
            yield out(1, part, i)
        first = np.flatnonzero(several[at])
        if len(first):
            rank = degree * k - np.arange(k)
            yield out(2, part, np.array([at[x] + np.argmax(rank[at[x] : at[x] + length[x]]) for x in first]))

    def run(it):
        held, count, last = [], 0, None
        for b in it:
            if not b.num_rows:
                continue
            token, sub, side, own, n, pos, label, several = (b[x].to_numpy(zero_copy_only=False) for x in names if x not in ("bits", "cells"))
            bits = np.frombuffer(b"".join(b["bits"].to_pylist()), U).reshape(b.num_rows, -1)
            wide = b["cells"].to_pylist() if fine else []
            width = np.array([len(x) for x in wide] if fine else np.zeros(b.num_rows), np.int64)
            cells = np.frombuffer(b"".join(x.ljust(CELLS // 8, b"\0") for x in wide), np.uint8).reshape(b.num_rows, -1) if fine else np.zeros((b.num_rows, 0), np.uint8)
            part = (token, sub, side, own, n, pos.astype(np.int64), bits, label, several.astype(bool), cells, width)
            if count >= GROUP:
                differs = (token != last[0]) | (sub != last[1])
                cut = int(np.argmax(differs)) if differs.any() else len(token)
                held.append(tuple(x[:cut] for x in part))
                count += cut
                if cut < len(token):
                    yield from work(held)
                    part = tuple(x[cut:] for x in part)
                    held, count = [part], len(part[0])
            else:
                held.append(part)
                count += len(token)
            last = (token[-1], sub[-1])
        if held:
            yield from work(held)

    return batches(rows, run, "kind int, token long, id long, n long, pos int, bits binary, open boolean, other long")


def plausible(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their cells don't rule out. The larger set's cells are folded to the smaller's."""
    one = known.select(F.col("doc_id").alias("id"), F.struct("n", "cells").alias("x")).hint("merge")
    a, b = one.select(F.col("id").alias("a"), F.col("x").alias("_a")), one.select(F.col("id").alias("b"), F.col("x").alias("_b"))

    def run(it):
        for batch in it:
            go = []
            for x, y in zip(batch["_a"].to_pylist(), batch["_b"].to_pylist()):
                u, v = (np.frombuffer(z["cells"], np.uint8) for z in (x, y))
                while len(u) > len(v):
                    u = u[: len(u) // 2] ^ u[len(u) // 2 :]
                while len(v) > len(u):
                    v = v[: len(v) // 2] ^ v[len(v) // 2 :]
                n = x["n"] + y["n"]
                go.append(int(np.bitwise_count(u ^ v).sum(dtype=np.int64)) <= n - 2 * -(-num * n // (num + den)))
            keepers = pa.array(go, pa.bool_())
            yield {"a": batch["a"].filter(keepers), "b": batch["b"].filter(keepers)}

    return batches(pairs.join(b, "b").join(a, "a"), run, "a long, b long").distinct()


def verify(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    a, b = whole.select(F.col("id").alias("a"), F.col("tokens").alias("_a")), whole.select(F.col("id").alias("b"), F.col("tokens").alias("_b"))

    def run(it):
        for batch in it:
            go = []
            for x, y in zip(batch["_a"].to_pylist(), batch["_b"].to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                go.append(den * both >= num * (len(x) + len(y) - both))
            go = np.array(go, bool)
            yield {"a": batch["a"].filter(pa.array(go)), "b": batch["b"].filter(pa.array(go))}

    # merge joins at every size: the sets grow with the documents
    return batches(pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a"), run, "a long, b long").distinct()


def joined(labels: DataFrame, links: DataFrame, scratch: list[str]) -> DataFrame:
    """(node, component) after more links: they join components, so only the components they touch are searched."""
    of = lambda x: F.coalesce(F.col("component"), F.col(x)).alias(x)
    up = links.join(labels.withColumnRenamed("node", "a"), "a", "left").select(of("a"), "b")
    up = up.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", of("b"))
    more = components(up, scratch=scratch).select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(more, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = more.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    return old.unionByName(new)


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    Two documents link if den * |A & B| >= num * |A | B| for their sets of
    n-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; fewer words
    are one shingle). component_id: the smallest doc_id reachable over links,
    its own included. Documents without a word, or null, have no shingle and
    no link. Rows that repeat a doc_id are one node that has the links of all
    its texts. Null doc_ids: component null. Other columns don't matter. An
    empty table gives an empty one.

    Very long texts are one row of the batch; prefixes grow with them, not the
    cells. Sizes and overlaps are counted on 46 hash bits of a shingle and 6 of
    its words' rarity.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch: list[str] = []
    save = lambda df: keep(df, scratch=scratch)
    known = save(sets(slim, n, num, den, sketch(slim)))
    some = known.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "bits", "prefix"))
    classes = save(some.groupBy("n", "s1", "s2").agg(first.alias("x")).select("n", "s1", "s2", F.col("x.doc_id").alias("id"), "x.bits", "x.prefix"))
    members = blocks(classes.select("id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", "id", "pos"), ["token", "n", "id"], LIST, save)
    members = members.join(classes.select("id", "n", "bits").hint("merge"), ["id", "n"])
    found = save(partners(members.select("*", F.col("blk").alias("sub"), F.lit(0).alias("side"), F.col("id").alias("label")), num, den, "first"))
    held = found.where("kind = 1").select("token", "n", "id", "pos", "bits", "open")  # of the lists with many pairs

    def ends(df: DataFrame) -> DataFrame:
        return df.where("kind = 0").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()

    def apart(labels: DataFrame) -> DataFrame | None:
        """The held lists' members, of lists that lie in several components, in blocks; None without any."""
        rows = held.drop("open").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        mixed = rows.groupBy("token").agg(F.min("label").alias("from"), F.max("label").alias("to")).where("`from` < `to`").select("token")
        rows = save(blocks(rows.join(mixed, "token", "left_semi").select("token", "label", "n", "id", "pos", "bits"), ["token", "label", "n", "id"], LIST, save))
        return rows if rows.take(1) else None

    def compared(rows: DataFrame, step: str) -> DataFrame:
        """New pairs of members that lie in different components."""
        rows = tasks(rows, num, den).join(cells.hint("merge"), ["id", "n"])
        return ends(partners(rows, num, den, step)).join(tested, ["a", "b"], "left_anti")

    def fetched(pairs: DataFrame, merge: bool) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return save(tokens_of(slim.join(ids.hint("merge") if merge else ids, slim.doc_id == ids.id, "left_semi"), n))

    reps = found.where("kind = 2").select("*", F.lit(0).cast("long").alias("sub"), F.lit(0).alias("side"), F.col("id").alias("label"))
    tested = save(ends(found.select("kind", "id", "other").union(partners(reps, num, den, "reps").select("kind", "id", "other"))))
    pairs = save(plausible(tested, some, num, den))
    labels = save(components(pairs, scratch=scratch))
    many = bool(held.take(1))
    if many:  # of the members of held lists alone
        own = held.select(F.col("id").alias("doc_id")).distinct()
        known_long = save(some.select("doc_id", "n", "cells").join(own.hint("merge"), "doc_id", "left_semi"))
        cells = save(folded(known_long))
    rows = apart(labels) if many else None
    for step in ("near", "all") if rows is not None else ():
        new = save(compared(rows, step))
        tested = tested.union(new)
        new = save(plausible(new, known_long, num, den))
        pairs = pairs.union(new)
        if new.take(1):
            labels = save(joined(labels, new, scratch))
            rows = apart(labels)
            if rows is None:
                break
    # so far pairs that look like links joined components; now the links alone do
    links = save(verify(pairs, fetched(pairs, True), num, den))
    wrong = pairs.distinct().count() > links.count()
    if wrong:
        labels = save(components(links, scratch=scratch))
    if many and wrong and (rows := apart(labels)) is not None:
        # what a pair that is no link kept from being compared; few, so Spark may send the ids to the tasks
        new = save(plausible(compared(rows, "all"), known_long, num, den))
        if new.take(1):
            labels = save(joined(labels, verify(new, fetched(new, False), num, den), scratch))
    named = some.select("doc_id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "id"), ["n", "s1", "s2"])
    # a doc_id with several texts joins their classes
    double = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    if double.take(1):
        labels = save(joined(labels, named.join(double, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("id").alias("b")), scratch))
    named = named.join(labels, named.id == labels.node, "left").select("doc_id", F.coalesce("component", "id").alias("component_id"), named.n.alias("n"))
    alone = known.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("component_id"), "n")
    out = keep(named.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id"))
    for path in scratch:
        forget(docs.sparkSession, path)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: shingles of three words, 0.9."""
    return ngram_join(table(spark, sf_dir, "documents"), 3, 90, 100)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
both_sides AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_sides JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT doc_id, doc_id FROM sizes),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node
)
SELECT s.doc_id, s.n AS n_shingles, min(r.node) AS component_id FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY 1, 2
"""
