"""Repeated passages by sparse suffix arrays.

Of a text's suffixes only those at minimisers stay: for every window of
`least` words the suffix that begins at its smallest hashed seed of SEED words
(the leftmost if equal). So two equal windows keep the same suffix at the same
place, about one in 22. A suffix goes on with the words of its windows, those
to the right of its place and those to the left.

Suffixes whose seed stands nowhere else are known by a first count of the
seeds, and don't go on. The others are sorted by content, to the right and,
turned round, to the left; the words that neighbours of either order share say
how far each can be extended, and a window that two suffixes share on both
sides repeats. So matches are complete, from any of their starts.

A seed that stands in more than HOT places would bring all of these into one
task. Its suffixes are cut into their windows, which meet by the hash of all
their words; a task sends a window on only if it stands before the equal ones
that the task has met, so a passage in a third of all documents costs each
task a few rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, batches, bit_map, keep, lower_batches, mix, rolling, slices, table, windows

LEAST = 50
SEED = 8
NULL_ID = -(1 << 63)  # stands for a null doc_id on the way
GROUP = 60_000  # suffixes compared at once, one seed's at least
BITS = 26  # of the bit map of seeds that stand in several places: 8 MB, whatever the corpus
HOT = 50_000  # places of a seed from which its suffixes are cut into windows
SLOTS = 20  # bits of a task's table of suffixes met before
PLACE = 32  # bits of a word's place in a slice


def minimisers(h: np.ndarray, begin: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of a slice's words: for each kept suffix its place, its seed's hash, and the first and last start of the windows that keep it; prefix sums of the hashes."""
    sums = rolling(h)
    none = np.zeros(0, np.int64)
    if len(h) < least:
        return none, np.zeros(0, U), none, none, sums
    i = np.arange(len(h) - seed + 1)
    kmer = windows(sums, i, i + seed)
    key = (kmer >> U(PLACE) << U(PLACE)) | i.astype(U)  # the leftmost of equal seeds
    span, width = least - seed + 1, 1
    low = key
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(key) - span + 1], low[span - width : span - width + len(key) - span + 1])
    at = (low & U((1 << PLACE) - 1)).astype(np.int64)
    size = np.diff(begin)
    ok = np.zeros(len(at) + 1, np.int64)
    many = size >= least
    np.add.at(ok, begin[:-1][many], 1)
    np.add.at(ok, np.minimum(begin[1:][many] - least + 1, len(at)), -1)
    start = np.flatnonzero(np.cumsum(ok)[:-1])  # windows inside one document
    if not len(start):
        return none, np.zeros(0, U), none, none, sums
    p = at[start]
    new = np.append(True, (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return p[first], kmer[p[first]], start[first], start[last], sums


class Met:
    """Suffixes met before in a task, by a hash of their words, with the smallest (doc_id, start) so far. A slot that another one takes costs rows alone."""

    def __init__(self):
        self.key, self.doc, self.start = np.zeros(1 << SLOTS, U), np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int64)
        self.size, self.told = np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, bool)

    def sort_out(self, key: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of distinct suffixes of a slice: whether each stands before any equal one met, or was met later; and (doc, start, size) of the earlier ones that weren't told yet that they have copies."""
        at = (key >> U(64 - SLOTS)).astype(np.int64)
        same = self.key[at] == key
        later = same & ((doc > self.doc[at]) | ((doc == self.doc[at]) & (start >= self.start[at])))
        first = np.unique(at[later & ~self.told[at]])
        self.told[first] = True
        told = self.doc[first], self.start[first], self.size[first]
        new = ~later
        self.size[at[new]] = size[new]
        self.key[at[new]], self.doc[at[new]], self.start[at[new]], self.told[at[new]] = key[new], doc[new], start[new], same[new]
        return same & ~later, later, told


def first_of(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places with keys: whether an equal key stands earlier by (doc, start), and whether none does but one stands later."""
    order = np.lexsort((start, doc, key))
    again, copied = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    copied[order[:-1]] = again[order[1:]]
    return again, copied & ~again


def runs(doc: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, words) of windows, those that follow one another as one."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)) if len(doc) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(doc)) - 1 if len(a) else a
    return doc[a], start[a], start[z] - start[a] + least


def suffixes(docs: DataFrame, least: int, seed: int, maps: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Kept suffixes, and what is known without comparing them: (kind, seed, doc_id, start, lead, words, n).

    Kind 0: a suffix to compare. words: uint32 hashes of the words of its
    windows, the first of which begins at `start`, `lead` words before the
    suffix; n: 1 if it has copies in its task. Of suffixes that a task has with
    equal words only those go on that stand before the others by (doc_id,
    start). Kind 1: a document's number of words, n. Kinds 2 and 3: n words
    from `start` that stand elsewhere too; 2: earlier as well. Kind 4: a window
    to compare, `seed` is the hash of its words. maps: bit maps of the seeds
    that stand in several places, others are not compared, and of the hot
    ones; without them kind 0 is all there is, for counting: without words.
    """
    counting = maps is None
    shared = None if counting else docs.sparkSession.sparkContext.broadcast(maps)

    def run(it):
        met, met_windows = Met(), Met()
        for b in it:
            ids = np.array([NULL_ID if x is None else x for x in b["doc_id"].to_pylist()], np.int64)
            for s in slices(b["text"]):
                h, begin = s.hashes()
                p, code, first, last, sums = minimisers(h, begin, least, seed)
                doc = np.searchsorted(begin, p, "right") - 1
                own, start, lead = ids[s.at][doc], first - begin[doc], p - first
                whole = mix(windows(sums, first, last + least) ^ mix((lead << 8).astype(U) + (last - first).astype(U)))
                # of equal ones in the slice the first by (doc_id, start) alone is looked at further
                again, copied = first_of(whole, own, start)
                one = np.flatnonzero(~again)
                size = (last - first + least).astype(np.int32)
                earlier, later, told = met.sort_out(whole[one], own[one], start[one], size[one])
                go, gone = one[~later], np.concatenate([np.flatnonzero(again), one[later]])
                known = copied[go] | earlier[~later]
                if counting:
                    yield {"kind": np.zeros(len(go), np.int32), "seed": code[go].view(np.int64), "doc_id": own[go], "start": start[go].astype(np.int32), "lead": lead[go].astype(np.int32), "words": [None] * len(go), "n": known.astype(np.int32)}
                    continue
                at = (code[go] >> U(64 - BITS)).astype(np.int64)
                hit, hot = ((m[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) for m in shared.value)
                alone = go[~hit & known]
                cut, cut_known = go[hit & hot], known[hit & hot]
                go, known = go[hit & ~hot], known[hit & ~hot]
                # windows of hot seeds: like suffixes, each for itself
                many = last[cut] - first[cut] + 1
                i = np.repeat(np.arange(len(cut)), many)
                w = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[cut][i]
                w_key, w_own, w_start = windows(sums, w, w + least), own[cut][i], w - begin[doc[cut][i]]
                w_again, w_copied = first_of(w_key, w_own, w_start)
                w_one = np.flatnonzero(~w_again)
                w_earlier, w_later, w_told = met_windows.sort_out(w_key[w_one], w_own[w_one], w_start[w_one], np.full(len(w_one), least))
                w_go, w_gone = w_one[~w_later], np.concatenate([np.flatnonzero(w_again), w_one[w_later]])
                w_known = w_copied[w_go] | w_earlier[~w_later] | cut_known[i[w_go]]
                found = [  # kind, doc_id, start, n
                    (0, own[go], start[go], known), (4, w_own[w_go], w_start[w_go], w_known), (1, ids[s.at], np.zeros(s.n, np.int64), np.diff(begin)), (2, own[gone], start[gone], size[gone]), (2, *runs(w_own[w_gone], w_start[w_gone], least)),
                    (3, own[alone], start[alone], size[alone]), (3, *told), (3, *w_told),
                ]
                doc_id, start_of, more = (np.concatenate([x[k] for x in found]) for k in (1, 2, 3))
                spread = mix(doc_id.astype(U) + start_of.astype(U)).view(np.int64)
                word = ((h >> U(32)) | U(1)).astype(np.uint32).tobytes()
                rest = len(doc_id) - len(go)
                yield {
                    "kind": np.repeat(np.array([x[0] for x in found], np.int32), [len(x[1]) for x in found]), "seed": np.concatenate([code[go].view(np.int64), w_key[w_go].view(np.int64), spread[len(go) + len(w_go) :]]),
                    "doc_id": doc_id, "start": start_of.astype(np.int32), "lead": np.concatenate([lead[go], np.zeros(rest, np.int64)]).astype(np.int32),
                    "words": [*[word[4 * i : 4 * j] for i, j in zip(first[go].tolist(), (last[go] + least).tolist())], *[None] * rest], "n": more.astype(np.int32),
                }

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "kind int, seed long, doc_id long, start int, lead int, words binary, n int")


def _shared(rows: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order by seed and content, and how many words each shares with the one before it in that order (-1: of another seed)."""
    width = rows.shape[1]
    text = np.empty((len(rows), width + 2), ">u4")
    text[:, 0], text[:, 1], text[:, 2:] = seed >> U(32), seed & U(0xFFFFFFFF), rows
    order = np.argsort(np.ascontiguousarray(text).view(f"S{4 * (width + 2)}").ravel(), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common[seed[order[1:]] != seed[order[:-1]]] = -1
    return order, np.append(-1, common)


def compare(sorted_rows: DataFrame, least: int, seed: int) -> DataFrame:
    """(doc_id, words, start, end, removable): spans of repeated words, and a row with each document's number of words.

    Rows must come sorted by seed within partitions; whole seeds are compared
    at a time, a group of at least GROUP suffixes.
    """
    left_most = least - seed  # words to the left of a suffix, at most

    def spans(doc, start, flag):
        """Runs of flagged windows (rows by windows, from start on) as spans of words."""
        row, at = np.nonzero(flag)
        if not len(row):
            return [np.zeros(0, np.int64)] * 3
        new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))
        a, z = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(row)) - 1
        return [doc[row[a]], start[row[a]] + at[a], at[z] - at[a] + least]

    def work(held):
        code, doc, start, lead, known, kind = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2, 3, 4, 6))
        words = [y for x in held for y in x[5]]
        # windows by the hash of all their words
        one = np.flatnonzero(kind == 4)
        again, copied = first_of(code[one], doc[one], start[one])
        out = [runs(doc[i], start[i], least) for i in (one[again | copied | known[one]], one[again])]
        i = np.flatnonzero(kind == 0)
        if len(i):
            out = [tuple(map(np.concatenate, zip(*x))) for x in zip(out, neighbours(*(x[i] for x in (code, doc, start, lead, known)), [words[j] for j in i]))]
        doc, a, n = (np.concatenate([x[i] for x in out]) for i in range(3))
        return {"doc_id": doc, "words": np.zeros(len(doc), np.int32), "start": a.astype(np.int32), "end": (a + n).astype(np.int32), "removable": np.arange(len(doc)) >= len(out[0][0])}

    def neighbours(code, doc, start, lead, known, words):
        """Spans (doc, start, words) that repeat, and that are removable, of suffixes."""
        by = np.lexsort((start + lead, doc))
        code, doc, start, lead, known = (x[by] for x in (code.view(U), doc, start, lead, known))
        size = np.array([len(words[i]) >> 2 for i in by])
        flat = np.frombuffer(b"".join(words[i] for i in by), np.uint32)
        row = np.repeat(np.arange(len(by)), size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) - lead[row]
        right, left = np.zeros((len(by), least), np.uint32), np.zeros((len(by), left_most), np.uint32)
        right[row[at >= 0], at[at >= 0]] = flat[at >= 0]
        left[row[at < 0], -1 - at[at < 0]] = flat[at < 0]
        (to_right, common_right), (to_left, common_left) = _shared(right, code), _shared(left, code)
        count = size - least + 1  # windows
        repeated, removable = np.zeros((len(by), left_most + 1), bool), np.zeros((len(by), left_most + 1), bool)
        for k in range(left_most + 1):  # windows that begin k words before the suffix
            have = np.flatnonzero((lead >= k) & (lead - k < count))
            if not len(have):
                continue
            # suffixes that share what the window has of them: neighbours that share so many words, on either side
            classes = np.empty((2, len(by)), np.int64)
            classes[0, to_right] = np.cumsum(common_right < least - k)
            classes[1, to_left] = np.cumsum(common_left < k)
            key = classes[0, have] * (len(by) + 1) + classes[1, have]
            order = np.argsort(key, kind="stable")  # rows are in the order of (doc_id, place)
            key, own = key[order], have[order]
            same = np.append(False, key[1:] == key[:-1])
            first = own[np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))]
            many = same.copy()
            many[:-1] |= same[1:]
            place = start + lead
            repeated[own, lead[own] - k] = many
            removable[own, lead[own] - k] = (doc[own] != doc[first]) | (place[own] != place[first])
        repeated |= known[:, None] & (np.arange(left_most + 1) < count[:, None])
        return [spans(doc, start, repeated), spans(doc, start, removable)]

    def run(it):
        held, count, tail = [], 0, None
        for b in it:
            kind, code, doc, start, lead, n = (b[x].to_numpy(zero_copy_only=False) for x in ("kind", "seed", "doc_id", "start", "lead", "n"))
            i = np.flatnonzero(kind == 1)
            yield {"doc_id": doc[i], "words": n[i], "start": np.zeros(len(i), np.int32), "end": np.zeros(len(i), np.int32), "removable": np.zeros(len(i), bool)}
            for flag, some in ((False, (kind == 2) | (kind == 3)), (True, kind == 2)):
                i = np.flatnonzero(some)
                yield {"doc_id": doc[i], "words": np.zeros(len(i), np.int32), "start": start[i], "end": start[i] + n[i], "removable": np.full(len(i), flag)}
            i = np.flatnonzero((kind == 0) | (kind == 4))
            if not len(i):
                continue
            words = b["words"].to_pylist()
            part = (code[i], doc[i], start[i].astype(np.int64), lead[i].astype(np.int64), n[i].astype(bool), [words[j] for j in i], kind[i])
            if count >= GROUP:
                end = int(np.argmax(part[0] != tail)) if (part[0] != tail).any() else len(i)
                held.append(tuple(x[:end] for x in part))
                count += end
                if end < len(i):
                    yield work(held)
                    part, held, count = tuple(x[end:] for x in part), [], 0
                    held.append(part)
                    count = len(part[0])
            else:
                held.append(part)
                count += len(i)
            tail = code[i[-1]]
        if held:
            yield work(held)

    return batches(sorted_rows, run, "doc_id long, words int, start int, end int, removable boolean")


_MERGE = """aggregate(array_sort(filter({0}, x -> x is not null)), cast(array() as array<struct<start:int,end:int>>),
    (a, x) -> if(size(a) > 0 and element_at(a, -1).end >= x.start,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
        concat(a, array(named_struct('start', x.start, 'end', x.end)))))"""


def repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, repeated, removable) of each doc_id of docs (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. repeated: array of
    (start, end) over the words that lie in a passage of `least` words or more
    that stands elsewhere too, in this or another document. removable: those
    of them where the passage has an earlier place by (doc_id, start). Null
    and short texts have none; a very long text is a slice of its own. Rows
    that repeat a doc_id are one document (the longest counts for n_words);
    null doc_ids are one document. Other columns don't matter. An empty table
    gives an empty one.
    """
    lower_batches(docs.sparkSession)
    seeds = keep(suffixes(docs, least, seed, None).groupBy("seed").count().where("count > 1").select(F.shiftrightunsigned("seed", 64 - BITS).alias("at"), "count"))
    rows = suffixes(docs, least, seed, (bit_map(seeds, BITS), bit_map(seeds.where(F.col("count") > HOT), BITS)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = compare(rows.repartition(parts, "seed").sortWithinPartitions("seed"), least, seed)
    span = F.struct("start", "end")
    out = found.groupBy("doc_id").agg(
        F.max("words").cast("long").alias("n_words"),
        F.collect_set(F.when((F.col("end") > 0) & ~F.col("removable"), span)).alias("_a"),
        F.collect_set(F.when((F.col("end") > 0) & F.col("removable"), span)).alias("_b"),
    )
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words", F.expr(_MERGE.format("_a")).alias("repeated"), F.expr(_MERGE.format("_b")).alias("removable"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every passage of 50 words or more that repeats, in all documents."""
    n = lambda c: F.expr(f"aggregate({c}, 0L, (a, x) -> a + x.end - x.start)")
    text = F.expr("array_join(transform(repeated, x -> concat(x.start, ':', x.end)), ',')")
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", n("repeated").alias("repeated_words"), n("removable").alias("removable_words"), text.alias("spans"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), places AS (SELECT doc_id, w, unnest(range(CAST(len(w) AS BIGINT) - 49)) AS i FROM words WHERE len(w) >= 50),
keyed AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS k FROM places),
same AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM keyed),
hits AS (SELECT doc_id, i, 'a' AS kind FROM same WHERE n > 1 UNION ALL SELECT doc_id, i, 'b' FROM same WHERE r > 1),
begun AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM begun),
spans AS (SELECT doc_id, kind, min(i) AS a, max(i) + 50 AS z FROM runs GROUP BY doc_id, kind, run),
sums AS (SELECT doc_id, sum(z - a) FILTER (kind = 'a') AS x, sum(z - a) FILTER (kind = 'b') AS y, string_agg(a || ':' || z, ',' ORDER BY a) FILTER (kind = 'a') AS s FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(x, 0) AS BIGINT) AS repeated_words, CAST(coalesce(y, 0) AS BIGINT) AS removable_words, coalesce(s, '') AS spans FROM words LEFT JOIN sums USING (doc_id)
"""
