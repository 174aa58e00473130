"""Language ID: scripts narrow the candidates, Viterbi over word scores with a switching penalty labels spans.

Words are runs of letters. A word's score in a language is the log likelihood
of its letter trigrams, edges included, from counts of all training texts. A
language is a candidate for a word if its training texts hold the script of
the word's letters. A document is labelled word by word on the best path,
where each change of language costs `penalty`; the language with the most
letters on the path is the document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, batches, counted, dense, mix, slices, table

BUCKETS = 1 << 16
PENALTY = 14.0
#: Words gathered before a Viterbi pass, one document at least.
GATHER = 1_000_000
#: First code points of script ranges, ascending, and the script that begins there.
SCRIPTS = ((0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"))
NAMES = sorted({x for _, x in SCRIPTS})
_STARTS = np.array([x for x, _ in SCRIPTS])
_KINDS = np.array([NAMES.index(x) for _, x in SCRIPTS], np.uint8)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x33480)), bool, 0x33480))
    return _letters[0]


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and where each document's begin."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
    x = b[lead]
    two, three, four = lead[x >= 0xC0], lead[x >= 0xE0], lead[x >= 0xF0]
    x[b[lead] >= 0xC0] = ((b[two] & 0x1F) << 6) | (b[two + 1] & 0x3F)
    x[b[lead] >= 0xE0] = ((b[three] & 0x0F) << 12) | ((b[three + 1] & 0x3F) << 6) | (b[three + 2] & 0x3F)
    x[b[lead] >= 0xF0] = ((b[four] & 0x07) << 18) | ((b[four + 1] & 0x3F) << 12) | ((b[four + 2] & 0x3F) << 6) | (b[four + 3] & 0x3F)
    return x, np.searchsorted(lead, offs)


def features(s) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of lower-cased texts: trigram buckets, the script of each, where each word's begin, where each document's words begin.

    A word of n letters has n + 1 trigrams: every one that ends in a letter,
    and the one that ends at its end.
    """
    cp, begin = code_points(s.buf, s.offs)
    ok = letters()[np.minimum(cp, 0x3347F)]
    edge = np.zeros(len(cp) + 1, bool)
    edge[begin] = True
    first, last = ok & edge[:-1], ok & edge[1:]
    first[1:] |= ok[1:] & ~ok[:-1]
    last[:-1] |= ok[:-1] & ~ok[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start + 1
    at = np.cumsum(size) - size
    n = int(size.sum())
    seq = np.zeros(n, np.int64)  # letters of a word, then a 0
    inner = np.ones(n, bool)
    inner[at + size - 1] = False
    seq[inner] = cp[ok]
    one, two = np.zeros_like(seq), np.zeros_like(seq)
    one[1:], two[2:] = seq[:-1], seq[:-2]
    one[at] = 0
    two[at] = 0
    two[np.minimum(at + 1, n - 1)] = 0  # a word of one letter has its end there, with nothing two before
    key = mix((seq + (one << 21) + (two << 42)).astype(U)) >> U(48)
    script = _KINDS[np.searchsorted(_STARTS, seq, "right") - 1]
    script[~inner] = 255
    return key.astype(np.int64), script, at, np.searchsorted(start, begin)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


class Model:
    """Languages, log likelihoods (buckets, languages), and whether a language is a candidate in a script (scripts, languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray, least: float = 0.001):
        n = len(langs)
        self.langs = langs
        grams = counts[: n * BUCKETS].reshape(n, BUCKETS).astype(np.float64)
        scripts = counts[n * BUCKETS :].reshape(n, len(NAMES)).astype(np.float64)
        self.table = np.ascontiguousarray(np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32))
        self.allowed = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= least).T


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from every row with text and language. Languages: the distinct values, by code point."""
    docs = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())
    n, index = len(langs), {x: i for i, x in enumerate(langs)}

    def count(it):
        c = np.zeros(n * (BUCKETS + len(NAMES)), np.int64)
        for b in it:
            own = np.array([index[x] for x in b["lang"].to_pylist()])
            for s in slices(lowered(b["text"]), None):
                key, script, at, begin = features(s)
                if not len(at):
                    continue
                per = np.repeat(np.repeat(own[s.at], np.diff(begin)), np.diff(np.append(at, len(key))))
                c[: n * BUCKETS] += np.bincount(per * BUCKETS + key, minlength=n * BUCKETS)
                real = script < 255
                c[n * BUCKETS :] += np.bincount(per[real] * len(NAMES) + script[real], minlength=n * len(NAMES))
        return c

    if not n:
        return Model([], np.zeros(0, np.int64))
    width = n * (BUCKETS + len(NAMES))
    from .common import lower_batches

    lower_batches(docs.sparkSession)
    return Model(langs, dense(counted(docs, count, width), width))


def viterbi(scores: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word. scores (words, languages); begin: where each document's words begin.

    All documents step together, word by word. Ties: staying before changing,
    then the first language.
    """
    n, k = scores.shape
    path = np.zeros(n, np.uint8 if k < 256 else np.int32)
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], begin[:-1][order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # documents with more than t words
    change, top = np.zeros((n, k), bool), np.zeros(n, path.dtype)
    best = np.zeros((len(size), k), np.float32)
    for t, m in enumerate(active):
        i = first[:m] + t
        if t == 0:
            best[:m] = scores[i]
            continue
        x = best[:m]
        a = x.argmax(1)
        other = x[np.arange(m), a][:, None] - np.float32(penalty)
        change[i] = other > x
        top[i] = a
        best[:m] = np.maximum(x, other) + scores[i]
        best[:m] -= best[:m].max(1, keepdims=True)  # keeps long texts in range
    state = np.zeros(len(size), np.int64)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        begins = active[t + 1] if t + 1 < len(active) else 0
        state[begins:m] = best[begins:m].argmax(1)
        i = first[:m] + t
        path[i] = state[:m]
        if t:
            state[:m] = np.where(change[i, state[:m]], top[i], state[:m])
    return path


def label(docs: DataFrame, model: Model, penalty: float = PENALTY, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and spans to the rows of docs, same-named columns replaced.

    score: the share of letters that the path gives to lang_pred, 0 to 1.
    spans: array of (lang, start, end) over the words (runs of letters), in
    order. Null text, no letter or a model without languages: `und`, 0 and no
    spans. Ties go to the first language by code point.
    """
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType
    from .common import lower_batches

    base = docs.drop("lang_pred", "score", "spans")
    span = StructType([StructField("lang", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    out = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, a fixed number for each language
    lower_batches(docs.sparkSession)

    def work(held):
        """held: batches, and of their slices scores, letters of words, words of documents."""
        m = shared.value
        k = max(1, len(m.langs))
        sizes = np.concatenate([x for _, parts in held for x in (p[2] for p in parts)]) if held else np.zeros(0, int)
        scores = np.concatenate([p[0] for _, parts in held for p in parts])
        weight = np.concatenate([p[1] for _, parts in held for p in parts])
        begin = np.append(0, np.cumsum(sizes))
        path = viterbi(scores, begin, penalty).astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        per = np.bincount(doc * k + path, weights=weight, minlength=len(sizes) * k).reshape(-1, k)
        win, total = per.argmax(1), per.sum(1)
        score = np.where(total > 0, per.max(1) / np.maximum(total, 1), 0.0)
        new = np.append(True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])) if len(path) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(path))
        cuts = np.searchsorted(at, begin)
        names = pa.array(m.langs, pa.string())
        spans = pa.StructArray.from_arrays([names.take(pa.array(path[at])), pa.array((at - begin[doc[at]]).astype(np.int32)), pa.array((stop - begin[doc[at]]).astype(np.int32))], ["lang", "start", "end"]) if len(at) else pa.array([], pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        i = 0
        for b, _ in held:
            j = i + b.num_rows
            langs = [m.langs[w] if t > 0 else "und" for w, t in zip(win[i:j], total[i:j])]
            own = pa.ListArray.from_arrays(pa.array((cuts[i : j + 1] - cuts[i]).astype(np.int32)), spans.slice(cuts[i], cuts[j] - cuts[i]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score[i:j]), own], names=[*b.schema.names, "lang_pred", "score", "spans"])
            i = j

    def run(it):
        m = shared.value
        held, words = [], 0
        for b in it:
            parts = []
            for s in slices(lowered(b[text]), None, 1_000_000):
                key, script, at, begin = features(s)
                k = len(m.langs)
                if not k or not len(at):
                    parts.append((np.zeros((0, max(1, k)), np.float32), np.zeros(0, np.int64), np.zeros(s.n, np.int64)))
                    continue
                score = np.add.reduceat(m.table[key], at, axis=0)
                kind = script[at]  # of a word's first letter
                fits = m.allowed[kind]
                fits |= ~fits.any(1, keepdims=True)
                score[~fits] -= 1000
                parts.append((score, np.diff(np.append(at, len(key))) - 1, np.diff(begin)))
                words += len(at)
            held.append((b, parts))
            if words >= GATHER:
                yield from work(held)
                held, words = [], 0
        if held:
            yield from work(held)

    return base.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: learns from the documents that aren't held out and labels every whole text."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = fit(docs.where("coalesce(not held_out, true)").select("text", "lang"))
    out = label(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
