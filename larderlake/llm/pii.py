"""PII by information-theoretic sanitisation, in DataFrame functions alone.

Patterns find the protected entities: email, ip, card and phone. The terms
near an entity are then weighed by what the whole corpus says: with n(t) the
documents that hold a term, n(e) the distinct contexts of an entity, n(e, t)
those that hold the term, and N all documents,

    PMI(e; t) = log(n(e, t) * N / (n(e) * n(t)))    IC(e) = log(N / n(e))

A term discloses an entity if PMI / IC reaches `disclosure` and n(e, t)
reaches `support`. Such a term is generalised to its first letters where
words of those letters no longer reach the threshold, else removed.

That is what `detect` reports, as its SQL does. `sanitise` counts n(e) and
n(e, t) in documents too, as n(t) and N are, and judges rare entities: below
`support` a term must stand in every document of the entity, and chance must
put no more than CHANCE documents with both into the corpus. It weighs the
terms of the whole sentence or line of an entity and those within REACH, cut
ones included, and generalises a term that discloses wherever it stands, in
every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

#: Java forms of the base patterns: the same matches; possessive, so that no text makes them backtrack or recurse, and begun only where a run begins.
_RUN = r"(?:(?<![%s])|\G)"
PATTERNS = {
    "email": _RUN % r"A-Za-z0-9._%+-" + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN % "0-9" + r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these can't match; looked for before the pattern runs.
CHEAP = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = tuple(PATTERNS)
TERM = r"\p{L}{3,}+"
REACH = 48  # characters of context on each side
DISCLOSURE, SUPPORT, STEM = 0.9, 3, 2
CHANCE = 0.05  # documents with both that independence would give, n(e) * n(t) / N, at most, for terms below the support
#: SQL: the terms of column `text`, lower-cased.
WORDS = f"transform(regexp_extract_all(text, '{TERM.replace(chr(92), chr(92) * 2)}', 0), w -> lower(w))"
PIECE = 256  # matches that are gathered before they join the array of a text's matches
MARKS = {x: f"[{x.upper()}]" for x in KINDS} | {"term": "[TERM]"}


def _fold(text: str, pattern: str, kind: str, holds: str, value: str) -> str:
    """SQL: array<struct<{kind}>> of the matches of a pattern that hold, with `s` and `e` as their ends in code points.

    The array grows in pieces of PIECE, so a text with many matches isn't
    copied anew for each of them.
    """
    one = f"named_struct('s', a.at + length(x['1']), 'e', a.at + length(x['1']) + length(x['0']), 'v', x['0'])"
    return f"""transform(aggregate(
        arrays_zip(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1)),
        named_struct('at', 0, 'some', cast(array() as array<struct<s:int,e:int,v:string>>), 'out', cast(array() as array<array<struct<s:int,e:int,v:string>>>)),
        (a, x) -> if(x['0'] is null, a, named_struct(
            'at', a.at + length(x['1']) + length(x['0']),
            'some', if({holds}, if(size(a.some) >= {PIECE}, array({one}), array_append(a.some, {one})), a.some),
            'out', if({holds} and size(a.some) >= {PIECE}, array_append(a.out, a.some), a.out))),
        a -> flatten(array_append(a.out, a.some))), x -> cast({value} as struct<{kind}>))"""


def find_all(text: str, pattern: str, cheap: str | None = None) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches in column `text`, in code points, end exclusive."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    kind = "start:int,end:int,value:string"
    found = _fold(text, p, kind, "true", "named_struct('start', x.s, 'end', x.e, 'value', x.v)")
    first = f"contains({text}, '{cheap}') and " if cheap else ""
    return F.expr(f"if({first}{text} rlike {p}, {found}, cast(array() as array<struct<{kind}>>))")


def _holds(kind: str) -> str:
    """The condition on a match, in SQL over x.value."""
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
        "card": f"length({digits}) between 13 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, spans): spans array<struct<kind, start, end, value>> by kind as listed, then start. Null text: empty."""
    out = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", find_all("text", PATTERNS[kind], CHEAP[kind]))
    parts = [f"transform(filter(_{k}, x -> {_holds(k)}), x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end, 'value', x.value))" for k in KINDS]
    return out.select("doc_id", "text", F.xxhash64("text").alias("key"), F.expr(f"concat({', '.join(parts)})").alias("spans"))


#: SQL: what stands for an entity in the counts, of a span s.
ENTITY = "if(s.kind = 'email', lower(s.value), regexp_replace(s.value, '[^0-9.]', ''))"


def clipped(found: DataFrame) -> DataFrame:
    """found with `near` instead of the text: for each span its entity and the REACH characters on both sides."""
    l0 = f"greatest(0, s.start - {REACH})"
    near = F.expr(f"transform(spans, s -> named_struct('kind', s.kind, 'entity', {ENTITY}, 'l0', {l0}, 'r0', s.end, 'l', substring(text, {l0} + 1, s.start - {l0}), 'r', substring(text, s.end + 1, {REACH})))")
    return found.select("doc_id", "key", "spans", near.alias("near"))


def contexts(found: DataFrame) -> DataFrame:
    """(doc_id, key, kind, entity, context, term, start, end): every term in `near`. Cut words don't count."""
    one = found.select("doc_id", "key", F.explode("near").alias("s")).select("doc_id", "key", "s.*")
    one = one.withColumn("context", F.xxhash64("l", "r")).withColumn("_l", find_all("l", TERM)).withColumn("_r", find_all("r", TERM))
    sides = F.expr(f"concat(transform(filter(_l, x -> x.start > 0 or l0 = 0), x -> named_struct('term', lower(x.value), 'start', l0 + x.start, 'end', l0 + x.end)), transform(filter(_r, x -> x.end < {REACH}), x -> named_struct('term', lower(x.value), 'start', r0 + x.start, 'end', r0 + x.end)))")
    return one.select("doc_id", "key", "kind", "entity", "context", F.explode(sides).alias("t")).select("doc_id", "key", "kind", "entity", "context", "t.*")


def occurrences(texts: DataFrame, words: str, stem: int) -> tuple[DataFrame, DataFrame]:
    """(term, nt) and (stem, ns): documents that hold a term, and a word of a stem. words: SQL of a text's terms.

    One pass over the texts for both. They are counted before anything joins
    them: a task sends a row a word at most, however frequent it is.
    """
    both = F.expr(f"concat(transform(array_distinct(_w), w -> named_struct('x', w, 'whole', true)), transform(array_distinct(transform(_w, w -> substring(w, 1, {stem}))), w -> named_struct('x', w, 'whole', false)))")
    counts = keep(texts.select(F.expr(words).alias("_w")).select(F.explode(both).alias("t")).groupBy("t.x", "t.whole").agg(F.count("*").alias("n")))
    return counts.where("whole").select(F.col("x").alias("term"), F.col("n").alias("nt")), counts.where("not whole").select(F.col("x").alias("stem"), F.col("n").alias("ns"))


def disclosing(texts: DataFrame, total: int, near: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, stem: int = STEM) -> DataFrame:
    """(kind, entity, term, generalised): the terms that disclose an entity; generalised null where they must go.

    Counts cover all of the `total` rows of texts (text).
    """
    e = near.groupBy("kind", "entity").agg(F.countDistinct("context").alias("ne"))
    et = near.groupBy("kind", "entity", "term").agg(F.countDistinct("context").alias("net")).where(F.col("net") >= support)
    strength = lambda both, n: F.log(F.col(both) * F.lit(float(total)) / (F.col("ne") * F.col(n))) / F.log(F.lit(float(total)) / F.col("ne"))
    # n(t) is at least the documents that hold t near an entity: terms that fail by that count fail by the whole one
    least = near.groupBy("term").agg(F.greatest(F.lit(1), F.countDistinct("doc_id", "key")).alias("least"))
    et = et.join(e, ["kind", "entity"]).join(least, "term").where(F.col("ne") < total).where(strength("net", "least") >= disclosure)
    et = keep(et.drop("least"))
    nt, ns = occurrences(texts, f"regexp_extract_all(lower(text), '{TERM.replace(chr(92), chr(92) * 2)}', 0)", stem)
    out = keep(et.join(nt, "term")).withColumn("_d", strength("net", "nt")).where(F.col("_d") >= disclosure)
    out = out.withColumn("stem", F.substring("term", 1, stem)).join(ns, "stem").withColumn("_g", strength("net", "ns"))
    return out.select("kind", "entity", "term", F.when(F.col("_g") < disclosure, F.concat("stem", F.lit("*"))).alias("generalised"))


def disclosing_rows(found: DataFrame, near: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, stem: int = STEM) -> DataFrame:
    """disclosing() with all four counts in rows of `found` (text). near: (row, kind, entity, term), distinct."""
    e = near.select("row", "kind", "entity").distinct().groupBy("kind", "entity").agg(F.count("*").alias("ne"))
    et = near.groupBy("kind", "entity", "term").agg(F.count("*").alias("net"))
    total = float(found.count())
    strength = lambda n: F.log(F.col("net") * F.lit(total) / (F.col("ne") * F.col(n))) / F.log(F.lit(total) / F.col("ne"))
    nt, ns = occurrences(found, WORDS, stem)
    out = et.join(e, ["kind", "entity"]).where(F.col("ne") < total).join(nt, "term").where(strength("nt") >= disclosure)
    rare = (F.col("net") == F.col("ne")) & (F.col("ne") * F.col("nt") <= CHANCE * total)
    out = keep(out.where((F.col("net") >= support) | rare)).withColumn("stem", F.substring("term", 1, stem)).join(ns, "stem")
    return out.select("kind", "entity", "term", F.when(strength("ns") < disclosure, F.concat("stem", F.lit("*"))).alias("generalised"))


def all_spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """The table of base_spans without the text, and (doc_id, key, terms): terms array<struct<start, end, generalised>> by start."""
    slim = keep(clipped(base_spans(docs)))
    near = keep(contexts(slim))
    out = disclosing(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), slim.count(), near, disclosure, support)
    hit = near.join(out, ["kind", "entity", "term"]).groupBy("doc_id", "key", "start", "end").agg(F.min(F.coalesce("generalised", F.lit(""))).alias("g"))
    terms = hit.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.nullif("g", F.lit("")).alias("generalised")))).alias("terms"))
    return slim, terms


def sentences(found: DataFrame) -> DataFrame:
    """found with `near` instead of the text: for each span its entity and the sentence or line it stands in, REACH characters on both sides at least; words cut by either edge are whole."""
    ends = r"(?<=[.!?。！？])\\s+|(?<=[。！？])|\\n"
    left = f"greatest(length(element_at(split(x.l, '{ends}', -1), -1)), length(regexp_extract(substring(x.l, 1, greatest(0, length(x.l) - {REACH})), '(?<!\\\\p{{L}})\\\\p{{L}}*+$', 0)) + {REACH})"
    right = f"greatest(length(element_at(split(x.r, '{ends}', 2), 1)), {REACH} + length(regexp_extract(substring(x.r, {REACH + 1}), '^\\\\p{{L}}*+', 0)))"
    whole = f"concat(substring(x.l, greatest(1, length(x.l) - {left} + 1)), ' ', substring(x.r, 1, {right}))"
    sides = f"transform(spans, s -> named_struct('kind', s.kind, 'entity', {ENTITY}, 'l', substring(text, 1, s.start), 'r', substring(text, s.end + 1)))"
    return found.select("doc_id", "key", "spans", F.expr(f"transform({sides}, x -> named_struct('kind', x.kind, 'entity', x.entity, 'text', {whole}))").alias("near"))


def neighbours(found: DataFrame) -> DataFrame:
    """(row, kind, entity, term): the distinct terms in `near` of each row of found."""
    one = found.where("size(near) > 0").withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("near").alias("s")).select("row", "s.*")
    return one.select("row", "kind", "entity", F.explode(F.expr(f"array_distinct({WORDS})")).alias("term")).distinct()


def everywhere(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, key, spans, flagged) of the texts with an entity or a disclosing term; flagged: map from each such term to its generalisation, '' where it must go."""
    slim = keep(sentences(base_spans(docs)).where("size(spans) > 0"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = keep(neighbours(slim))
    slim = slim.drop("near")
    strong = keep(disclosing_rows(texts, near, disclosure, support).groupBy("term").agg(F.min(F.coalesce("generalised", F.lit(""))).alias("g")))
    words = texts.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.expr(f"array_distinct({WORDS})")).alias("term"))
    hits = words.join(strong, "term").groupBy("doc_id", "key").agg(F.collect_set(F.struct("term", "g")).alias("hits"))
    both = slim.select("*", F.lit(None).cast("array<struct<term:string,g:string>>").alias("hits")).unionByName(hits, allowMissingColumns=True)
    one = both.groupBy("doc_id", "key").agg(F.first("spans", True).alias("spans"), F.first("hits", True).alias("hits"))
    return one.select("doc_id", "key", F.coalesce("spans", F.array().cast(slim.schema["spans"].dataType)).alias("spans"), F.map_from_entries(F.coalesce("hits", F.array().cast("array<struct<term:string,g:string>>"))).alias("flagged"))


def term_spans(text: str, flagged: str) -> str:
    """SQL: array<struct<start, end, generalised>> of the terms in column `text` that are keys of the map `flagged`."""
    p = "'" + TERM.replace("\\", "\\\\") + "'"
    value = f"named_struct('start', x.s, 'end', x.e, 'generalised', nullif({flagged}[lower(x.v)], ''))"
    return _fold(text, p, "start:int,end:int,generalised:string", f"{flagged}[lower(x['0'])] is not null", value)


def detect(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_term, spans) of each row of docs (doc_id, text).

    Null text counts as empty: no span, and the hash of the empty string.
    Repeated rows stay. Other columns don't matter.
    """
    slim, terms = all_spans(docs, disclosure, support)
    joined = slim.join(terms, (slim.doc_id.eqNullSafe(terms.doc_id)) & (slim.key == terms.key), "left").select(slim.doc_id, slim.spans, terms.terms)
    text = F.expr("array_join(transform(spans, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    more = F.expr("array_join(transform(coalesce(terms, array()), x -> concat('term:', x.start, ':', x.end)), ',')")
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}")
    return joined.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(text, 256).alias("base_sha256"),
        F.expr("cast(size(coalesce(terms, array())) as long)").alias("n_term"), F.concat_ws(",", F.nullif(text, F.lit("")), F.nullif(more, F.lit(""))).alias("spans"),
    )


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The rows and columns of docs with `text` sanitised: entities become their mark, terms their stem or a mark.

    Of overlapping spans the one that begins first stays whole, then the
    longer, then by kind as listed; what another has beyond it is covered by
    its mark too. Null text stays null.
    """
    found = everywhere(docs, disclosure, support).select(F.col("doc_id").alias("__pii_doc"), F.col("key").alias("__pii_k"), F.col("spans").alias("__pii_base"), F.col("flagged").alias("__pii_flagged"))
    base = docs.withColumn("__pii_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    mark = "case x.kind " + " ".join(f"when '{k}' then '{MARKS[k]}'" for k in KINDS) + " end"
    spans = F.expr(f"""if(__pii_k is null, null, array_sort(concat(
        transform(__pii_base, x -> named_struct('start', x.start, 'less', -x.end, 'end', x.end, 'mark', {mark})),
        transform(if(size(__pii_flagged) > 0, {term_spans('text', '__pii_flagged')}, cast(array() as array<struct<start:int,end:int,generalised:string>>)), x -> named_struct('start', x.start, 'less', -x.end, 'end', x.end, 'mark', coalesce(x.generalised, '{MARKS["term"]}'))))))""")
    out = base.join(found, (base.doc_id.eqNullSafe(found["__pii_doc"])) & (base["__pii_key"] == found["__pii_k"]), "left").withColumn("__pii_spans", spans)
    # each span's mark and what stands between it and the one before; the pieces of PIECE spans are joined at a time
    text = F.expr(f"""aggregate(__pii_spans, named_struct('at', 0, 'some', cast(array() as array<string>), 'out', cast(array() as array<string>)),
        (a, x) -> if(x.end <= a.at, a, named_struct('at', x.end,
            'some', concat(if(size(a.some) >= {PIECE}, array(), a.some), array(substring(text, a.at + 1, greatest(0, x.start - a.at)), x.mark)),
            'out', if(size(a.some) >= {PIECE}, array_append(a.out, array_join(a.some, '')), a.out))),
        a -> concat(array_join(a.out, ''), array_join(a.some, ''), substring(text, a.at + 1)))""")
    return out.withColumn("text", F.when(F.col("__pii_spans").isNull() | F.col("text").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: personal data in every whole text."""
    return detect(table(spark, sf_dir, "documents"))


def _matches(kind: str, source: str, text: str, pattern: str, keys: str, at: str = "0") -> str:
    """DuckDB SQL: a row for each match of a pattern in a text, with its code points."""
    return f"""SELECT {keys}, '{kind}' AS kind, {at} + CAST(list_sum(list_transform(p[1 : i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i], lambda x: length(x))), 0) AS INT) AS s, m[i + 1] AS v
        FROM (SELECT *, unnest(range(CAST(len(m) AS BIGINT))) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS p FROM {source}))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(CAST(length({_DIGITS}) AS BIGINT)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INT), 1) AS INT) ELSE CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INT), 1) AS INT) * 2 - 9 * CAST(CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INT), 1) AS INT) > 4 AS INT) END)) % 10 = 0"
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  {_matches('email', "(SELECT * FROM docs WHERE contains(t, '@'))", 't', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'k, t, 1 AS o')} UNION ALL
  {_matches('ip', 'docs', 't', r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 'k, t, 2 AS o')} UNION ALL
  {_matches('card', 'docs', 't', r'[0-9](?:[ -]?[0-9])+', 'k, t, 3 AS o')} UNION ALL
  {_matches('phone', 'docs', 't', r'\+[0-9][ ().0-9-]+[0-9]', 'k, t, 4 AS o')}
), base AS (
  SELECT *, s + CAST(length(v) AS INT) AS e, CASE WHEN kind = 'email' THEN lower(v) ELSE regexp_replace(v, '[^0-9.]', '', 'g') END AS entity FROM found
  WHERE CASE kind WHEN 'email' THEN TRUE WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN} ELSE length({_DIGITS}) BETWEEN 9 AND 15 END
), windows AS (SELECT k, o, kind AS kd, entity, greatest(0, s - {REACH}) AS l0, e AS r0, substr(t, greatest(0, s - {REACH}) + 1, s - greatest(0, s - {REACH})) AS l, substr(t, e + 1, {REACH}) AS r FROM base),
sides AS (
  SELECT * FROM ({_matches('l', 'windows', 'l', r'\p{L}{3,}', 'k, kd, entity, l, r, l0', 'l0')}) WHERE s > l0 OR l0 = 0 UNION ALL
  SELECT * FROM ({_matches('r', 'windows', 'r', r'\p{L}{3,}', 'k, kd, entity, l, r, r0', 'r0')}) WHERE s + length(v) - r0 < {REACH}
), near AS (SELECT k, kd, entity, l, r, lower(v) AS term, s, s + CAST(length(v) AS INT) AS e FROM sides),
ne AS (SELECT kd, entity, count(DISTINCT (l, r)) AS ne FROM near GROUP BY 1, 2),
net AS (SELECT kd, entity, term, count(DISTINCT (l, r)) AS net FROM near GROUP BY 1, 2, 3 HAVING count(DISTINCT (l, r)) >= {SUPPORT}),
nt AS (SELECT term, count(*) AS nt FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '\p{{L}}{{3,}}'))) AS term FROM docs) WHERE term IN (SELECT term FROM net) GROUP BY term),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs),
strong AS (SELECT kd, entity, term FROM net JOIN ne USING (kd, entity) JOIN nt USING (term), total WHERE ne < n AND ln(net * n / (ne * nt)) / ln(n / ne) >= {DISCLOSURE}),
terms AS (SELECT DISTINCT k, s, e FROM near JOIN strong USING (kd, entity, term)),
b AS (SELECT k, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS x FROM base GROUP BY k),
c AS (SELECT k, count(*) AS n_term, string_agg('term:' || s || ':' || e, ',' ORDER BY s, e) AS y FROM terms GROUP BY k)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(x, '')) AS base_sha256, coalesce(n_term, 0) AS n_term, concat_ws(',', x, y) AS spans
FROM docs LEFT JOIN b USING (k) LEFT JOIN c USING (k)
"""
