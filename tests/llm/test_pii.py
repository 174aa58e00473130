"""PII against a brute-force version in plain Python."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larderlake.llm import pii

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(x):
    s = 0
    for i, c in enumerate(reversed(x)):
        d = int(c) * (1 + i % 2)
        s += d - 9 * (d > 9)
    return s % 10 == 0


def holds(kind, x):
    digits = re.sub(r"[^0-9]", "", x)
    return {
        "email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else False,
        "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
    }[kind]


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k in RX for m in re.finditer(RX[k], text or "") if holds(k, m[0])]


def brute(rows, disclosure=pii.DISCLOSURE, support=pii.SUPPORT):
    """{row: (base spans, term spans with their generalisation)}."""
    words = [[w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")] for _, t in rows]
    nt, ns = defaultdict(int), defaultdict(int)
    for ws in words:
        for w in set(ws):
            nt[w] += 1
        for s in {w[: pii.STEM] for w in ws}:
            ns[s] += 1
    e, et, near = defaultdict(set), defaultdict(set), []
    found = [base(t) for _, t in rows]
    for i, (_, t) in enumerate(rows):
        for k, a, b, v in found[i]:
            key = (k, v.lower() if k == "email" else re.sub(r"[^0-9.]", "", v))
            l0 = max(0, a - pii.REACH)
            left, right = t[l0:a], t[b : b + pii.REACH]
            own = [(m[0].lower(), l0 + m.start(), l0 + m.end()) for m in re.finditer(r"[^\W\d_]{3,}", left) if m.start() > 0 or l0 == 0]
            own += [(m[0].lower(), b + m.start(), b + m.end()) for m in re.finditer(r"[^\W\d_]{3,}", right) if m.end() < pii.REACH]
            if own:
                e[key].add((left, right))
            for w, x, y in own:
                et[key, w].add((left, right))
                near.append((i, key, w, x, y))
    out = {i: (f, {}) for i, f in enumerate(found)}
    n = len(rows)
    for i, key, w, x, y in near:
        ne, both = len(e[key]), len(et[key, w])
        if both < support or ne >= n:
            continue
        d = lambda c: math.log(both * n / (ne * c)) / math.log(n / ne)
        if d(nt[w]) >= disclosure:
            g = w[: pii.STEM] + "*" if d(ns[w[: pii.STEM]]) < disclosure else ""
            old = out[i][1].get((x, y))
            out[i][1][x, y] = g if old is None else min(old, g)
    return out


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, (d, _) in enumerate(rows):
        spans, terms = want[i]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (d, text, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in RX]
        assert r.spans == ",".join([text] * bool(text) + [f"term:{a}:{b}" for a, b in sorted(terms)]), d
    return got


def test_fixture_rows(spark):
    rows = [
        (1, "mail a.b+c@d-e.org, x@y, b@c..d a@b.c+d@e.f x@y@z.com"), (2, "999.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.0255 é 10.0.0.256"),
        (3, "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111"), (4, "+1 (017) 555-7713 +12 +1 2 3 4 5 6 7 8 9 ( x ++49 30 123456.7"),
        (5, None), (6, ""), (7, "5" * 60000), (8, "a" * 60000 + "@b.c"), (9, "𝒳é +4912345678901 😀 1.2.3.4"),
        *[(i, f"the keeper zorblax lives near 10.1.2.3 by lane {'abc' * (i - 9)} road") for i in range(10, 15)],
        *[(i, f"the lane here is plain and zone {i}") for i in range(20, 40)],
    ]
    got = compare(spark, rows)
    assert "term:11:18" in got[10].spans


def test_sql(spark):
    """The SQL where terms disclose, and on texts without anything."""
    import duckdb

    con = duckdb.connect()
    rows = [(i, f"the keeper zorblax lives near 10.1.2.3 by lane {'abc' * (i + 1)} road x{i}@mail.example.org, +49 30 1234567{i} 4111 1111 1111 1111") for i in range(6)] + [(i, f"the lane here is plain and zone {i}") for i in range(20, 40)] + [(50, None), (51, "")]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(pii.ORACLE_SQL).fetchall())
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select(*[d[0] for d in con.description]).collect())) == want and any("term" in r[-1] for r in want)


def test_whole_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, rows)


def test_sanitise(spark):
    rows = [(1, "call +1 (017) 555-7713 now", 5), (2, None, 6), (3, "clean", 7), (3, "clean", 7)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()}
    assert out[1].text == "call [PHONE] now" and out[2].text is None and out[3].text == "clean" and out[1].key == 5


def test_sanitise_matches_spans(spark):
    rows = [(i, f"the keeper zorblax lives near 10.1.2.3 by lane {'abc' * (i + 1)} road") for i in range(5)] + [(i, f"the lane here is plain and zone {i}") for i in range(20, 40)]
    want = brute(rows)
    for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        i = [x[0] for x in rows].index(r.doc_id)
        spans = [(a, b, f"[{k.upper()}]") for k, a, b, _ in want[i][0]] + [(a, b, g or "[TERM]") for (a, b), g in want[i][1].items()]
        text, at, out = rows[i][1], 0, ""
        for a, b, m in sorted(spans):
            out, at = out + text[at:a] + m, b
        assert r.text == out + text[at:]


def test_null_ids_and_clashing_names(spark):
    text = "the keeper zorblax lives near 10.1.2.3 by the lane"
    rows = [(None if i < 2 else i, f"{text} {'abc' * (i + 1)}", "keep") for i in range(6)] + [(9, "plain", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").selectExpr("*", "spans AS key", "spans AS terms", "spans AS kind", "spans AS start")
    out = pii.sanitise(df).collect()
    assert len(out) == 7 and all("10.1.2.3" not in r.text and "zorblax" not in r.text and r.key == "keep" for r in out if r.text != "plain") and out[0].asDict().keys() == set(df.columns)
    assert pii.detect(df).where("n_ip = 1 and n_term > 0").count() == 6


def test_rare_entities_and_copies(spark):
    """A term that stands with one entity alone goes, be the entity seen once or in exact copies only; common words and terms of small tables stay."""
    rows = [(1, "the common keeper zorblax writes from ann@mail.example today"), *[(100 + i, f"the common warden quillon of {'ab'[i // 20]} has 10.1.2.3 today") for i in range(40)], *[(1000 + i, "the common road writes from here today") for i in range(200)]]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zorblax" not in out[1] and "keeper" not in out[1] and out[1].startswith("the common ") and out[1].endswith(" writes from [EMAIL] today")
    assert all("quillon" not in out[100 + i] and "warden" not in out[100 + i] and "common" in out[100 + i] for i in range(40))
    assert out[1000] == "the common road writes from here today"


def test_terms_go_everywhere(spark):
    """Far from the entity in the same text, in texts without it, at the window's edge, and beyond it in the same sentence."""
    far = "plain words stand here. " * 20
    rows = [(1, f"Zorblax begins. {far}the keeper zorblax has 10.1.2.3 now. {far}So zorblax ends"), (2, "of zorblax alone"), (5, "the keeper zorblax has 10.1.2.3 now."), *[(i, f"plain words stand here and the keeper has now so begins ends {i}") for i in range(10, 300)]]
    rows += [(3, f"{'the words and ' * 9}quillon {'plain words ' * 9} mail x@y.example now."), (4, "the words " + "z" * 60 + " 10.9.8.7")]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zorblax" not in out[1].lower() and "10.1.2.3" not in out[1] and out[1].count("plain words stand here. ") == 40
    assert "zorblax" not in out[2] and "quillon" not in out[3] and "zzz" not in out[4] and all(out[d] == t for d, t in rows if d >= 10)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(df).count() == 0 and pii.sanitise(df).count() == 0


@pytest.mark.parametrize("kind", list(RX))
def test_no_python_in_the_plan(spark, kind):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x@y.zz").alias("text"))
    assert "Python" not in pii.base_spans(df)._jdf.queryExecution().toString()
