"""WARC: round trips, and salvage of damaged archives."""

import gzip
import random

from larderlake.llm import warc


def archive(n, compress=True):
    bodies = [bytes([65 + i % 26]) * (i * 37 % 500) + b"WARC/1.1\r\n" * (i % 3) for i in range(n)]
    parts = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Block-Digest": f"sha1:{warc.digest(b)}"}, b, compress) for i, b in enumerate(bodies)]
    return bodies, parts


def read(data):
    found = list(warc.salvage(data))
    at = 0
    for start, end in dict.fromkeys(x[1:3] for x in found):
        assert start == at and end > start
        at = end
    assert at == len(data)
    return {h.get("warc-record-id"): body for kind, _, _, h, body, _ in found if kind == "record"}, [(s, e, why) for kind, s, e, _, _, why in found if kind == "gap"]


def test_whole_archives():
    for compress in (True, False):
        bodies, parts = archive(40, compress)
        records, gaps = read(b"".join(parts))
        assert not gaps and list(records.values()) == bodies
    assert list(warc.salvage(b"")) == []


def test_damage():
    rng = random.Random(2)
    for compress in (True, False):
        bodies, parts = archive(30, compress)
        for trial in range(30):
            hurt = set(rng.sample(range(30), 3))
            data = []
            for i, p in enumerate(parts):
                if i in hurt:
                    how = (trial + i) % 4
                    k = rng.randrange(len(p))
                    p = p[:k] if how == 0 else p[:k] + bytes(rng.randrange(256) for _ in range(9)) + p[k + 9 :] if how == 1 else b"" if how == 2 else b"\x00garbage" + p
                data.append(p)
            records, gaps = read(b"".join(data))
            for i, b in enumerate(bodies):
                if i not in hurt:
                    assert records[f"<urn:page:{i}>"] == b, (trial, i)
            for k, b in records.items():
                assert not compress or bodies[int(k[10:-1])] == b  # a member's CRC covers its headers too


def test_failed_digest_is_quarantined():
    bad = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<x>", "WARC-Block-Digest": f"sha1:{warc.digest(b'other')}"}, b"body")
    good = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<y>"}, b"good")
    records, gaps = read(bad + good)
    assert records == {"<y>": b"good"} and gaps == [(0, len(bad), "block digest differs")]


def test_several_records_in_a_member():
    a, b = (warc.record({"WARC-Record-ID": x}, x.encode(), False) for x in ("<a>", "<b>"))
    assert read(gzip.compress(a + b))[0] == {"<a>": b"<a>", "<b>": b"<b>"}


def test_damage_inside_a_member():
    """One record of many fails its check, the member is cut off, or its bytes are wrong: the others are read."""
    rng = random.Random(5)
    bodies = [rng.randbytes(3000) for _ in range(60)]
    parts = [warc.record({"WARC-Record-ID": f"<urn:page:{i}>", "WARC-Block-Digest": f"sha1:{warc.digest(b)}"}, b, False) for i, b in enumerate(bodies)]
    other = warc.record({"WARC-Record-ID": "<other>"}, b"other")
    hurt = parts[:20] + [parts[20][:-50] + b"?" + parts[20][-49:]] + parts[21:]
    records, gaps = read(gzip.compress(b"".join(hurt)) + other)
    assert records == {f"<urn:page:{i}>": b for i, b in enumerate(bodies) if i != 20} | {"<other>": b"other"}
    start = len(b"".join(parts[:20]))
    assert [why for *_, why in gaps] == [f"block digest differs (inflated bytes {start} to {start + len(parts[20])})"]
    whole = gzip.compress(b"".join(parts))
    records, gaps = read(whole[: len(whole) // 2])
    assert list(records.values()) == bodies[: len(records)] and len(records) >= 28 and gaps[-1][2] == "gzip: the member doesn't end"
    records, gaps = read(whole[:-8] + b"\0" * 8 + other)
    assert len(records) == 61 and len(gaps) == 1 and "gzip" in gaps[0][2]
    plain = gzip.compress(b"".join(warc.record({"WARC-Record-ID": f"<{i}>"}, b"body", False) for i in range(3)))
    assert read(plain[:-8] + b"\0" * 8 + other)[0] == {"<other>": b"other"}
    two = whole[: len(whole) // 2] + whole
    assert list(read(two)[0].values()) == bodies


def test_query(spark, sf):
    pages = spark.read.parquet(sf + "/pages.parquet").collect()
    first = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(r.html, r.page_id)
    got = {r.page_id: r for r in warc.query(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        raw, r = (p.html or "").encode(), got[p.page_id]
        again = first[p.html] != p.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), warc.digest(raw), "revisit" if again else "response", first[p.html] if again else None)


def test_rows(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "u\r\nx", None), (4, "v", ""), (5, "w", "é" * 1000), (1, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df)).where("kind = 'record'").collect()
    assert sorted((r.id, r.type, r.refers_to) for r in got) == sorted([("<urn:page:3>", "revisit", "<urn:page:1>"), ("<urn:page:1>", "response", None), ("<urn:page:2>", "response", None), ("<urn:page:4>", "revisit", "<urn:page:2>"), ("<urn:page:5>", "response", None), ("<urn:page:1>", "response", None)])
    few = warc.read_archives(warc.write_archives(df, least=100)).where("type = 'revisit'").count()
    assert few == 0 and warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, None, "x"), (None, "u", None), (4, "v", "x")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.query(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "response", None), (0, 1, "revisit", 4), (4, 1, "response", None)]


def test_table_of_damaged_archives(spark):
    _, parts = archive(5)
    df = spark.createDataFrame([(bytearray(parts[0] + b"junk" + parts[1]),), (None,), (bytearray(b""),), (bytearray(b"nothing"),)], "archive binary")
    got = warc.read_archives(df).collect()
    assert sorted(r.kind for r in got) == ["gap", "gap", "record", "record"] and {r.reason for r in got if r.kind == "gap"} == {"no version line"}
