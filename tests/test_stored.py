"""Stored tables: what is opened, how many jobs it takes, compaction by stripe, copies, and commits that die."""

import zlib

import pytest

from larderlake.__main__ import main
from larderlake.database import Database, Operation
from larderlake.errors import InvalidExpression, TransactionCanceled
from larderlake.model import IndexSpec, StreamSpec, TableSpec
from larderlake.operators.read import Query, batch_get, query, txn_get
from larderlake.sources import catalog as C

SPEC = TableSpec(indexes=(IndexSpec.global_("by_city", "city", "n"), IndexSpec.local("by_n", "n")), stream=StreamSpec())


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, f"file://{tmp_path}/t", SPEC, now=lambda: 1000)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_reads(db):
    db.write([Operation("put", f"k{i}", {"city": "Oslo" if i % 3 else "Rome", "n": i}) for i in range(9)])
    db.update("k1", "SET city = :c", values={":c": "Rome"})
    db.delete("k2")
    found = lambda c: sorted(r.base_pk for r in db.query(Query(c).index("by_city")).df.collect())
    assert found("Oslo") == ["k4", "k5", "k7", "k8"] and found("Rome") == ["k0", "k1", "k3", "k6"] and found("none") == []
    stripes = {zlib.crc32(k.encode()) % 256 for k in ("k0", "k1", "k3", "k6")}
    text = plan(db.query(Query("Rome").index("by_city")).df)
    assert "stripe#" in text and all(str(s) in text for s in stripes)
    assert len(set(db.query(Query("Rome").index("by_city")).df.inputFiles())) < 20
    db.compact()
    db.vacuum()
    assert found("Rome") == ["k0", "k1", "k3", "k6"] and found("Oslo") == ["k4", "k5", "k7", "k8"]


def test_statements_and_local_indexes_open_one_stripe(db):
    db.write([Operation("put", f"k{i}", {"city": "Oslo", "n": i}) for i in range(40)])
    s = zlib.crc32(b"k7") % 256
    for df in (db.execute("SELECT n FROM t WHERE pk = 'k7'").page.df, db.query(Query("k7").index("by_n")).df):
        assert df.count() == 1 and f"stripe={s}/" in str(df.inputFiles()) or f"IN ({s})" in plan(df) or f"= {s})" in plan(df), plan(df)


def test_typed_keys_reach_the_scan(spark, small):
    t = C.orders(spark, small)
    for df in (batch_get(t, [("85", "5277"), ("85", "1")]), txn_get(t, [("85", "5277")]), query(t, Query("85").sk_gte(0.0).index("by_price")).df):
        assert "EqualTo(o_custkey,85)" in plan(df) or "In(o_custkey, [85" in plan(df), plan(df)


def test_updates_of_many_keys_are_evaluated_together(spark, db, monkeypatch):
    db.write([Operation("put", f"k{i}", {"n": i}) for i in range(10)])
    calls, kind = [], type(spark.range(1))
    own = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: calls.append(1) or own(self))
    db.write([Operation("update", f"k{i}", expression="SET n = n + :a", condition="attribute_exists(n)", values={":a": i}) for i in range(10)])
    monkeypatch.undo()
    assert len(calls) == 2 and [db.get(f"k{i}")["n"] for i in (0, 1, 9)] == [0, 2, 18]  # the present items, and all conditions and updates


def test_later_operations_see_earlier_ones(db):
    got = db.write([Operation("put", "a", {"n": 1}), Operation("update", "a", expression="SET n = n + n"), Operation("put", "b", {"n": 5}), Operation("update", "a", expression="SET n = n + n"), Operation("delete", "b")], atomic=False)
    assert got == [{"n": 1}, {"n": 2}, {"n": 5}, {"n": 4}, None] and db.get("a") == {"n": 4} and db.get("b") is None


def test_failed_transactions_leave_nothing(db):
    db.put("a", {"n": "text"})
    before = db.head()
    with pytest.raises(InvalidExpression):
        db.transact_write([Operation("put", "b", {"n": 1}), Operation("update", "a", expression="SET n = n + :x", values={":x": 1})])
    with pytest.raises(TransactionCanceled):
        db.transact_write([Operation("put", "b", {"n": 1}), Operation("check", "a", condition="n = :x", values={":x": 1})])
    assert db.head() == before and db.get("b") is None


def test_compaction_of_due_stripes(db):
    for i in range(4):
        db.write([Operation("put", "hot", {"n": i}), *([Operation("put", "cold", {"n": i})] if i < 2 else [])], atomic=False)
    hot = zlib.crc32(b"hot") % 256
    assert db.compact_due(5) == [] and db.compact_due(4) == [hot] and db.compact_due(4) == []
    assert db.get("hot") == {"n": 3} and db.get("cold") == {"n": 1} and db.log().count() == 3
    db.put("hot", {"n": 9})
    assert db.compact(hot)["versions_in"] == 2 and db.compact(hot)["versions_in"] == 0
    db.vacuum()
    assert db.get("hot") == {"n": 9} and db.get("cold") == {"n": 1} and Database.open(db.spark, db.path).log().count() == 3
    assert db.compact()["records_out"] == 2 and db.log().count() == 2


def test_copies(db, tmp_path):
    db.put("a", {"n": 1})
    to = f"file://{tmp_path}/copy"
    assert db.push(to) == {"copied": 1, "skipped": 0} and db.push(to) == {"copied": 0, "skipped": 1}
    db.put("b", {"n": 2})
    assert db.push(to) == {"copied": 1, "skipped": 1}
    other = Database.open(db.spark, to)
    assert other.get("b") == {"n": 2} and len(other.commits()) == 2 and other.query(Query("x").index("by_city")).count == 0
    broken = next(p for p in (tmp_path / "copy" / "data").rglob("*.parquet"))
    broken.unlink()
    assert db.push(to, verify=True) == {"copied": 1, "skipped": 1} and other.scan().count == 2


def test_a_commit_that_dies(db, monkeypatch):
    """Rows written without a commit file show nowhere, and vacuum takes their folder."""
    db.put("a", {"n": 1})
    monkeypatch.setattr(db, "_publish", lambda state: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        db.put("b", {"n": 2})
    again = Database.open(db.spark, db.path)
    assert again.get("b") is None and again.scan().count == 1 and again.health() == "Healthy"
    assert again.vacuum() == 1 and again.get("a") == {"n": 1}


def test_command_line_shows_all_rows(spark, db):
    db.write([Operation("put", f"k{i:04d}", {"n": i}) for i in range(1100)])
    for form, extra in (("jsonl", 0), ("csv", 1), ("table", 2)):
        assert len(main([db.path, "--format", form, "scan"], spark).split("\n")) == 1100 + extra
    assert main([db.path, "--format", "json", "scan"], spark).count('"n"') == 1100
    assert len(main([db.path, "--format", "jsonl", "scan", "--limit", "3"], spark).split("\n")) == 3
