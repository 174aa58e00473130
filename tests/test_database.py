"""The stored table: scenarios of paging, indexes, transactions, feeds, TTL, compaction, statements."""

import pytest

from larderlake.database import Database, Operation
from larderlake.errors import ConditionalCheckFailed, ConflictingCommit, InvalidExpression, InvalidQuery, NotFound, TransactionCanceled, ValidationFailed
from larderlake.functions import values as V
from larderlake.model import AttributeSchema, IndexSpec, StreamSpec, TableSpec
from larderlake.operators.read import Query, Scan

SPEC = TableSpec(
    indexes=(IndexSpec.local("by_score", "score"), IndexSpec.global_("by_status", "status", "at"), IndexSpec.global_("names", "status").including("name")), ttl="ttl", stream=StreamSpec(buffer_size=50),
    attributes=(AttributeSchema("age", "Number", min_value=0, max_value=150),),
)


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, str(tmp_path / "t"), SPEC, now=lambda: 1_000_000)


def items(page):
    return [(r.pk, r.sk, V.item(r.attrs)) for r in page.df.collect()]


def test_put_get_delete_reopen(spark, db):
    db.put("user#1", {"name": "Ann", "age": 30, "active": True, "tags": ["a", {"b": None}], "raw": b"\x00\xff", "v": V.Vector((1.5,)), "t": V.Timestamp(-1000), "none": None})
    db.put(("user#1", "post#1"), {"title": "x"})
    assert db.get("user#1") == {"name": "Ann", "age": 30, "active": True, "tags": ["a", {"b": None}], "raw": b"\x00\xff", "v": V.Vector((1.5,)), "t": V.Timestamp(-1000), "none": None}
    again = Database.open(spark, db.path, now=db.now)
    assert again.spec == SPEC and again.get(("user#1", "post#1")) == {"title": "x"} and again.get("user#2") is None
    db.delete("user#1")
    db.delete("never there")
    assert db.get("user#1") is None and db.get(("user#1", "post#1")) == {"title": "x"} and db.health() == "Healthy"
    with pytest.raises(NotFound):
        Database.open(spark, db.path + "x")


def test_scan_pages_and_segments(db):
    db.batch_write(puts=[(f"user#{i:03d}", {"id": i}) for i in range(30)])
    seen, after = [], None
    while True:
        s = Scan().limit(10)
        page = db.scan(s if after is None else s.start_after(*after))
        if not (after := page.last_key):
            break
        seen += [i for _, _, x in items(page) for i in x.values()]
    assert seen == list(range(30))
    parts = [{r.pk for r in db.scan(Scan().segment(i, 4)).df.collect()} for i in range(4)]
    assert sum(map(len, parts)) == 30 and len(set().union(*parts)) == 30


def test_query(db):
    db.batch_write(puts=[(("user#1", f"item#{i:03d}"), {"id": i}) for i in range(20)] + [("user#1", {"id": -1}), (("user#2", "item#001"), {"id": 99})])
    ids = lambda q: [x["id"] for _, _, x in items(db.query(q))]
    assert ids(Query("user#1")) == [-1, *range(20)]
    assert ids(Query("user#1").sk_begins_with("item#01").limit(5)) == [10, 11, 12, 13, 14]
    assert ids(Query("user#1").sk_between("item#003", "item#005").forward(False)) == [5, 4, 3]
    assert ids(Query("user#1").start_after("user#1", "item#017")) == [18, 19]
    assert ids(Query("user#1").forward(False).start_after("user#1", "item#001")) == [0, -1]
    db.delete(("user#1", "item#004"))
    page = db.query(Query("user#1").sk_gte("item#003").limit(3))
    assert (page.count, page.last_key) == (3, ("user#1", "item#006"))
    page = db.query(Query("user#1").sk_lt("item#006"))
    assert (page.count, page.scanned_count) == (5, 6)


def test_updates_and_conditions(db):
    db.put("c", {"n": 100})
    assert db.update("c", "SET n = n + :x, m = :m", values={":x": 50, ":m": "y"}) == {"n": 150, "m": "y"}
    assert db.update("new", "ADD hits :x", values={":x": 1}) == {"hits": 1}
    with pytest.raises(ConditionalCheckFailed):
        db.put("c", {"n": 0}, "attribute_not_exists(n)")
    with pytest.raises(ConditionalCheckFailed):
        db.update("c", "SET n = :x", "n < :x", {":x": 5})
    with pytest.raises(ConditionalCheckFailed):
        db.delete("c", "m = :v", {":v": "z"})
    with pytest.raises(InvalidExpression):
        db.update("c", "SET n = :x", "nope > :x", {":x": 5})
    db.put("c", {"n": 1}, "n = :v AND attribute_exists(#m)", {":v": 150}, {"#m": "m"})
    assert db.get("c") == {"n": 1}


def test_transactions(db):
    db.batch_write(puts=[(f"item#{i}", {"value": i}) for i in range(3)])
    with pytest.raises(TransactionCanceled):
        db.transact_write([Operation("put", "item#0", {"value": 10}), Operation("update", "item#1", None, "SET value = :v", "value = :old", {":v": 5, ":old": 99})])
    assert db.transact_get(["item#1", "nope", "item#0"]) == [{"value": 1}, None, {"value": 0}]
    db.transact_write([Operation("put", "item#0", {"value": 10}), Operation("delete", "item#1"), Operation("update", "item#2", None, "SET value = value + :v", None, {":v": 5}), Operation("check", "item#9", None, None, "attribute_not_exists(value)")])
    assert db.transact_get(["item#0", "item#1", "item#2"]) == [{"value": 10}, None, {"value": 7}]
    with pytest.raises(TransactionCanceled):
        db.transact_write([Operation("put", "a", {}), Operation("delete", "a")])
    assert db.batch_get(["item#0", "item#0", "zz"]) == {("item#0", None): {"value": 10}}


def test_second_writer_fails(spark, db):
    head = db.head()
    db.put("a", {"x": 1})
    with pytest.raises(ConflictingCommit):
        db._commit(spark.createDataFrame([("b", None, 99, False, 0, {})], db.log().drop("stripe").schema), head, 1)
    assert db.get("b") is None and db.scan().count == 1


def test_indexes(db):
    db.batch_write(puts=[(f"order#{i}", {"status": "pending" if i < 7 else "done", "at": 1100 + 100 * i, "name": f"n{i}"}) for i in range(10)] + [("plain", {"x": 1})])
    assert db.query(Query("pending").sk_gte("1500").index("by_status")).count == 3
    assert {tuple(sorted(V.item(r.attrs))) for r in db.index("names").collect()} == {("name", "status")}
    for i in range(5):
        db.put("game", {"score": 100 * i})
    assert db.query(Query("game").index("by_score")).count == 1 and db.index("by_score", over_log=True).where("pk = 'game'").count() == 5
    db.update("order#0", "SET #s = :d", values={":d": "done"}, names={"#s": "status"})
    assert db.query(Query("pending").index("by_status")).count == 6


def test_ttl(db):
    db.batch_write(puts=[(("u", f"item#{i}"), {"ttl": 500 if i < 2 else 2000}) for i in range(5)] + [("ms", {"ttl": V.Timestamp(999_999)}), ("live", {"ttl": 1000}), ("odd", {"ttl": "text"})])
    assert db.query(Query("u")).count == 3 and db.get("ms") is None and db.get("live") == {"ttl": 1000} and db.get("odd") == {"ttl": "text"}
    assert db.scan().count == 5 and db.purge_expired() == 3 and db.purge_expired() == 0


def test_feed(db):
    db.put("user#1", {"name": "a"})
    db.put("user#1", {"name": "b"})
    db.delete("user#1")
    rows = db.stream().collect()
    assert [(r.seq, r.op) for r in rows] == [(1, "INSERT"), (2, "MODIFY"), (3, "REMOVE")]
    assert V.item(rows[1].old_image.attrs) == {"name": "a"} and V.item(rows[1].new_image.attrs) == {"name": "b"} and rows[2].new_image is None
    assert [r.seq for r in db.stream(after=2).collect()] == [3]


def test_feed_buffer(spark, tmp_path):
    db = Database.create(spark, str(tmp_path / "t"), TableSpec(stream=StreamSpec(buffer_size=5)))
    db.batch_write(puts=[(f"i#{i}", {"d": i}) for i in range(10)])
    assert [r.seq for r in db.stream().collect()] == [6, 7, 8, 9, 10]
    off = Database.create(spark, str(tmp_path / "u"))
    off.put("a", {})
    assert off.stream().count() == 0


def test_validation(db):
    with pytest.raises(ValidationFailed):
        db.put("a", {"age": 200}, validate=True)
    db.put("a", {"age": 200})
    db.put("b", {"age": 20}, validate=True)
    assert db.scan().count == 2


def test_compaction_keeps_the_view(db):
    for n in range(3):
        db.batch_write(puts=[(f"k{i}", {"n": n, "i": i}) for i in range(10)], deletes=[f"k{n}"])
    before = sorted(map(repr, items(db.scan())))
    old = db.head()["commit"]
    assert db.compact() == {"versions_in": 33, "keys": 10, "records_removed": 23, "tombstones_removed": 1, "records_out": 9}
    assert sorted(map(repr, items(db.scan()))) == before and db.log().count() == 9
    assert db.table(commit=old).df.count() == 9 and db.vacuum() == 3 and sorted(map(repr, items(db.scan()))) == before
    db.put("k0", {"n": 9})
    assert db.get("k0") == {"n": 9}


def test_put_many_and_snapshot(spark, db, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", None, {"i": V.to_av(i)}) for i in range(500)], "pk string, sk string, attrs map<string," + V.AV.simpleString() + ">")
    assert db.put_many(rows) == 500 and db.stats()["total_keys"] == 500
    db.put("p7", {"i": -1})
    db.snapshot(str(tmp_path / "copy"))
    copy = Database.open(spark, str(tmp_path / "copy"), now=db.now)
    assert copy.get("p7") == {"i": -1} and copy.scan().count == 500


def test_statements(db):
    assert db.execute("INSERT INTO users VALUE {'pk': 'u1', 'sk': 's', 'name': 'It''s', 'age': 20, 'l': [1, 2]}").kind == "insert"
    for i in range(5):
        db.execute(f"INSERT INTO users VALUE {{'pk': 'v{i}', 'age': {i}, 'city': 'x'}}")
    r = db.execute("SELECT name, age FROM users WHERE pk = 'u1' AND age > 10")
    assert [V.item(x.attrs) for x in r.page.df.collect()] == [{"name": "It's", "age": 20}]
    assert [V.item(x.attrs)["age"] for x in db.execute("SELECT age FROM users WHERE age >= 1 AND city = 'x' LIMIT 2 OFFSET 1").items.collect()] == [2, 3]
    assert [V.item(x.attrs)["age"] for x in db.execute("SELECT age FROM users ORDER BY age DESC LIMIT 2").items.collect()] == [20, 4]
    assert db.execute("UPDATE users SET age = age + 1 - 2, z = 'q' REMOVE l WHERE pk = 'u1' AND sk = 's'").item == {"name": "It's", "age": 19, "z": "q"}
    with pytest.raises(ConditionalCheckFailed):
        db.execute("DELETE FROM users WHERE pk = 'u1' AND sk = 's' AND age > 100")
    db.execute("DELETE FROM users WHERE pk = 'u1' AND sk = 's'")
    assert db.get(("u1", "s")) is None
    with pytest.raises(InvalidQuery):
        db.execute("SELECT COUNT(*) FROM users")
    assert db.execute("SELECT * FROM users WHERE age < 2 OR age > 3", extended=True).page.count == 3


def test_one_partition_opens_one_stripe(db):
    db.batch_write(puts=[(f"k{i}", {"i": i}) for i in range(20)])
    plan = db._partition(["k3"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(stripe" in plan
