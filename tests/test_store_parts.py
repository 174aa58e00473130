"""Keys, sources and sinks, replicas, clocks, validation, retry."""

import json

import pytest
from pyspark.sql import functions as F

from larderlake.errors import ConflictingCommit, InvalidArgument
from larderlake.functions import keys as K
from larderlake.functions import values as V
from larderlake.functions.retry import Retry
from larderlake.model import AttributeSchema, IndexSpec, TableSpec
from larderlake.operators import index, log, read, replica, validate
from larderlake.sources import io as IO
from larderlake.sources.items import ItemTable
from larderlake.streaming import cdc


def test_stripes_equal_crc32(spark):
    import zlib

    got = spark.createDataFrame([("user#123",), ("",), ("é",)], "pk string").select("pk", K.stripe().alias("s")).collect()
    assert all(r.s == zlib.crc32(r.pk.encode()) % 256 for r in got) and got[0].s == 125


@pytest.mark.parametrize("mode", K.KEY_ORDERS)
@pytest.mark.parametrize("reverse", [False, True])
def test_pages_cover_everything(spark, mode, reverse):
    keys = [(p, s) for p in ("1", "10", "9", "b") for s in (None, "", "2", "10", "é")]
    if mode == "encoded":
        keys = [k for k in keys if k[1] != ""]  # a missing and an empty sk are one key there
    t = ItemTable(spark.createDataFrame(keys, "pk string, sk string"), TableSpec(key_order=mode))
    whole = [tuple(r) for r in t.df.orderBy(*K.order(mode, reverse)).collect()]
    seen, after = [], None
    while True:
        df = t.df if after is None else t.df.where(K.beyond(after, mode, reverse))
        rows = [tuple(r) for r in df.orderBy(*K.order(mode, reverse)).limit(3).collect()]
        if not rows:
            break
        seen, after = seen + rows, rows[-1]
    assert seen == whole and set(whole) == set(keys)
    assert (whole[0][0] == "1") != reverse


def test_binary_keys(spark):
    t = ItemTable(spark.createDataFrame([(bytearray(b"\x01"), bytearray(b"\xff")), (bytearray(b"\x01"), bytearray(b"\x7f\x00"))], "pk binary, sk binary"))
    assert [bytes(r.sk) for r in read.query(t, read.Query(b"\x01").sk_begins_with(b"\x7f")).df.collect()] == [b"\x7f\x00"]
    assert [bytes(r.sk) for r in read.query(t, read.Query(b"\x01")).df.collect()] == [b"\x7f\x00", b"\xff"]


def tagged(spark, items):
    return spark.createDataFrame([(k, None, {n: V.to_av(v) for n, v in i.items()}) for k, i in items], "pk string, sk string, attrs map<string," + V.AV.simpleString() + ">")


def test_json(spark, tmp_path):
    x = IO.parse_item('{"pk": "a", "n": 1.0, "l": [1, {"k": null}], "s": "q\\"é", "b": true}')
    assert x["n"] == V.Number("1.0") and x["l"] == [V.Number("1"), {"k": None}]
    df = tagged(spark, [("a", x), ("b", {"bin": b"\x00\x01", "t": V.Timestamp(-5), "v": V.Vector((1.5,)), "odd": V.Number("1e400x")})])
    lines = [json.loads(r.value) for r in IO.json_lines(df).collect()]
    assert lines[0] == {"pk": "a", "n": 1.0, "l": [1, {"k": None}], "s": 'q"é', "b": True} and lines[1] == {"bin": "AAE=", "t": -5, "v": [1.5], "odd": "1e400x"}
    IO.write_json_lines(df, str(tmp_path / "j"))
    back = {r.pk: V.item(r.attrs, True) for r in IO.read_json_lines(spark, str(tmp_path / "j"), "pk").collect()}
    assert back["a"] == x
    for bad in ("[1]", "{", "5"):
        with pytest.raises(InvalidArgument):
            IO.parse_item(bad)
    assert json.loads(IO.pretty_json(df))[0]["s"] == 'q"é'


def test_csv_and_table(spark, tmp_path):
    df = tagged(spark, [("a", {"x": 'he said "hi", ok', "n": 5}), ("b", {"l": [1], "bin": b"1", "v": V.Vector((1.0,)), "none": None})])
    assert IO.csv_text(df).splitlines() == ["bin,l,n,none,v,x", ',,5,,,"he said ""hi"", ok"', "[binary],[object],,null,[vector],"]
    assert IO.table_text(df).splitlines()[2].split(" | ")[0].strip() == "-"
    IO.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).columns == ["bin", "l", "n", "none", "v", "x"]
    typed = spark.createDataFrame([("a", None, 1, [1.5])], "pk string, sk string, z int, f array<float>")
    assert IO.csv_text(typed) == "f,z\n[vector],1\n"


def test_vector_clocks(spark):
    m = lambda x: F.create_map(*[F.lit(y) for k, v in x.items() for y in (k, v)]).cast("map<string,bigint>") if x else F.create_map().cast("map<string,bigint>")
    for a, b, want in (({}, {}, "Equal"), ({"a": 1}, {"a": 1}, "Equal"), ({"a": 1}, {"a": 2}, "Before"), ({"a": 2, "b": 1}, {"a": 1}, "After"), ({"a": 1}, {"b": 1}, "Concurrent"), ({"a": 0}, {}, "Equal")):
        assert spark.range(1).select(replica.vclock_compare(m(a), m(b))).first()[0] == want
    r = spark.range(1).select(replica.vclock_merge(m({"a": 1, "b": 5}), m({"a": 3})), replica.vclock_increment(m({"a": 1}), "a"), replica.vclock_increment(m({}), "z"), replica.vclock_happens_before(m({"a": 1}), m({"a": 2})), replica.vclock_concurrent(m({"a": 1}), m({"b": 1}))).first()
    assert list(r) == [{"a": 3, "b": 5}, {"a": 2}, {"z": 1}, True, True]


def replicas(spark):
    a = spark.createDataFrame([("1", None, "x", 100), ("2", None, "same", 5), ("3", None, "l", 7)], "pk string, sk string, v string, updated_at long")
    b = spark.createDataFrame([("1", None, "y", 200), ("2", None, "same", 5), ("4", None, "r", 7)], "pk string, sk string, v string, updated_at long")
    return a, b


def test_replicas(spark):
    a, b = replicas(spark)
    assert {(r.pk, r.kind) for r in replica.diff(a, b).collect()} == {("1", "Modified"), ("3", "LocalOnly"), ("4", "RemoteOnly")} and replica.diff(a, a).count() == 0
    assert {r.pk: r.v for r in replica.merge(a, b).collect()} == {"1": "y", "2": "same", "3": "l", "4": "r"}
    assert {r.pk: r.v for r in replica.merge(a, b, "fww").collect()}["1"] == "x"
    push, pull = replica.transfer(a, b)
    assert sorted(r.pk for r in push.collect()) == ["1", "3"] and sorted(r.pk for r in pull.collect()) == ["1", "4"]
    with pytest.raises(InvalidArgument):
        replica.merge(a, b, "nope")


def test_equal_times_go_to_local(spark):
    a, b = (x.withColumn("updated_at", F.lit(1)) for x in replicas(spark))
    for s in ("lww", "fww"):
        assert {r.pk: r.v for r in replica.merge(a, b, s).collect()}["1"] == "x"


def test_merkle(spark):
    a, b = replicas(spark)
    tree = lambda df, f=16: {(r.level, r.node): r.hash for r in replica.merkle_levels(replica.leaves(df), fan_out=f).collect()}
    x, y, top = tree(a), tree(b), 3
    assert x == tree(a.repartition(3)) and x[top, 0] != y[top, 0] and max(k[0] for k in x) == top and max(k[0] for k in tree(a, 2)) == 12
    with pytest.raises(InvalidArgument):
        tree(a, 1)


def test_feed_leads_from_old_to_new(spark):
    rows = [(f"k{i % 7}", None, i, i % 5 == 3, i * i) for i in range(60)]
    whole = spark.createDataFrame(rows, "pk string, sk string, seq long, deleted boolean, v int")
    old = log.live(whole.where("seq < 30")).drop("seq")
    new = log.live(whole).drop("seq")
    assert sorted(map(tuple, cdc.replay(old, cdc.changes(whole).where("seq >= 30")).collect())) == sorted(map(tuple, new.collect()))


def test_offline_queue_blocks_at_the_head(spark):
    q = spark.createDataFrame([(1, "a", 1, 0.0, 0, None), (2, "b", 9, 0.0, 3, 99.0), (3, "c", 5, 0.0, 0, None), (4, "d", 5, 0.0, 5, 0.0), (5, "e", 0, -100000.0, 0, None)], "seq int, pk string, priority int, queued_at double, attempts int, last_attempt double")
    assert {r.seq: r.state for r in replica.queue_state(q, 100).collect()} == {1: "ready", 2: "waiting", 3: "ready", 4: "failed", 5: "expired"}
    assert [r.seq for r in replica.queue_next(q, 100).collect()] == [3, 1] and replica.queue_next(q, 100, blocking=True).count() == 0


def test_validation_of_tagged_items(spark):
    df = tagged(spark, [("a", {"age": 5, "name": "ab"}), ("b", {"age": "x", "name": "é" * 3, "l": [1, 2, 3]}), ("c", {"age": 151})])
    rules = (AttributeSchema("age", "Number", True, 0, 150), AttributeSchema("name", "String", True, min_length=3, max_length=5, pattern="^[a-z]+$", enum=("ab",)), AttributeSchema("l", "List", max_length=2))
    got = {r.pk: r.violations for r in validate.validate(df, rules).collect()}
    assert got == {"a": ["name: min_length"], "b": ["age: not a Number", "name: max_length", "name: pattern", "name: enum", "l: max_length"], "c": ["age: max_value", "name: required"]}


def test_index_leaves_out_what_cannot_be_a_key(spark):
    df = tagged(spark, [("a", {"s": "x"}), ("b", {"s": [1]}), ("c", {"s": None}), ("d", {}), ("e", {"s": True}), ("f", {"s": 5}), ("g", {"s": V.Vector((1.0,))}), ("h", {"s": V.Timestamp(7)})])
    got = {r.base_pk: r.pk for r in index.index_view(ItemTable(df), IndexSpec.global_("i", "s")).collect()}
    assert got == {"a": "x", "e": "true", "f": "5", "h": "7"}


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    """Records of two runs over two files are those of the whole log."""
    rows = [(f"k{i % 5}", i, i % 4 == 2, i * 10) for i in range(40)]
    schema = "pk string, seq long, deleted boolean, v int"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows[:23], rows[23:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            log_ = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = cdc.stream_changes(log_, "pk", ["v"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.seq, r.op, r.pk) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = cdc.changes(spark.createDataFrame(rows, schema), keys=("pk",))
    assert got == sorted((r.seq, r.op, r.pk) for r in want.collect())


def test_retry():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConflictingCommit("later")
        return "done"

    assert Retry.standard(sleep=slept.append).run(flaky) == "done" and len(slept) == 2 and slept[1] > slept[0]
    with pytest.raises(ConflictingCommit):
        Retry.none().run(lambda: (_ for _ in ()).throw(ConflictingCommit("x")))
    calls.clear()
    with pytest.raises(InvalidArgument):
        Retry.fast(sleep=slept.append).run(lambda: (calls.append(1), (_ for _ in ()).throw(InvalidArgument("x"))))
    assert len(calls) == 1
