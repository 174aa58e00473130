"""Condition and update expressions on typed and schemaless items."""

import pytest

from larderlake.errors import InvalidExpression
from larderlake.functions import values as V
from larderlake.plans import expr as E


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame([("1", "Ann", 30, None), ("2", "Bob", None, True), ("3", None, 5, False)], "pk string, name string, age int, ok boolean")


@pytest.fixture(scope="module")
def tagged(spark):
    items = [("1", {"name": "Ann", "age": 30}), ("2", {"name": "Bob", "ok": True, "gone": None}), ("3", {"age": 5, "b": b"\x01\xff", "at": V.Timestamp(-5), "l": [1, "x"]}), ("4", {"age": V.Number("30.0")})]
    return spark.createDataFrame([(k, {n: V.to_av(v) for n, v in i.items()}) for k, i in items], "pk string, attrs map<string," + V.AV.simpleString() + ">")


def hit(df, text, values=None, names=None, **o):
    return [r.pk for r in df.where(E.condition(text, df, values, names, **o)).orderBy("pk").collect()]


@pytest.mark.parametrize(
    ("text", "values", "want"),
    [
        ("age > :a", {":a": 10}, ["1"]), ("age >= :a OR name = :n", {":a": 30, ":n": "Bob"}, ["1", "2"]), ("NOT age = :a", {":a": 30}, ["3"]), ("attribute_exists(name) AND attribute_not_exists(age)", {}, ["2"]),
        ("begins_with(name, :p)", {":p": "A"}, ["1"]), ("NOT (name = :n AND age = :a)", {":n": "Ann", ":a": 30}, ["2", "3"]), ("#n <> :n", {":n": "Ann"}, ["2"]), ("name = :n or age < :a and attribute_exists(ok)", {":n": "Ann", ":a": 9}, ["1", "3"]),
        ("age <> :s", {":s": "30"}, ["1", "3"]), ("age < :s", {":s": "30"}, []),
    ],
)
def test_typed_conditions(typed, text, values, want):
    assert hit(typed, text, values, {"#n": "name"}) == want


@pytest.mark.parametrize(
    ("text", "values", "want"),
    [
        ("age = :a", {":a": 30}, ["1", "4"]), ("age < :a", {":a": 30}, ["3"]), ("gone = :n", {":n": None}, ["2"]), ("attribute_exists(gone)", {}, ["2"]), ("ok = :t", {":t": True}, ["2"]), ("b < :b", {":b": b"\x02"}, ["3"]),
        ("begins_with(b, :b)", {":b": b"\x01"}, ["3"]), ("at = :t", {":t": V.Timestamp(-5)}, ["3"]), ("l = :l", {":l": [1, "x"]}, ["3"]), ("name > :a", {":a": 5}, []), ("name <> :a", {":a": 5}, ["1", "2"]),
    ],
)
def test_tagged_conditions(tagged, text, values, want):
    assert hit(tagged, text, values) == want


def test_exact_numbers(tagged):
    assert hit(tagged, "age = :a", {":a": 30}, exact=True) == ["1"]


@pytest.mark.parametrize("text", ["", "a", "a =", "a = b c", "a = :x)", "(a = :x", "a = 5", "AND a = :x", "foo(a)", "a = :nope", "begins_with(a)", "a == :x", "a = :x; b", "attribute_exists(:x)"])
def test_rejected_conditions(text):
    with pytest.raises(InvalidExpression):
        E.parse_condition(text, {":x": 1})


@pytest.mark.parametrize("text", ["SET", "SET a", "SET a = ", "FOO a", "SET a = :x,", "REMOVE", "ADD a", "SET a = :x b", "SET :x = a"])
def test_rejected_updates(text):
    with pytest.raises(InvalidExpression):
        E.parse_update(text, {":x": 1})


def test_strict_mode_raises(typed):
    with pytest.raises(Exception, match="no attribute"):
        hit(typed.where("pk = '2'"), "age > :a", {":a": 1}, strict=True)
    assert hit(typed.where("pk = '2'"), "attribute_not_exists(age) OR age > :a", {":a": 1}, strict=True) == ["2"]
    assert hit(typed.where("pk = '2'"), "attribute_exists(age) AND age > :a", {":a": 1}, strict=True) == []


def test_strict_order_between_kinds(tagged):
    with pytest.raises(Exception, match="no order"):
        hit(tagged.where("pk = '1'"), "name > :a", {":a": 1}, strict=True)


def apply(spark, item, text, values=None, names=None):
    df = spark.createDataFrame([({k: V.to_av(v) for k, v in item.items()},)], "attrs map<string," + V.AV.simpleString() + ">")
    return V.item(df.select(E.Tagged("attrs", True).apply(E.parse_update(text, values, names)).alias("attrs")).first().attrs, exact=True)


def test_updates(spark):
    n = V.Number
    assert apply(spark, {"a": 1}, "SET a = a + :x, b = a - :x, #c = :s", {":x": 50, ":s": "t"}, {"#c": "c"}) == {"a": n("51"), "b": n("1"), "c": "t"}
    assert apply(spark, {"a": 100.5}, "SET a = a + :x - :x - :x", {":x": 0.5}) == {"a": n("100")}
    assert apply(spark, {"a": 1, "b": 2}, "REMOVE a, nothing") == {"b": n("2")}
    assert apply(spark, {"a": 1}, "ADD a :x, b :x", {":x": 2}) == {"a": n("3"), "b": n("2")}
    assert apply(spark, {}, "SET a = :l REMOVE b ADD c :x", {":l": [1, {"k": None}], ":x": 1}) == {"a": [n("1"), {"k": None}], "c": n("1")}
    assert apply(spark, {"a": 1e21}, "SET a = a + :x", {":x": 0}) == {"a": n("1000000000000000000000")}
    with pytest.raises(InvalidExpression):
        apply(spark, {}, "DELETE a :x", {":x": 1})
    with pytest.raises(Exception, match="no attribute"):
        apply(spark, {}, "SET a = b", {})


def test_number_text():
    assert [V.number_text(x) for x in (1, -2.5, 150.0, 1e21, 1e-7, 0.1)] == ["1", "-2.5", "150", "1" + "0" * 21, "0.0000001", "0.1"]


def test_values_round_trip():
    for x in (None, True, 5, -2.5, "s", b"\x00\xff", V.Timestamp(-1000), V.Vector((1.5, -2.0)), [1, [None, {"a": b"x"}]], {"k": {"z": V.Timestamp(3)}}):
        row = dict(zip([f.name for f in V.AV.fields], V.to_av(x)))
        assert V.from_av(row) == x
