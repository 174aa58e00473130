"""The PartiQL dialect: what is parsed, what is refused, how results are ordered and limited."""

import pytest

from larderlake.errors import InvalidQuery
from larderlake.functions.values import Number
from larderlake.model import IndexSpec, TableSpec
from larderlake.plans import partiql as P
from larderlake.sources.items import ItemTable


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "x" * 9000, "SELECT * FROM a, b", "SELECT * FROM a JOIN b ON a.x = b.x", "SELECT * FROM a LEFT JOIN b", "SELECT * FROM a GROUP BY x", "SELECT * FROM a HAVING x = 1", "SELECT * FROM a UNION SELECT * FROM b",
        "SELECT * FROM a INTERSECT SELECT * FROM b", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT * FROM (SELECT * FROM a)", "SELECT * FROM a WHERE x = 1 OR y = 2", "SELECT * FROM a WHERE NOT x = 1", "SELECT * FROM a WHERE x NOT IN (1)",
        "SELECT * FROM a WHERE x NOT BETWEEN 1 AND 2", "SELECT * FROM a WHERE x LIKE 'a%'", "SELECT * FROM a WHERE x IS NULL", "SELECT * FROM a WHERE (x = 1)", "SELECT * FROM a WHERE x = y", "SELECT * FROM a WHERE 1 = x",
        "SELECT COUNT(*) FROM a", "SELECT upper(x) FROM a", "SELECT x + 1 FROM a", "SELECT DISTINCT x FROM a", "SELECT TOP 5 x FROM a", "SELECT * FROM a FETCH FIRST 5 ROWS ONLY", "SELECT * FROM a WINDOW w AS ()", "SELECT * FROM a QUALIFY x = 1",
        "SELECT * FROM a LIMIT -1", "SELECT * FROM a LIMIT x", "SELECT * FROM a ORDER BY x, y", "SELECT * FROM a WHERE x IN (SELECT y FROM b)", "SELECT * FROM a; SELECT * FROM b", "SELECT x.y FROM a", "SELECT * FROM a WHERE x.y = 1",
        "INSERT INTO a VALUE {'x': 1}", "INSERT INTO a VALUE {'pk': '1'}, {'pk': '2'}", "INSERT INTO a SELECT * FROM b", "INSERT INTO a VALUE 5", "UPDATE a SET x = 1", "UPDATE a SET x = 1 WHERE y = 2", "UPDATE a SET x = 1 WHERE pk > 'a'",
        "UPDATE a WHERE pk = 'a'", "UPDATE a SET pk = 'b' WHERE pk = 'a'", "DELETE FROM a", "DELETE FROM a WHERE x = 1", "DELETE FROM a WHERE pk IN ('a', 'b')", "DROP TABLE a", "SELECT * FROM a WHERE begins_with(x, 'a')", "SELECT * FROM a t",
    ],
)
def test_refused(text):
    with pytest.raises(InvalidQuery):
        P.parse(text)


def test_parsed():
    s = P.parse("select a, b as c from t.idx where pk = 'x' and sk between '1' and '5' and n >= -2.5 order by sk desc limit 5 offset 2;")
    assert (s.table, s.index, s.columns, s.order_by, s.limit, s.offset) == ("t", "idx", (("a", "a"), ("b", "c")), ("sk", False), 5, 2)
    i = P.parse("INSERT INTO t VALUE {'pk': 'it''s', 'sk': 5, 'n': 1.0, \"l\": [1, 'a', null, {'k': true}]}")
    assert (i.pk, i.sk, i.item) == ("it's", "5", {"n": Number("1.0"), "l": [Number("1"), "a", None, {"k": True}]})
    u = P.parse("UPDATE t SET a = a + 1 - 2, b = 'x' REMOVE c, d WHERE pk = 5 AND b <> 'y'")
    assert (u.pk, [x.kind for x in u.actions], u.condition is not None) == ("5", ["SET", "SET", "REMOVE", "REMOVE"], True)
    d = P.parse("DELETE FROM t WHERE pk = 'a' AND sk = 'b'")
    assert (d.pk, d.sk, d.condition) == ("a", "b", None)


def test_routes():
    assert [P.route(P.parse(f"SELECT * FROM t WHERE {w}")) for w in ("pk = 'a'", "pk IN ('a')", "x = 1", "pk > 'a'")] == ["query", "multiget", "scan", "scan"]


@pytest.fixture(scope="module")
def users(spark):
    rows = [(f"user#{i:03d}", None, f"name{i}", 20 + i, "x" if i % 2 else None) for i in range(20)]
    return ItemTable(spark.createDataFrame(rows, "pk string, sk string, name string, age int, city string"))


def names(users, text, **o):
    return [r[0] for r in P.select(text, {"t": users}, **o).df.collect()]


def test_filter_limit_offset(users):
    assert len(names(users, "SELECT name FROM t WHERE age > 25 AND age < 30")) == 4
    assert names(users, "SELECT name FROM t LIMIT 5 OFFSET 10") == [f"name{i}" for i in range(10, 15)]
    assert names(users, "SELECT name FROM t WHERE age > 25 LIMIT 3") == ["name6", "name7", "name8"]
    assert names(users, "SELECT name FROM t WHERE age > 25 LIMIT 8", limit_before_filter=True) == ["name6", "name7"]
    assert names(users, "SELECT name FROM t LIMIT 0") == []
    assert names(users, "SELECT name FROM t ORDER BY age DESC LIMIT 2") == ["name19", "name18"]


def test_multiget_order(users):
    assert names(users, "SELECT name FROM t WHERE pk IN ('user#005', 'user#001', 'user#005')") == ["name5", "name1"]


def test_absent_is_never_unequal(users):
    assert len(names(users, "SELECT name FROM t WHERE city <> 'y'")) == 10


def test_counts(users):
    p = P.select("SELECT * FROM t WHERE age > 25 LIMIT 3", {"t": users})
    assert (p.count, p.scanned_count) == (3, 14) and p.df.columns == ["name", "age", "city"]


def test_index(spark):
    rows = [(f"o{i}", None, "pending" if i % 2 else "done", 1100 + 100 * i) for i in range(10)]
    t = ItemTable(spark.createDataFrame(rows, "pk string, sk string, status string, at int"), TableSpec(indexes=(IndexSpec.global_("by", "status", "at"),)))
    assert [r[0] for r in P.select("SELECT at FROM o.by WHERE pk = 'pending' AND sk >= 1500 ORDER BY at DESC", {"o": t}).df.collect()] == [2000, 1800, 1600]
    assert P.select("SELECT at FROM o.by WHERE status = 'done'", {"o": t}).count == 5


def test_pushdown(spark, small):
    """The partition predicate reaches the scan on the typed key."""
    from larderlake.operators import read
    from larderlake.sources import catalog

    plan = read.query(catalog.orders(spark, small), read.Query("85")).df._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,85)" in plan


def test_predicates_reach_the_scan(spark, small):
    from larderlake.sources import catalog

    plan = P.select("SELECT p_name FROM t WHERE p_size > 40 AND p_brand IN ('Brand#1', 'Brand#2') AND p_retailprice BETWEEN 900 AND 950", {"t": catalog.parts(spark, small)}).df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for f in ("IsNotNull(p_retailprice)", "GreaterThan(p_size,40)", "In(p_brand, [Brand#1"):  # Spark cuts the list off here
        assert f in pushed, pushed[:400]
    assert "ReadSchema: struct<p_name:string,p_brand:string,p_size:int,p_retailprice:double>" in plan
