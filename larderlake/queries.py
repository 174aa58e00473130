"""Every operator as a query over whole test tables, with DuckDB SQL where SQL can express it.

A query is a function of (spark, folder). Names follow the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored_queries
from .functions import values as V
from .model import AttributeSchema, IndexSpec, TableSpec
from .operators import apps, index, log, read, replica, ttl, validate, write
from .operators.read import Query, Scan
from .plans import expr, partiql
from .sources import catalog as C
from .sources import io as IO
from .sources.items import ItemTable
from .streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The item tables in SQL
ORDERS = "(SELECT CAST(o_custkey AS VARCHAR) AS pk, CAST(o_orderkey AS VARCHAR) AS sk, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)"
BY_ID = "(SELECT CAST(o_orderkey AS VARCHAR) AS pk, CAST(NULL AS VARCHAR) AS sk, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)"
CUSTOMERS = "(SELECT CAST(c_custkey AS VARCHAR) AS pk, CAST(NULL AS VARCHAR) AS sk, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"
PARTS = "(SELECT CAST(p_partkey AS VARCHAR) AS pk, CAST(NULL AS VARCHAR) AS sk, p_name, p_brand, p_type, p_size, p_retailprice FROM part)"
LINE_LOG = "(SELECT CAST(l_orderkey AS VARCHAR) AS pk, CAST(l_linenumber AS VARCHAR) AS sk, l_partkey * 100000 + l_suppkey AS seq, l_returnflag = 'R' AS deleted, l_quantity, l_extendedprice, l_linestatus FROM lineitem)"
NEWEST = f"(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY pk, sk ORDER BY seq DESC) AS r FROM {LINE_LOG}) WHERE r = 1)"
EVENT_LOG = "(SELECT CAST(user_id AS VARCHAR) AS pk, CAST(NULL AS VARCHAR) AS sk, event_id AS seq, event_type = 'error' AS deleted, event_type, value FROM events)"


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


# Scans

add("scan_full", lambda s, d: read.scan(C.orders(s, d)).df, f"SELECT * FROM {ORDERS}")
add("scan_limit", lambda s, d: read.scan(C.orders(s, d), Scan().limit(25)).df, f"SELECT * FROM {ORDERS} ORDER BY pk, sk LIMIT 25")
add("scan_page", lambda s, d: read.scan(C.orders(s, d), Scan().start_after("85", "5").limit(10)).df, f"SELECT * FROM {ORDERS} WHERE pk > '85' OR (pk = '85' AND sk > '5') ORDER BY pk, sk LIMIT 10")
add("scan_page_encoded", lambda s, d: read.scan(C.orders_by_id(s, d, TableSpec(key_order="encoded")), Scan().start_after("95").limit(10)).df,
    f"SELECT * FROM {BY_ID} WHERE strlen(pk) > 2 OR (strlen(pk) = 2 AND pk > '95') ORDER BY strlen(pk), pk LIMIT 10")
add("scan_segment", lambda s, d: read.scan(C.orders(s, d), Scan().segment(1, 4)).df, f"SELECT * FROM {ORDERS} WHERE CAST({stored_queries.CRC} AS BIGINT) % 256 % 4 = 1")


def _with_metadata(s: SparkSession, d: str) -> ItemTable:
    t = C.suppliers(s, d)
    meta = t.df.limit(1).select(F.lit("_sync#peer").alias("pk"), "sk", *t.columns[2:])
    return ItemTable(t.df.unionByName(meta))


add("scan_with_keys", lambda s, d: read.scan_with_keys(_with_metadata(s, d)), "SELECT CAST(s_suppkey AS VARCHAR) AS pk, CAST(NULL AS VARCHAR) AS sk, s_name, s_nationkey, s_acctbal FROM supplier")
add("scan_ordered", lambda s, d: read.scan(C.suppliers(s, d), ordered=True).df, "SELECT CAST(s_suppkey AS VARCHAR) AS pk, CAST(NULL AS VARCHAR) AS sk, s_name, s_nationkey, s_acctbal FROM supplier")
add("src_memory", lambda s, d: read.get(ItemTable(s.createDataFrame([("user#1", None, "Ann", 30), ("user#2", None, "Bo", 41)], "pk string, sk string, name string, age int")), "user#2"),
    "SELECT 'user#2' AS pk, CAST(NULL AS VARCHAR) AS sk, 'Bo' AS name, CAST(41 AS INTEGER) AS age")
add("sink_jsonl", lambda s, d: IO.json_lines(C.raw(s, d, "nation")), "SELECT to_json(n)::VARCHAR AS value FROM nation n")
add("json_props", lambda s, d: C.raw(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")

# Point reads and partition queries

add("get", lambda s, d: read.get(C.customers(s, d), "7"), f"SELECT * FROM {CUSTOMERS} WHERE pk = '7'")
add("get_missing_sk", lambda s, d: read.get(C.orders(s, d), "85"), f"SELECT * FROM {ORDERS} WHERE pk = '85' AND sk IS NULL")
for _name, _q, _w in (
    ("query_pk", Query("85"), "TRUE"), ("query_sk_eq", Query("85").sk_eq("5277"), "sk = '5277'"), ("query_sk_lt", Query("85").sk_lt("3"), "sk < '3'"), ("query_sk_lte", Query("85").sk_lte("5277"), "sk <= '5277'"),
    ("query_sk_gt", Query("85").sk_gt("5"), "sk > '5'"), ("query_sk_gte", Query("85").sk_gte("5277"), "sk >= '5277'"), ("query_sk_between", Query("85").sk_between("1", "5"), "sk BETWEEN '1' AND '5'"),
    ("query_sk_begins_with", Query("85").sk_begins_with("1"), "starts_with(sk, '1')"), ("query_last_cond_wins", Query("85").sk_eq("none").sk_gt("2"), "sk > '2'"),
):
    add(_name, lambda s, d, q=_q: read.query(C.orders(s, d), q).df, f"SELECT * FROM {ORDERS} WHERE pk = '85' AND {_w}")
add("query_no_sk", lambda s, d: read.query(ItemTable(C.orders(s, d).df.select("pk", "sk", "o_totalprice").unionByName(C.customers(s, d).df.select("pk", "sk", F.col("c_acctbal").alias("o_totalprice")))), Query("85").sk_gte("")).df,
    f"SELECT pk, sk, o_totalprice FROM {ORDERS} WHERE pk = '85'")
add("query_reverse", lambda s, d: read.query(C.orders(s, d), Query("85").forward(False).limit(3)).df, f"SELECT * FROM {ORDERS} WHERE pk = '85' ORDER BY sk DESC LIMIT 3")
add("query_reverse_encoded", lambda s, d: read.query(C.orders(s, d, TableSpec(key_order="encoded")), Query("85").forward(False).limit(3)).df, f"SELECT * FROM {ORDERS} WHERE pk = '85' ORDER BY strlen(sk) DESC, sk DESC LIMIT 3")
add("query_limit", lambda s, d: read.query(C.orders(s, d), Query("85").limit(4)).df, f"SELECT * FROM {ORDERS} WHERE pk = '85' ORDER BY sk LIMIT 4")
add("query_limit_zero", lambda s, d: read.query(C.orders(s, d), Query("85").limit(0)).df, f"SELECT * FROM {ORDERS} WHERE FALSE")
add("query_page", lambda s, d: read.query(C.orders(s, d), Query("85").start_after("85", "2").limit(3)).df, f"SELECT * FROM {ORDERS} WHERE pk = '85' AND sk > '2' ORDER BY sk LIMIT 3")
add("query_page_reverse", lambda s, d: read.query(C.orders(s, d), Query("85").start_after("85", "6").forward(False).limit(3)).df, f"SELECT * FROM {ORDERS} WHERE pk = '85' AND sk < '6' ORDER BY sk DESC LIMIT 3")
add("query_index", lambda s, d: read.query(C.customers(s, d), Query("BUILDING").sk_gte(5000.0).index("by_segment").limit(20)).df,
    f"SELECT c_mktsegment AS pk, c_acctbal AS sk, pk AS base_pk, sk AS base_sk, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {CUSTOMERS} WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 5000 ORDER BY c_acctbal, base_pk LIMIT 20")
add("query_counts", lambda s, d: log.newest(C.line_log(s, d).where("pk = '85'")).agg(F.count_if(~F.col("deleted")).alias("n"), F.count("*").alias("scanned")), f"SELECT count(*) FILTER (NOT deleted) AS n, count(*) AS scanned FROM {NEWEST} WHERE pk = '85'")
add("query_composite", lambda s, d: read.query(C.lines(s, d), Query("7")).df.select("pk", "sk", "l_quantity", "l_returnflag"),
    "SELECT CAST(l_orderkey AS VARCHAR) AS pk, concat_ws('#', l_linenumber, l_partkey, l_suppkey) AS sk, l_quantity, l_returnflag FROM lineitem WHERE l_orderkey = 7")

# Projections


def sql(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """A PartiQL SELECT over the item tables."""

    def run(s: SparkSession, d: str) -> DataFrame:
        tables = {"orders": C.orders, "orders_by_id": C.orders_by_id, "customers": C.customers, "parts": C.parts}
        select = partiql.parse(text, options.get("extended", False))
        return partiql.run_select(select, tables[select.table](s, d), **{k: v for k, v in options.items() if k != "extended"}).df

    return run


add("proj_all", sql("SELECT * FROM parts WHERE p_size = 11"), f"SELECT p_name, p_brand, p_type, p_size, p_retailprice FROM {PARTS} WHERE p_size = 11")
add("proj_attrs", sql("SELECT p_name, p_size FROM parts"), f"SELECT p_name, p_size FROM {PARTS}")
add("proj_alias", sql("SELECT p_name AS title, p_size AS size FROM parts WHERE p_size < 9"), f"SELECT p_name AS title, p_size AS size FROM {PARTS} WHERE p_size < 9")
add("proj_index", lambda s, d: index.index_view(C.customers(s, d), C.customers(s, d).spec.index("segment_keys")), f"SELECT c_mktsegment AS pk, c_acctbal AS sk, pk AS base_pk, sk AS base_sk, c_acctbal, c_mktsegment FROM {CUSTOMERS}")

# Predicates of a SELECT, with an attribute that some items lack


def sparse(s: SparkSession, d: str) -> DataFrame:
    return C.parts(s, d).df.select("pk", "sk", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("brand"), F.col("p_retailprice").alias("price"))


SPARSE = f"(SELECT pk, sk, CASE WHEN p_size % 3 <> 0 THEN p_size END AS size, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand, p_retailprice AS price FROM {PARTS})"


def where(text: str, **o) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: partiql.select(f"SELECT pk, size, brand FROM t WHERE {text}", {"t": sparse(s, d)}, **o).df


for _name, _w in (
    ("pred_eq", "size = 11"), ("pred_ne", "brand <> 'Brand#7'"), ("pred_lt", "size < 11"), ("pred_lte", "size <= 11"), ("pred_gt", "price > 1000.5"), ("pred_gte", "size >= 40"), ("pred_in", "brand IN ('Brand#1', 'Brand#2')"),
    ("pred_between", "size BETWEEN 10 AND 20"), ("pred_and", "size > 5 AND brand = 'Brand#3' AND price < 1050"), ("pred_negative", "size > -3"),
):
    add(_name, where(_w), f"SELECT pk, size, brand FROM {SPARSE} WHERE {_w}")
add("pred_type_mismatch", where("brand > 5"), f"SELECT pk, size, brand FROM {SPARSE} WHERE FALSE")
add("pred_null", lambda s, d: partiql.select("SELECT pk FROM t WHERE size = NULL", {"t": sparse(s, d).withColumn("__nulls", F.when(F.col("size").isNull() & (F.col("price") > 1000), F.array(F.lit("size"))))}).df, f"SELECT pk FROM {SPARSE} WHERE size IS NULL AND price > 1000")
add("ext_or_not", where("(size < 5 OR brand = 'Brand#1') AND NOT begins_with(brand, 'Brand#2')", extended=True), f"SELECT pk, size, brand FROM {SPARSE} WHERE (size < 5 OR brand = 'Brand#1') AND NOT starts_with(brand, 'Brand#2')")

# Statements

add("sql_query", sql("SELECT o_totalprice FROM orders WHERE pk = '85' AND sk > '5' ORDER BY sk DESC LIMIT 5"), f"SELECT o_totalprice FROM {ORDERS} WHERE pk = '85' AND sk > '5' ORDER BY sk DESC LIMIT 5")
add("sql_query_filter", sql("SELECT * FROM orders WHERE pk = 85 AND o_totalprice > 100000", keys_too=True), f"SELECT * FROM {ORDERS} WHERE pk = '85' AND o_totalprice > 100000")
add("sql_index", sql("SELECT c_name, c_acctbal FROM customers.by_segment WHERE pk = 'BUILDING' AND sk > 9000"), f"SELECT c_name, c_acctbal FROM {CUSTOMERS} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
add("sql_index_by_attribute", sql("SELECT c_name FROM customers.by_segment WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 100 AND 900"), f"SELECT c_name FROM {CUSTOMERS} WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 100 AND 900")
add("sql_multiget", sql("SELECT * FROM orders WHERE pk IN ('85', '7', '85', '12') AND sk > '3'", keys_too=True), f"SELECT * FROM {ORDERS} WHERE pk IN ('85', '7', '12') AND sk > '3'")
add("sql_scan_filter_first", sql("SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F' LIMIT 10 OFFSET 5"), f"SELECT o_totalprice FROM {ORDERS} WHERE o_orderstatus = 'F' ORDER BY pk, sk LIMIT 10 OFFSET 5")
add("sql_scan_limit_first", sql("SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F' LIMIT 100 OFFSET 5", limit_before_filter=True), f"SELECT o_totalprice FROM (SELECT * FROM {ORDERS} ORDER BY pk, sk LIMIT 100 OFFSET 5) WHERE o_orderstatus = 'F'")
add("sql_order_by", sql("SELECT p_name, p_retailprice FROM parts WHERE p_size > 45 ORDER BY p_retailprice DESC LIMIT 15"), f"SELECT p_name, p_retailprice FROM {PARTS} WHERE p_size > 45 ORDER BY p_retailprice DESC, pk DESC LIMIT 15")
add("sql_limit_offset", sql("SELECT p_name FROM parts LIMIT 5 OFFSET 10"), f"SELECT p_name FROM {PARTS} ORDER BY pk LIMIT 5 OFFSET 10")
add("sql_sk_between", sql("SELECT sk FROM orders WHERE pk = '85' AND sk BETWEEN '1' AND '6'"), f"SELECT sk FROM {ORDERS} WHERE pk = '85' AND sk BETWEEN '1' AND '6'")
add("sql_sk_in", sql("SELECT sk FROM orders WHERE pk = '85' AND sk IN ('5277', '1996', '0')"), f"SELECT sk FROM {ORDERS} WHERE pk = '85' AND sk IN ('5277', '1996', '0')")
add("sql_dup_sk", sql("SELECT sk FROM orders WHERE pk = '85' AND sk >= '1' AND sk < '5'"), f"SELECT sk FROM {ORDERS} WHERE pk = '85' AND sk >= '1' AND sk < '5'")


def dml(text: str, table: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """A statement's effect on a typed table: the live view after it."""

    def run(s: SparkSession, d: str) -> DataFrame:
        t, x = table(s, d).df, partiql.parse(text)
        key = (F.col("pk") == x.pk) & F.col("sk").eqNullSafe(F.lit(x.sk))
        if isinstance(x, partiql.Insert):
            row = s.createDataFrame([(x.pk, x.sk)], "pk string, sk string")
            item = {k: V.plain_number(v.text) if isinstance(v, V.Number) else v for k, v in x.item.items()}
            return write.put(t, row.select("pk", "sk", *[F.lit(item.get(c)).cast(t.schema[c].dataType).alias(c) for c in t.columns[2:]]))
        holds = partiql.compile_where(x.condition, t) if x.condition is not None else F.lit(True)
        if isinstance(x, partiql.Delete):
            return t.where(~(key & holds))
        new = expr.Typed(t).apply(list(x.actions))
        return t.select(*[F.when(key & holds, c).otherwise(F.col(n)).alias(n) for n, c in new.items()])

    return run


add("sql_insert", dml("INSERT INTO t VALUE {'pk': '1000001', 'c_name': 'It''s new', 'c_acctbal': -12.5, 'c_nationkey': 3}", C.customers), f"SELECT * FROM {CUSTOMERS} UNION ALL SELECT '1000001', NULL, 'It''s new', 3, -12.5, NULL")
add("sql_update_set", dml("UPDATE t SET c_acctbal = c_acctbal - 100, c_name = 'X' WHERE pk = '7'", C.customers), f"SELECT pk, sk, CASE WHEN pk = '7' THEN 'X' ELSE c_name END AS c_name, c_nationkey, CASE WHEN pk = '7' THEN c_acctbal - 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM {CUSTOMERS}")
add("sql_update_remove", dml("UPDATE t REMOVE c_name, c_acctbal WHERE pk = '7'", C.customers), f"SELECT pk, sk, CASE WHEN pk <> '7' THEN c_name END AS c_name, c_nationkey, CASE WHEN pk <> '7' THEN c_acctbal END AS c_acctbal, c_mktsegment FROM {CUSTOMERS}")
add("sql_update_if", dml("UPDATE t SET c_name = 'X' WHERE pk = '7' AND c_acctbal > 1000000", C.customers), f"SELECT * FROM {CUSTOMERS}")
add("sql_delete", dml("DELETE FROM t WHERE pk = '7'", C.customers), f"SELECT * FROM {CUSTOMERS} WHERE pk <> '7'")

# Conditions and updates


def holds(text: str, **values) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: (t := sparse(s, d)).where(expr.condition(text, t, {f":{k}": v for k, v in values.items()}, {"#s": "size"})).select("pk", "size", "brand")


for _name, _f, _w in (
    ("cond_cmp", holds("#s >= :a AND price <> :b", a=20, b=1000.0), "size >= 20 AND price <> 1000.0"), ("cond_bool", holds("NOT size < :a AND (brand = :b OR size = :c)", a=10, b="Brand#1", c=11), "NOT size < 10 AND (brand = 'Brand#1' OR size = 11)"),
    ("cond_exists", holds("attribute_exists(size) AND attribute_not_exists(brand)"), "size IS NOT NULL AND brand IS NULL"), ("cond_begins_with", holds("begins_with(brand, :p)", p="Brand#1"), "starts_with(brand, 'Brand#1')"),
    ("cond_missing", holds("NOT (size = :a)", a=11), "size IS NOT NULL AND size <> 11"), ("cond_names", holds("#s = :a", a=11), "size = 11"),
):
    add(_name, _f, f"SELECT pk, size, brand FROM {SPARSE} WHERE {_w}")


def updated(text: str, **values) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: write.update(sparse(s, d), F.col("price") > 1000, text, {f":{k}": v for k, v in values.items()})


for _name, _f, _set in (
    ("upd_set", updated("SET size = :a, brand = :b, price = price - :c + :c", a=5, b="new", c=1.0), "5 AS size, 'new' AS brand, price - 1.0 + 1.0 AS price"), ("upd_arith", updated("SET price = price - :c - :c", c=2.0), "size, brand, price - 2.0 - 2.0 AS price"),
    ("upd_remove", updated("REMOVE size, brand"), "NULL AS size, NULL AS brand, price"), ("upd_add", updated("ADD size :a", a=7), "coalesce(size, 0) + 7 AS size, brand, price"),
):
    add(_name, _f, f"SELECT pk, sk, size, brand, price FROM {SPARSE} WHERE price <= 1000 UNION ALL SELECT pk, sk, {_set} FROM {SPARSE} WHERE price > 1000")


def _new_keys(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("7", None), ("none", None)], "pk string, sk string")


add("upd_upsert", lambda s, d: write.upsert(C.customers(s, d).df, _new_keys(s), "SET c_name = :n ADD c_acctbal :x", {":n": "N", ":x": 5.0}),
    f"SELECT pk, sk, CASE WHEN pk = '7' THEN 'N' ELSE c_name END AS c_name, c_nationkey, CASE WHEN pk = '7' THEN c_acctbal + 5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM {CUSTOMERS} UNION ALL SELECT 'none', NULL, 'N', NULL, 5.0, NULL")


def _changed(s: SparkSession, d: str) -> DataFrame:
    """New items for every seventh customer, and as many that weren't there."""
    t = C.customers(s, d).df
    new = t.where("try_cast(pk as int) % 7 = 0").withColumn("c_name", F.concat(F.lit("new "), "c_name"))
    return new.unionByName(new.withColumn("pk", F.concat(F.lit("x"), "pk")))


CHANGED = f"(SELECT * REPLACE ('new ' || c_name AS c_name) FROM {CUSTOMERS} WHERE CAST(pk AS INT) % 7 = 0 UNION ALL SELECT * REPLACE ('x' || pk AS pk, 'new ' || c_name AS c_name) FROM {CUSTOMERS} WHERE CAST(pk AS INT) % 7 = 0)"
add("put", lambda s, d: write.put(C.customers(s, d).df, _changed(s, d)), f"SELECT * FROM {CUSTOMERS} WHERE pk NOT IN (SELECT pk FROM {CHANGED}) UNION ALL SELECT * FROM {CHANGED}")
add("delete", lambda s, d: write.delete(C.customers(s, d).df, _changed(s, d)), f"SELECT * FROM {CUSTOMERS} WHERE CAST(pk AS INT) % 7 <> 0")
add("put_if", lambda s, d: write.put_if(C.customers(s, d).df, _changed(s, d), "attribute_not_exists(c_name) OR c_acctbal > :b", {":b": 5000})[0],
    f"WITH good AS (SELECT n.* FROM {CHANGED} n LEFT JOIN {CUSTOMERS} o ON n.pk = o.pk WHERE o.pk IS NULL OR o.c_acctbal > 5000) SELECT * FROM {CUSTOMERS} WHERE pk NOT IN (SELECT pk FROM good) UNION ALL SELECT * FROM good")
add("delete_if", lambda s, d: write.delete_if(C.customers(s, d).df, _changed(s, d), "c_acctbal <= :b", {":b": 5000})[0], f"SELECT * FROM {CUSTOMERS} WHERE NOT (CAST(pk AS INT) % 7 = 0 AND c_acctbal <= 5000)")
add("update_if", lambda s, d: write.update_if(C.customers(s, d).df, _changed(s, d), "SET c_name = :n", "c_acctbal > :b", {":b": 5000, ":n": "rich"})[0], f"SELECT * REPLACE (CASE WHEN CAST(pk AS INT) % 7 = 0 AND c_acctbal > 5000 THEN 'rich' ELSE c_name END AS c_name) FROM {CUSTOMERS}")

# Indexes

add("lsi_query", lambda s, d: read.query(C.orders(s, d), Query("85").sk_gte(100000.0).index("by_price")).df.select("pk", "sk", "base_sk", "o_orderstatus"), f"SELECT pk, o_totalprice AS sk, sk AS base_sk, o_orderstatus FROM {ORDERS} WHERE pk = '85' AND o_totalprice >= 100000")
add("lsi_include", lambda s, d: index.index_view(C.orders(s, d), C.orders(s, d).spec.index("by_date")), f"SELECT pk, o_orderdate AS sk, pk AS base_pk, sk AS base_sk, o_orderstatus, o_orderdate FROM {ORDERS}")
add("gsi_query", lambda s, d: read.query(C.customers(s, d), Query("MACHINERY").sk_gt(5000.0).index("by_segment")).df.select("base_pk", "sk", "c_name"), f"SELECT pk AS base_pk, c_acctbal AS sk, c_name FROM {CUSTOMERS} WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000")
add("gsi_include", lambda s, d: index.index_view(C.customers(s, d), C.customers(s, d).spec.index("segment_names")), f"SELECT c_mktsegment AS pk, c_acctbal AS sk, pk AS base_pk, sk AS base_sk, c_name, c_acctbal, c_mktsegment FROM {CUSTOMERS}")
add("gsi_sparse", lambda s, d: index.index_view(ItemTable(sparse(s, d)), IndexSpec.global_("i", "brand", "size")), f"SELECT brand AS pk, size AS sk, pk AS base_pk, sk AS base_sk, size, brand, price FROM {SPARSE} WHERE brand IS NOT NULL AND size IS NOT NULL")
add("gsi_sk_equal", lambda s, d: read.query(ItemTable(sparse(s, d), TableSpec(indexes=(IndexSpec.global_("i", "brand", "size"),))), Query("Brand#1").sk_eq(11).index("i")).df.select("base_pk", "sk"), f"SELECT pk AS base_pk, size AS sk FROM {SPARSE} WHERE brand = 'Brand#1' AND size = 11")
add("index_key_text", lambda s, d: index.index_view(C.customers(s, d), IndexSpec.global_("i", "c_nationkey", "c_nationkey"), text=True).select("pk", "sk", "base_pk"), f"SELECT CAST(c_nationkey AS VARCHAR) AS pk, CAST(c_nationkey AS VARCHAR) AS sk, pk AS base_pk FROM {CUSTOMERS}")
add("index_over_log", lambda s, d: index.index_view(ItemTable(C.line_log(s, d)), IndexSpec.local("i", "l_quantity")).select("pk", "sk", "base_sk", "seq"), f"SELECT pk, l_quantity AS sk, sk AS base_sk, seq FROM {LINE_LOG}")
add("index_live", lambda s, d: index.index_view(ItemTable(log.live(C.line_log(s, d))), IndexSpec.local("i", "l_quantity")).select("pk", "sk", "base_sk"), f"SELECT pk, l_quantity AS sk, sk AS base_sk FROM {NEWEST} WHERE NOT deleted")

# Many keys, transactions

WANTED = [("85", "5277"), ("85", "1996"), ("7", "14413"), ("none", None), ("7", "14413")]
WANTED_SQL = "(SELECT * FROM (VALUES (0, '85', '5277'), (1, '85', '1996'), (2, '7', '14413'), (3, 'none', NULL), (4, '7', '14413')) v(\"at\", pk, sk))"
add("batch_get", lambda s, d: read.batch_get(C.orders(s, d), WANTED), f"SELECT o.* FROM {ORDERS} o WHERE EXISTS (SELECT 1 FROM {WANTED_SQL} w WHERE w.pk = o.pk AND w.sk = o.sk)")
add("batch_get_table", lambda s, d: read.batch_get(C.customers(s, d), C.orders(s, d).df.where("o_totalprice > 400000").select("pk", F.lit(None).cast("string").alias("sk"))), f"SELECT * FROM {CUSTOMERS} WHERE pk IN (SELECT pk FROM {ORDERS} WHERE o_totalprice > 400000)")
add("txn_get", lambda s, d: read.txn_get(C.orders(s, d), WANTED), f"SELECT w.\"at\", w.pk, w.sk, o.pk IS NOT NULL AS found, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {WANTED_SQL} w LEFT JOIN {ORDERS} o ON w.pk = o.pk AND w.sk IS NOT DISTINCT FROM o.sk")


def _operations(s: SparkSession, d: str) -> DataFrame:
    t = C.customers(s, d).df
    n = F.col("pk").cast("long")
    put = t.where("try_cast(pk as int) % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).select("*", F.lit("PUT").alias("op"), (n * 2).alias("seq"))
    gone = t.where("try_cast(pk as int) % 10 = 0").select("*", F.lit("DELETE").alias("op"), (n * 2 + 1).alias("seq"))
    return put.unionByName(gone)


add("batch_write", lambda s, d: write.apply_operations(C.customers(s, d).df, _operations(s, d)), f"SELECT * REPLACE (CASE WHEN CAST(pk AS INT) % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal) FROM {CUSTOMERS} WHERE CAST(pk AS INT) % 10 <> 0")
add("batch_write_count", lambda s, d: _operations(s, d).groupBy("op").agg(F.count("*").alias("n")), f"SELECT 'PUT' AS op, count(*) AS n FROM {CUSTOMERS} WHERE CAST(pk AS INT) % 5 = 0 UNION ALL SELECT 'DELETE', count(*) FROM {CUSTOMERS} WHERE CAST(pk AS INT) % 10 = 0")


def _transaction(s: SparkSession, d: str) -> DataFrame:
    t = C.customers(s, d).df
    some = t.where("c_mktsegment = 'BUILDING'")
    return write.transact(
        t, puts=some.where("try_cast(pk as int) % 3 = 0").withColumn("c_nationkey", F.lit(99)), deletes=some.where("try_cast(pk as int) % 3 = 1").select("pk", "sk"),
        updates=[(some.where("try_cast(pk as int) % 3 = 2").select("pk", "sk"), "SET c_acctbal = c_acctbal + :x", {":x": 10.0})], checks=[(some.select("pk", "sk"), "c_mktsegment = :m", {":m": "BUILDING"})],
    )


add("txn_write", _transaction,
    f"""SELECT * FROM {CUSTOMERS} WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT * REPLACE (CASE WHEN CAST(pk AS INT) % 3 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey, CASE WHEN CAST(pk AS INT) % 3 = 2 THEN c_acctbal + 10.0 ELSE c_acctbal END AS c_acctbal)
    FROM {CUSTOMERS} WHERE c_mktsegment = 'BUILDING' AND CAST(pk AS INT) % 3 <> 1""")  # fmt: skip

# TTL and validation

NOW = 904608000


def _expiring(s: SparkSession, d: str) -> DataFrame:
    return C.orders(s, d).df.withColumn("expires", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 31536000))


EXPIRING = f"(SELECT *, CAST(epoch(o_orderdate) AS BIGINT) + 31536000 AS expires FROM {ORDERS})"
add("ttl_filter", lambda s, d: ttl.live(_expiring(s, d), "expires", NOW), f"SELECT * FROM {EXPIRING} WHERE NOT ({NOW} > expires)")
add("ttl_text", lambda s, d: ttl.live(_expiring(s, d).withColumn("expires", F.when(F.col("o_orderstatus") == "F", "never").otherwise(F.col("expires").cast("string"))), "expires", NOW).select("pk", "sk", "expires"),
    f"SELECT pk, sk, CASE WHEN o_orderstatus = 'F' THEN 'never' ELSE CAST(expires AS VARCHAR) END AS expires FROM {EXPIRING} WHERE o_orderstatus = 'F' OR NOT ({NOW} > expires)")
add("ttl_timestamp", lambda s, d: ttl.live(C.orders(s, d).df, "o_orderdate", NOW).select("pk", "sk"), f"SELECT pk, sk FROM {ORDERS} WHERE NOT ({NOW} > epoch(o_orderdate))")
add("ttl_purge", lambda s, d: log.live((t := _expiring(s, d)).withColumn("seq", F.lit(1).cast("long")).withColumn("deleted", F.lit(False)).unionByName(log.purge(t, "expires", NOW, F.lit(2).cast("long")))).drop("seq"), f"SELECT * FROM {EXPIRING} WHERE NOT ({NOW} > expires)")


def _violating(*rules: AttributeSchema) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: validate.validate(sparse(s, d), rules).select("pk", F.array_join("violations", "; ").alias("broken")).where("broken <> ''")


for _name, _r, _w, _m in (
    ("val_required", AttributeSchema("size", required=True), "size IS NULL", "size: required"), ("val_type", AttributeSchema("brand", "Number"), "brand IS NOT NULL", "brand: not a Number"), ("val_min", AttributeSchema("size", "Number", min_value=10), "size < 10", "size: min_value"),
    ("val_max", AttributeSchema("price", max_value=1000), "price > 1000", "price: max_value"), ("val_minlen", AttributeSchema("brand", min_length=8), "strlen(brand) < 8", "brand: min_length"), ("val_maxlen", AttributeSchema("brand", max_length=7), "strlen(brand) > 7", "brand: max_length"),
    ("val_pattern", AttributeSchema("brand", pattern="#1[0-9]$"), "NOT regexp_matches(brand, '#1[0-9]$')", "brand: pattern"), ("val_enum", AttributeSchema("brand", enum=("Brand#1", "Brand#2")), "brand NOT IN ('Brand#1', 'Brand#2')", "brand: enum"),
):
    add(_name, _violating(_r), f"SELECT pk, '{_m}' AS broken FROM {SPARSE} WHERE {_w}")
add("val_all", _violating(AttributeSchema("size", "Number", True, 10, 40), AttributeSchema("brand", "String", pattern="#1")),
    f"SELECT * FROM (SELECT pk, concat_ws('; ', CASE WHEN size IS NULL THEN 'size: required' END, CASE WHEN size < 10 THEN 'size: min_value' END, CASE WHEN size > 40 THEN 'size: max_value' END, CASE WHEN NOT regexp_matches(brand, '#1') THEN 'brand: pattern' END) AS broken FROM {SPARSE}) WHERE broken <> ''")

# Change feeds

FEED = f"""(SELECT seq, CASE WHEN deleted AND p THEN 'REMOVE' WHEN deleted THEN NULL WHEN p THEN 'MODIFY' ELSE 'INSERT' END AS op, pk, CASE WHEN p THEN o_type END AS old_type, CASE WHEN p THEN o_value END AS old_value,
    CASE WHEN NOT deleted THEN event_type END AS new_type, CASE WHEN NOT deleted THEN value END AS new_value
    FROM (SELECT *, coalesce(NOT lag(deleted) OVER w, FALSE) AS p, lag(event_type) OVER w AS o_type, lag(value) OVER w AS o_value FROM {EVENT_LOG} WINDOW w AS (PARTITION BY pk ORDER BY seq)))"""


def _feed(s: SparkSession, d: str, view: str = "NEW_AND_OLD_IMAGES") -> DataFrame:
    f = cdc.changes(C.event_log(s, d), view)
    return f.select("seq", "op", "pk", F.col("old_image.event_type").alias("old_type"), F.col("old_image.value").alias("old_value"), F.col("new_image.event_type").alias("new_type"), F.col("new_image.value").alias("new_value"))


add("cdc_images", _feed, f"SELECT * FROM {FEED} WHERE op IS NOT NULL")
for _op in ("insert", "modify", "remove"):
    add(f"cdc_{_op}", lambda s, d, op=_op.upper(): _feed(s, d).where(F.col("op") == op), f"SELECT * FROM {FEED} WHERE op = '{_op.upper()}'")
add("cdc_ops", lambda s, d: _feed(s, d).groupBy("op").agg(F.count("*").alias("n")), f"SELECT op, count(*) AS n FROM {FEED} WHERE op IS NOT NULL GROUP BY op")
add("cdc_view_keys", lambda s, d: _feed(s, d, "KEYS_ONLY"), f"SELECT seq, op, pk, CAST(NULL AS VARCHAR) AS old_type, CAST(NULL AS DOUBLE) AS old_value, CAST(NULL AS VARCHAR) AS new_type, CAST(NULL AS DOUBLE) AS new_value FROM {FEED} WHERE op IS NOT NULL")
add("cdc_view_new", lambda s, d: _feed(s, d, "NEW_IMAGE"), f"SELECT seq, op, pk, CAST(NULL AS VARCHAR) AS old_type, CAST(NULL AS DOUBLE) AS old_value, new_type, new_value FROM {FEED} WHERE op IS NOT NULL")
add("cdc_view_old", lambda s, d: _feed(s, d, "OLD_IMAGE"), f"SELECT seq, op, pk, old_type, old_value, CAST(NULL AS VARCHAR) AS new_type, CAST(NULL AS DOUBLE) AS new_value FROM {FEED} WHERE op IS NOT NULL")
add("cdc_read_after", lambda s, d: cdc.read_after(_feed(s, d), 500), f"SELECT * FROM {FEED} WHERE op IS NOT NULL AND seq > 500")
add("cdc_buffer", lambda s, d: cdc.buffer(_feed(s, d), 100), f"SELECT * FROM {FEED} WHERE op IS NOT NULL ORDER BY seq DESC LIMIT 100")


def _replayed(s: SparkSession, d: str) -> DataFrame:
    events = C.event_log(s, d)
    base = log.live(events.where("seq < 400")).drop("seq")
    return cdc.replay(base, cdc.changes(events).where("seq >= 400"))


add("cdc_replay", _replayed, f"SELECT pk, sk, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS r FROM {EVENT_LOG}) WHERE r = 1 AND NOT deleted")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The feed as a stream over the events, run to its end."""
    from .streaming.jobs import run_to_end

    return run_to_end(s, d)


add("cdc_stream", _streamed, f"SELECT pk, seq, op FROM {FEED} WHERE op IS NOT NULL")

# Versions, compaction, replicas

add("lww_merge", lambda s, d: log.live(C.line_log(s, d)), f"SELECT * EXCLUDE (deleted) FROM {NEWEST} WHERE NOT deleted")
add("compact", lambda s, d: log.live(log.compact(C.line_log(s, d))), f"SELECT * EXCLUDE (deleted) FROM {NEWEST} WHERE NOT deleted")
add("compact_stats", lambda s, d: log.compact_stats(C.line_log(s, d)),
    f"SELECT (SELECT count(*) FROM lineitem) AS versions_in, count(*) AS keys, (SELECT count(*) FROM lineitem) - count(*) AS records_removed, CAST(count_if(deleted) AS BIGINT) AS tombstones_removed, CAST(count_if(NOT deleted) AS BIGINT) AS records_out FROM {NEWEST}")
add("stats", lambda s, d: log.stats(C.orders(s, d).df).select("total_keys", "partitions"), f"SELECT count(*) AS total_keys, count(DISTINCT pk) AS partitions FROM {ORDERS}")


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the orders: each lacks some, and some differ."""
    t = C.orders_by_id(s, d).df.withColumn("updated_at", F.col("pk").cast("long") % 100)
    n = F.col("pk").cast("long")
    left = t.where(n % 10 != 1)
    right = t.where(n % 10 != 2).withColumn("o_totalprice", F.when(n % 10 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("updated_at", F.when(n % 20 == 3, F.col("updated_at") + 1).when(n % 20 == 13, F.col("updated_at") - (n % 3)).otherwise(F.col("updated_at")))
    return left, right


_T = f"(SELECT *, CAST(pk AS BIGINT) % 100 AS updated_at FROM {BY_ID})"
LEFT = f"(SELECT * FROM {_T} WHERE CAST(pk AS BIGINT) % 10 <> 1)"
RIGHT = f"""(SELECT * REPLACE (CASE WHEN CAST(pk AS BIGINT) % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN CAST(pk AS BIGINT) % 20 = 3 THEN updated_at + 1 WHEN CAST(pk AS BIGINT) % 20 = 13 THEN updated_at - CAST(pk AS BIGINT) % 3 ELSE updated_at END AS updated_at) FROM {_T} WHERE CAST(pk AS BIGINT) % 10 <> 2)"""
_COLS = "o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, updated_at".split(", ")


def _merge_sql(win: str) -> str:
    cols = ", ".join(f"CASE WHEN b.pk IS NULL OR (a.pk IS NOT NULL AND {win}) THEN a.{c} ELSE b.{c} END AS {c}" for c in _COLS)
    return f"SELECT coalesce(a.pk, b.pk) AS pk, coalesce(a.sk, b.sk) AS sk, {cols} FROM {LEFT} a FULL JOIN {RIGHT} b ON a.pk = b.pk"


add("replica_diff", lambda s, d: replica.diff(*halves(s, d)), f"SELECT * FROM (SELECT coalesce(a.pk, b.pk) AS pk, CAST(NULL AS VARCHAR) AS sk, CASE WHEN b.pk IS NULL THEN 'LocalOnly' WHEN a.pk IS NULL THEN 'RemoteOnly' WHEN a.o_totalprice <> b.o_totalprice OR a.updated_at <> b.updated_at THEN 'Modified' END AS kind FROM {LEFT} a FULL JOIN {RIGHT} b ON a.pk = b.pk) WHERE kind IS NOT NULL")
add("merkle_diff", lambda s, d: replica.diff(*halves(s, d)).groupBy("kind").agg(F.count("*").alias("n")),
    f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b.pk IS NULL THEN 'LocalOnly' WHEN a.pk IS NULL THEN 'RemoteOnly' WHEN a.o_totalprice <> b.o_totalprice OR a.updated_at <> b.updated_at THEN 'Modified' END AS kind FROM {LEFT} a FULL JOIN {RIGHT} b ON a.pk = b.pk) WHERE kind IS NOT NULL GROUP BY kind")
add("conflict_lww", lambda s, d: replica.merge(*halves(s, d), "lww"), _merge_sql("a.updated_at >= b.updated_at"))
add("conflict_fww", lambda s, d: replica.merge(*halves(s, d), "fww"), _merge_sql("a.updated_at <= b.updated_at"))
add("replica_merge", lambda s, d: replica.merge(*halves(s, d), "local"), _merge_sql("TRUE"))
add("conflict_remote", lambda s, d: replica.merge(*halves(s, d), "remote"), _merge_sql("FALSE"))
add("replica_transfer", lambda s, d: replica.transfer(*halves(s, d))[0].select("pk", "o_totalprice"), f"SELECT a.pk, a.o_totalprice FROM {LEFT} a LEFT JOIN {RIGHT} b ON a.pk = b.pk WHERE b.pk IS NULL OR a.o_totalprice <> b.o_totalprice OR a.updated_at <> b.updated_at")


def _attribute_halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = (x.select("pk", "sk", F.when(F.col("pk").cast("long") % k != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("pk").cast("long") % m != 0, F.col("o_orderstatus")).alias("status"), "updated_at", (F.col("pk").cast("long") % g == 0).alias("gone")) for x, k, m, g in zip(halves(s, d), (2, 3), (5, 7), (11, 13)))
    return a, b


def _attr(side: str, k: int, m: int, g: int) -> str:
    return f"(SELECT pk, sk, CASE WHEN CAST(pk AS BIGINT) % {k} <> 0 THEN o_totalprice END AS price, CASE WHEN CAST(pk AS BIGINT) % {m} <> 0 THEN o_orderstatus END AS status, updated_at, CAST(pk AS BIGINT) % {g} = 0 AS gone FROM {side})"


def _attr_sql(c: str) -> str:
    return f"""CASE WHEN b.pk IS NULL THEN a.{c} WHEN a.pk IS NULL THEN b.{c} WHEN a.gone AND NOT b.gone THEN CASE WHEN a.updated_at > b.updated_at THEN a.{c} ELSE b.{c} END WHEN b.gone AND NOT a.gone THEN CASE WHEN a.updated_at >= b.updated_at THEN a.{c} ELSE b.{c} END
        WHEN a.updated_at >= b.updated_at THEN coalesce(a.{c}, b.{c}) ELSE coalesce(b.{c}, a.{c}) END AS {c}"""


add("conflict_attr_merge", lambda s, d: replica.merge(*_attribute_halves(s, d), "attr_merge", deleted="gone"),
    f"SELECT coalesce(a.pk, b.pk) AS pk, coalesce(a.sk, b.sk) AS sk, {', '.join(map(_attr_sql, ('price', 'status', 'updated_at', 'gone')))} FROM {_attr(LEFT, 2, 5, 11)} a FULL JOIN {_attr(RIGHT, 3, 7, 13)} b ON a.pk = b.pk")
add("conflict_manual", lambda s, d: replica.merge(*halves(s, d), lambda c: c.limit(0).select("pk", "sk", *[F.col("l_" + x).alias(x) for x in _COLS])), f"SELECT coalesce(a.pk, b.pk) AS pk, CAST(NULL AS VARCHAR) AS sk, {', '.join(f'coalesce(a.{c}, b.{c}) AS {c}' for c in _COLS)} FROM {LEFT} a FULL JOIN {RIGHT} b ON a.pk = b.pk WHERE a.pk IS NULL OR b.pk IS NULL")
add("conflict_custom", lambda s, d: replica.merge(*halves(s, d), lambda c: c.select("pk", "sk", *[F.greatest("l_" + x, "r_" + x).alias(x) for x in _COLS])), f"SELECT coalesce(a.pk, b.pk) AS pk, CAST(NULL AS VARCHAR) AS sk, {', '.join(f'greatest(a.{c}, b.{c}) AS {c}' for c in _COLS)} FROM {LEFT} a FULL JOIN {RIGHT} b ON a.pk = b.pk")
add("merkle_leaf", lambda s, d: replica.leaves(C.raw(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("pk"), "o_orderstatus", "o_orderpriority"), ("pk",), F.concat_ws("|", "o_orderstatus", "o_orderpriority")),
    "SELECT CAST(o_orderkey AS VARCHAR) AS pk, sha256(CAST(o_orderkey AS VARCHAR) || chr(30) || concat_ws('|', o_orderstatus, o_orderpriority)) AS hash FROM orders")


def _clocks(s: SparkSession, d: str) -> DataFrame:
    t, n = C.raw(s, d, "supplier"), F.col("s_suppkey")
    return t.select(n.alias("k"), F.create_map(F.lit("a"), n % 3, F.lit("b"), n % 4).alias("x"), F.create_map(F.lit("b"), n % 2, F.lit("c"), n % 5).alias("y"))


add("vclock_ops", lambda s, d: _clocks(s, d).select("k", replica.vclock_compare(F.col("x"), F.col("y")).alias("relation"), (m := replica.vclock_merge(replica.vclock_increment(F.col("x"), "a"), F.col("y")))["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c")),
    """SELECT k, CASE WHEN le AND ge THEN 'Equal' WHEN le THEN 'Before' WHEN ge THEN 'After' ELSE 'Concurrent' END AS relation, a, b, c FROM (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AND s_suppkey % 4 <= s_suppkey % 2 AS le,
    s_suppkey % 5 = 0 AND s_suppkey % 2 <= s_suppkey % 4 AS ge, s_suppkey % 3 + 1 AS a, greatest(s_suppkey % 4, s_suppkey % 2) AS b, s_suppkey % 5 AS c FROM supplier)""")  # fmt: skip


def _clocked(s: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("pk", "sk", "o_totalprice", "updated_at", F.create_map(F.lit("a"), F.col("pk").cast("long") % i, F.lit("b"), F.col("pk").cast("long") % j).alias("clock")) for x, i, j in zip(halves(s, d), (3, 2), (4, 5)))
    cols = ["o_totalprice", "updated_at", "clock"]
    out = replica.merge(a, b, lambda c: c.select("pk", "sk", *replica.resolve_vclock(c, cols)))
    return out.select("pk", "o_totalprice", "updated_at", F.col("clock")["a"].alias("a"), F.col("clock")["b"].alias("b"))


def _clock_sql() -> str:
    side = lambda t, i, j: f"(SELECT *, CAST(pk AS BIGINT) % {i} AS a, CAST(pk AS BIGINT) % {j} AS b FROM {t})"
    win = "CASE WHEN a.a <= b.a AND a.b <= b.b AND NOT (a.a = b.a AND a.b = b.b) THEN FALSE WHEN a.a >= b.a AND a.b >= b.b THEN TRUE ELSE a.updated_at >= b.updated_at END"
    pick = lambda c: f"CASE WHEN b.pk IS NULL THEN a.{c} WHEN a.pk IS NULL THEN b.{c} WHEN {win} THEN a.{c} ELSE b.{c} END AS {c}"
    return f"SELECT coalesce(a.pk, b.pk) AS pk, {pick('o_totalprice')}, {pick('updated_at')}, greatest(a.a, b.a) AS a, greatest(a.b, b.b) AS b FROM {side(LEFT, 3, 4)} a FULL JOIN {side(RIGHT, 2, 5)} b ON a.pk = b.pk"


add("conflict_vclock", _clocked, _clock_sql())


def _queue(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return C.raw(s, d, "events").select(n.alias("seq"), F.col("user_id").cast("string").alias("pk"), (n % 4).cast("int").alias("priority"), (n * 20).cast("double").alias("queued_at"), (n % 7).cast("int").alias("attempts"), F.when(n % 7 > 0, (F.lit(100000) - n % 40).cast("double")).alias("last_attempt"))


QUEUE = "(SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS pk, CAST(event_id % 4 AS INT) AS priority, CAST(event_id * 20 AS DOUBLE) AS queued_at, CAST(event_id % 7 AS INT) AS attempts, CASE WHEN event_id % 7 > 0 THEN CAST(100000 - event_id % 40 AS DOUBLE) END AS last_attempt FROM events)"
STATES = f"(SELECT *, CASE WHEN 100000 - queued_at > 86400 THEN 'expired' WHEN attempts >= 5 THEN 'failed' WHEN last_attempt IS NULL OR last_attempt + 2 ** least(attempts, 10) <= 100000 THEN 'ready' ELSE 'waiting' END AS state FROM {QUEUE})"
add("offline_queue", lambda s, d: replica.queue_state(_queue(s, d), 100000), f"SELECT * FROM {STATES}")
add("offline_queue_next", lambda s, d: replica.queue_next(_queue(s, d), 100000, 50), f"SELECT * FROM {STATES} WHERE state = 'ready' ORDER BY priority DESC, seq LIMIT 50")
add("change_tracker", lambda s, d: replica.tracked(C.raw(s, d, "events").select(F.col("user_id").cast("string").alias("pk"), F.col("event_id").alias("seq"), "ts"), 200, 3600, "ts", ("pk",)),
    "SELECT pk, seq, ts FROM (SELECT CAST(user_id AS VARCHAR) AS pk, event_id AS seq, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR floor(epoch(ts)) - floor(epoch(p)) > 3600 ORDER BY seq DESC LIMIT 200")
add("block_encrypt", lambda s, d: C.customers(s, d).df.select("pk", F.aes_decrypt(F.aes_encrypt(F.col("c_name").cast("binary"), F.lit("0123456789abcdef0123456789abcdef"), F.lit("GCM")), F.lit("0123456789abcdef0123456789abcdef"), F.lit("GCM")).cast("string").alias("c_name")), f"SELECT pk, c_name FROM {CUSTOMERS}")

# What applications ask

add("app_top_popular", lambda s, d: apps.top(C.parts(s, d).df, "p_retailprice", 10).select("pk", "p_name", "p_retailprice"), f"SELECT pk, p_name, p_retailprice FROM {PARTS} ORDER BY p_retailprice DESC, pk LIMIT 10")
add("app_tag_counts", lambda s, d: apps.tag_counts(C.raw(s, d, "part").select(F.regexp_replace("p_name", " ", " , ").alias("tags")), "tags"), "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag")
add("app_posts_by_tag", lambda s, d: apps.by_tag(C.raw(s, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", ", ").alias("tags"), "p_retailprice"), "tags", "RED", "p_retailprice").select("p_partkey"), "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red')")
add("app_author_posts", lambda s, d: apps.newest_of(C.orders(s, d), "85", "o_orderdate"), f"SELECT * FROM {ORDERS} WHERE pk = '85'")
add("app_total_count", lambda s, d: C.orders(s, d).df.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM orders")
add("ext_vector_top", lambda s, d: apps.nearest(C.raw(s, d, "embeddings"), "embedding", "vec_id", 10).select("vec_id", F.round("similarity", 4).alias("similarity")),
    "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 10")
QUERIES |= stored_queries.QUERIES
ORACLE_SQL |= stored_queries.ORACLE_SQL
