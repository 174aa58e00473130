"""Queries on stored tables, round trips through files, and what is refused, each with SQL or its expected rows.

A stored table is made in the shared folder from a whole test table, then
written, compacted, copied or read as the operator says.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database, Operation
from .errors import NotFound, StoreError
from .functions import keys as K
from .functions import values as V
from .functions.retry import Retry
from .functions.shared import shared_dir
from .model import IndexSpec, StreamSpec, TableSpec
from .operators import replica, sync
from .operators.read import Query, Scan
from .plans import expr, partiql
from .sources import catalog as C
from .sources import io as IO

CLOCK = 1_700_000_000_000
CUSTOMERS = "(SELECT CAST(c_custkey AS VARCHAR) AS pk, CAST(NULL AS VARCHAR) AS sk, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer)"
SPEC = TableSpec(indexes=(IndexSpec.global_("by_segment", "segment", "name"), IndexSpec.global_("by_nation", "nation"), IndexSpec.local("by_name", "name")), stream=StreamSpec(buffer_size=100_000))


def attributes(df: DataFrame, **columns) -> DataFrame:
    """(pk, sk, attrs): text columns as string attributes, others as numbers; null is absent."""

    def av(c):
        kind = c.startswith("n_")
        t = F.lit("N" if kind else "S")
        empty = {f.name: F.lit(None).cast(f.dataType) for f in V.AV.fields}
        own = empty | {"t": t, ("n" if kind else "s"): F.col(c).cast("string")}
        return F.struct(*[own[f.name].alias(f.name) for f in V.AV.fields])

    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c.removeprefix("n_")).alias("key"), av(c).alias("value"))) for c in columns])
    named = df.select("pk", "sk", *[v.alias(k) for k, v in columns.items()])
    return named.select("pk", "sk", F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull())).cast(V.ATTRS).alias("attrs"))


def customer_items(s: SparkSession, d: str) -> DataFrame:
    c = C.customers(s, d).df
    return attributes(c, name=F.col("c_name"), n_nation=F.col("c_nationkey"), segment=F.col("c_mktsegment"))


def stored(s: SparkSession, items: DataFrame | None = None, spec: TableSpec = SPEC, now: int = CLOCK) -> Database:
    db = Database.create(s, shared_dir(s), spec, lambda: now)
    if items is not None:
        db.put_many(items)
    return db


def flat(df: DataFrame, *names: str) -> DataFrame:
    """pk, sk and the text of some attributes."""
    return df.select("pk", "sk", *[F.coalesce(F.col("attrs")[n]["s"], F.col("attrs")[n]["n"]).alias(n) for n in names])


def customers(s: SparkSession, d: str) -> Database:
    return stored(s, customer_items(s, d))


_made: dict[tuple, Database] = {}


def once(make: Callable[[SparkSession, str], Database], s: SparkSession, d: str) -> Database:
    """A table that queries only read, made once a session, and again if its folder has gone."""
    key = (make.__name__, s.sparkContext.applicationId, d)
    if key not in _made or not _there(_made[key]):
        _made[key] = make(s, d)
    return _made[key]


def _there(db: Database) -> bool:
    try:
        return db.health() == "Healthy"
    except NotFound:
        return False


def live(db: Database) -> DataFrame:
    return flat(db.scan().df, "name", "nation", "segment")


def _written(s: SparkSession, d: str) -> Database:
    """The customers after updates, deletes and a put in later commits."""
    db = customers(s, d)
    db.write([*[Operation("update", str(i), expression="SET #n = :n", values={":n": f"new {i}"}, names={"#n": "name"}) for i in range(1, 11)], *[Operation("delete", str(i)) for i in range(11, 16)]], atomic=False)
    db.append(customer_items(s, d).where("int(pk) % 7 = 0").select("pk", "sk", F.lit(None).cast(V.ATTRS).alias("attrs"), F.lit(True).alias("deleted")))
    db.put("x1", {"name": "late", "nation": 3, "segment": "NONE"})
    return db


WRITTEN = f"(SELECT pk, sk, CASE WHEN CAST(pk AS INT) <= 10 THEN 'new ' || pk ELSE name END AS name, nation, segment FROM {CUSTOMERS} WHERE CAST(pk AS INT) NOT BETWEEN 11 AND 15 AND CAST(pk AS INT) % 7 <> 0 UNION ALL SELECT 'x1', NULL, 'late', '3', 'NONE')"


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    """SQL of fixed rows; numbers are BIGINT."""
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


def refused(calls: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, str]]:
    """(what, error) of each call: the error's name, or `accepted`."""
    out = []
    for what, f in calls:
        try:
            f()
            out.append((what, "accepted"))
        except StoreError as e:
            out.append((what, type(e).__name__))
    return out


def _refusals(texts: dict[str, str], parse: Callable[[str], object]) -> tuple[Callable, str]:
    run = lambda s, d: _rows(s, refused([(t, lambda t=t: parse(t)) for t in texts]), "what string, error string")
    return run, _values(list(texts.items()), "what, error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = f, sql


# Stored tables

add("stored_put_many", lambda s, d: live(once(customers, s, d)), f"SELECT * FROM {CUSTOMERS}")
add("stored_writes", lambda s, d: live(once(_written, s, d)), f"SELECT * FROM {WRITTEN}")
add("stored_get", lambda s, d: _rows(s, [(i["name"], i["segment"]) for i in [once(customers, s, d).get("7")]], "name string, segment string"), f"SELECT name, segment FROM {CUSTOMERS} WHERE pk = '7'")
add("stored_query", lambda s, d: flat(once(_written, s, d).query(Query("3")).df, "name", "nation", "segment"), f"SELECT * FROM {WRITTEN} WHERE pk = '3'")
add("stored_batch_get", lambda s, d: _rows(s, [(k[0], v["name"]) for k, v in once(_written, s, d).batch_get(["3", "12", "14", "20", "none"]).items()], "pk string, name string"), f"SELECT pk, name FROM {WRITTEN} WHERE pk IN ('3', '12', '14', '20', 'none')")
add("stored_gsi", lambda s, d: flat(once(_written, s, d).query(Query("BUILDING").index("by_segment")).df.select(F.col("base_pk").alias("pk"), F.col("base_sk").alias("sk"), "attrs"), "name", "nation", "segment"), f"SELECT * FROM {WRITTEN} WHERE segment = 'BUILDING'")
add("stored_gsi_range", lambda s, d: once(_written, s, d).query(Query("BUILDING").sk_begins_with("new").index("by_segment")).df.select("sk", "base_pk"), f"SELECT name AS sk, pk AS base_pk FROM {WRITTEN} WHERE segment = 'BUILDING' AND starts_with(name, 'new')")
add("stored_lsi", lambda s, d: once(_written, s, d).query(Query("5").sk_gte("new").index("by_name")).df.select("sk", "base_pk"), f"SELECT name AS sk, pk AS base_pk FROM {WRITTEN} WHERE pk = '5' AND name >= 'new'")
add("stored_sql", lambda s, d: once(_written, s, d).execute("SELECT name, segment FROM t WHERE pk IN ('3', '5', '12', '100')").page.df.select(*[F.col("attrs")[c]["s"].alias(c) for c in ("name", "segment")]), f"SELECT name, segment FROM {WRITTEN} WHERE pk IN ('3', '5', '12', '100')")
add("index_in_scan", lambda s, d: once(customers, s, d).scan(Scan()).df.select("pk"), f"SELECT pk FROM {CUSTOMERS}")


def _compacted(s: SparkSession, d: str) -> DataFrame:
    db = _written(s, d)
    db.compact()
    db.vacuum()
    return live(Database.open(s, db.path))


add("stored_compact", _compacted, f"SELECT * FROM {WRITTEN}")
add("recover", lambda s, d: live(Database.open(s, once(_written, s, d).path)), f"SELECT * FROM {WRITTEN}")
add("src_wal", lambda s, d: once(_written, s, d).log().groupBy("pk").agg(F.count("*").alias("versions"), F.count_if("deleted").alias("tombstones")),
    f"SELECT pk, count(*) AS versions, CAST(sum(gone) AS BIGINT) AS tombstones FROM (SELECT pk, 0 AS gone FROM {CUSTOMERS} UNION ALL SELECT pk, CASE WHEN CAST(pk AS INT) > 10 THEN 1 ELSE 0 END FROM {CUSTOMERS} WHERE CAST(pk AS INT) BETWEEN 1 AND 15 UNION ALL SELECT pk, 1 FROM {CUSTOMERS} WHERE CAST(pk AS INT) % 7 = 0 UNION ALL SELECT 'x1', 0) GROUP BY pk")


def _parquet(s: SparkSession, d: str) -> DataFrame:
    """The data folder itself, as any Parquet reader sees it."""
    db = once(customers, s, d)
    return flat(s.read.parquet(db._folder(db.head()["data"][0])), "name", "nation", "segment")


add("src_sst", _parquet, f"SELECT * FROM {CUSTOMERS}")


def _trigger(s: SparkSession, d: str) -> DataFrame:
    """Ten commits to one key, three to another: only the first one's stripe is due."""
    db = stored(s)
    for i in range(10):
        db.write([Operation("put", "hot", {"v": i}), *([Operation("put", "cold", {"v": i})] if i < 3 else [])], atomic=False)
    before = db.log().groupBy("pk").agg(F.count("*").alias("before"))
    done = db.compact_due(10)
    after = db.log().groupBy("pk").agg(F.count("*").alias("after"))
    return before.join(after, "pk").join(flat(db.scan().df, "v"), "pk").select("pk", "before", "after", "v", F.lit(len(done)).cast("long").alias("stripes"))


add("compact_trigger", _trigger, _values([("hot", 10, 1, "9", 1), ("cold", 3, 3, "2", 1)], "pk, before, after, v, stripes"))


def _health(s: SparkSession, d: str) -> DataFrame:
    db = stored(s)
    db.put("a", {"x": 1})
    found = [("before", db.health())]
    fs, p = db._fs(db._folder(db.head()["data"][0]))
    fs.delete(p, True)
    return _rows(s, [*found, ("after", db.health())], "step string, health string")


add("health", _health, _values([("before", "Healthy"), ("after", "Unhealthy")], "step, health"))
add("stored_stats", lambda s, d: _rows(s, [(lambda x: tuple(x[k] for k in ("total_keys", "partitions", "commit", "data_folders")))(once(_written, s, d).stats())], "total_keys long, partitions long, commits long, data_folders long"),
    f"SELECT count(*) AS total_keys, count(DISTINCT pk) AS partitions, CAST(4 AS BIGINT) AS commits, CAST(4 AS BIGINT) AS data_folders FROM {WRITTEN}")


def _copied(s: SparkSession, d: str) -> DataFrame:
    db, to = customers(s, d), shared_dir(s)
    counts = [tuple(db.push(to).values())]
    db.put("x1", {"name": "late"})
    counts += [tuple(db.push(to).values()), tuple(db.push(to, verify=True).values())]
    other = Database.open(s, to)
    counts.append((len(other.commits()), other.scan().df.count()))
    return _rows(s, [(i, *c) for i, c in enumerate(counts)], "step long, a long, b long")


add("conn_s3", _copied, f"{_values([(0, 1, 0), (1, 1, 1), (2, 0, 2)], 'step, a, b')} UNION ALL SELECT 3, 2, count(*) + 1 FROM customer")
add("conn_s3_restore", lambda s, d: (db := once(_written, s, d)).push(to := shared_dir(s)) and Database.open(s, to).push(back := shared_dir(s)) and live(Database.open(s, back)), f"SELECT * FROM {WRITTEN}")


def _meta(s: SparkSession, d: str) -> DataFrame:
    a, b = customers(s, d), stored(s)
    a.put("x1", {"name": "late"})
    sync.synchronise(a, b, peer="b")
    sync.synchronise(a, b, peer="b")
    return _rows(s, [(i, x["pushed"], x["pulled"], x["conflicts"]) for i, x in enumerate(sync.history(a, "b"))], "n long, pushed long, pulled long, conflicts long")


add("sync_metadata", _meta, "SELECT CAST(0 AS BIGINT) AS n, count(*) + 1 AS pushed, CAST(0 AS BIGINT) AS pulled, CAST(0 AS BIGINT) AS conflicts FROM customer UNION ALL SELECT 1, 0, 0, 0")

# Transactions


def _cancelled(s: SparkSession, d: str) -> DataFrame:
    """A transaction whose last update can't be evaluated, and one with two operations on one key."""
    db = customers(s, d)
    bad = refused([
        ("update fails", lambda: db.transact_write([Operation("put", "new", {"name": "x"}), Operation("delete", "3"), Operation("update", "5", expression="SET name = name + :n", values={":n": 1})])),
        ("same key", lambda: db.transact_write([Operation("put", "3", {"name": "x"}), Operation("delete", "3")])), ("condition", lambda: db.transact_write([Operation("delete", "3"), Operation("check", "none", condition="attribute_exists(name)")])),
    ])
    return live(db).agg(F.count("*").alias("n"), F.count_if(F.col("pk") == "new").alias("new"), F.count_if(F.col("pk") == "3").alias("third")).select("*", F.lit(", ".join(x for _, x in bad)).alias("errors"))


add("txn_partial", _cancelled, "SELECT count(*) AS n, CAST(0 AS BIGINT) AS new, CAST(1 AS BIGINT) AS third, 'InvalidExpression, TransactionCanceled, TransactionCanceled' AS errors FROM customer")
add("txn_same_key", lambda s, d: _rows(s, refused([("two", lambda: stored(s).transact_write([Operation("put", "a", {"x": 1}), Operation("delete", "a")])), ("one", lambda: stored(s).transact_write([Operation("put", "a", {"x": 1})]))]), "what string, error string"), _values([("two", "TransactionCanceled"), ("one", "accepted")], "what, error"))


def _quiet(s: SparkSession, d: str) -> DataFrame:
    """A transaction that the feed and the indexes see, and one that they don't."""
    db = stored(s)
    db.transact_write([Operation("put", "a", {"segment": "X", "name": "a"})])
    db.transact_write([Operation("put", "b", {"segment": "X", "name": "b"})], side_effects=False)
    seen = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("pk"))
    return seen("feed", db.stream(), "pk").union(seen("index", db.query(Query("X").index("by_segment")).df, "base_pk")).union(seen("scan", db.scan().df, "pk"))


add("txn_no_side_effects", _quiet, _values([("feed", "a"), ("index", "a"), ("scan", "a"), ("scan", "b")], "kind, pk"))


def _dense(s: SparkSession, d: str) -> DataFrame:
    """The feed's numbers of puts to a table with indexes: none is missing."""
    db = stored(s)
    db.write([Operation("put", f"k{i}", {"segment": "X", "name": f"n{i}"}) for i in range(40)], atomic=False)
    return db.stream().select("seq")


add("cdc_seq_gaps", _dense, "SELECT CAST(unnest(range(1, 41)) AS BIGINT) AS seq")

# Statements


def _responses(s: SparkSession, d: str) -> DataFrame:
    db, out = customers(s, d), []
    for text in ("INSERT INTO t VALUE {'pk': 'x', 'name': 'N', 'nation': 2}", "UPDATE t SET nation = nation + 1 WHERE pk = 'x'", "SELECT * FROM t WHERE pk = 'x'", "DELETE FROM t WHERE pk = 'x'", "SELECT * FROM t WHERE pk = 'x'"):
        r = db.execute(text)
        out.append((len(out), r.kind, json.dumps(r.item, sort_keys=True, default=str) if r.item else None, r.page.count if r.page else None, r.page.scanned_count if r.page else None))
    return _rows(s, out, "n long, kind string, item string, count long, scanned_count long")


add("sql_response", _responses, _values([(0, "insert", None, None, None), (1, "update", '{"name": "N", "nation": 3}', None, None), (2, "select", None, 1, 1), (3, "delete", None, None, None), (4, "select", None, 0, 0)], "n, kind, item, count, scanned_count"))
ROUTES = {"SELECT * FROM t": "scan", "SELECT * FROM t WHERE pk = 'a'": "query", "SELECT * FROM t WHERE x > 1 AND pk = 'a' AND sk > 'b'": "query", "SELECT * FROM t WHERE pk IN ('a', 'b')": "multiget", "SELECT * FROM t WHERE pk > 'a'": "scan", "SELECT * FROM t WHERE sk = 'a'": "scan"}
add("sql_route", lambda s, d: _rows(s, [(t, partiql.route(partiql.parse(t))) for t in ROUTES], "statement string, route string"), _values(list(ROUTES.items()), "statement, route"))
add("sql_length", lambda s, d: _rows(s, refused([(str(n), lambda n=n: partiql.parse("SELECT * FROM t" + " " * (n - 15) if n >= 15 else "x" * n)) for n in (0, 15, 8192, 8193)] + [("bytes", lambda: partiql.parse("SELECT * FROM t WHERE pk = '" + "é" * 4100 + "'"))]), "length string, error string"),
    _values([("0", "InvalidQuery"), ("15", "accepted"), ("8192", "accepted"), ("8193", "InvalidQuery"), ("bytes", "InvalidQuery")], "length, error"))
for _name, _texts in (
    ("proj_computed", {"SELECT COUNT(*) FROM t": "InvalidQuery", "SELECT a + b FROM t": "InvalidQuery", "SELECT upper(a) FROM t": "InvalidQuery", "SELECT a, b FROM t": "accepted"}),
    ("pred_rejects", {f"SELECT * FROM t WHERE {w}": e for w, e in (
        ("a = 1 OR b = 2", "InvalidQuery"), ("a NOT IN (1, 2)", "InvalidQuery"), ("a NOT BETWEEN 1 AND 2", "InvalidQuery"), ("a LIKE 'x%'", "InvalidQuery"), ("a IS NULL", "InvalidQuery"), ("(a = 1)", "InvalidQuery"), ("a = b", "InvalidQuery"), ("a = -1", "accepted"), ("a = 1 AND b = 2", "accepted"),
    )}),
    ("sql_rejects", {"SELECT * FROM t JOIN u ON t.a = u.a": "InvalidQuery", "SELECT a FROM t GROUP BY a": "InvalidQuery", "SELECT a FROM t UNION SELECT b FROM t": "InvalidQuery", "WITH x AS (SELECT * FROM t) SELECT * FROM x": "InvalidQuery", "SELECT * FROM t; SELECT * FROM t": "InvalidQuery", "DROP TABLE t": "InvalidQuery"}),
    ("sql_dml_op_unchecked", {"DELETE FROM t WHERE pk > 'x'": "InvalidQuery", "UPDATE t SET a = 1 WHERE pk >= 'x'": "InvalidQuery", "DELETE FROM t": "InvalidQuery", "UPDATE t SET a = 1 WHERE a = 2": "InvalidQuery", "DELETE FROM t WHERE pk = 'x' AND a > 2": "accepted"}),
):
    add(_name, *_refusals(_texts, partiql.parse))
add("cond_trailing", *_refusals({"a = :a": "accepted", "a = :a b": "InvalidExpression", "a = :a )": "InvalidExpression", "attribute_exists(a) a": "InvalidExpression", "(a = :a": "InvalidExpression"}, lambda t: expr.parse_condition(t, {":a": 1})))
add("upd_delete", lambda s, d: _rows(s, refused([(t, lambda t=t: stored(s).update("a", t, values={":a": 1})) for t in ("DELETE x :a", "SET x = :a", "REMOVE x")]), "what string, error string"), _values([("DELETE x :a", "InvalidExpression"), ("SET x = :a", "accepted"), ("REMOVE x", "accepted")], "what, error"))


def _specs(s: SparkSession, kinds: bool) -> DataFrame:
    """Index definitions, after their way through the table's description."""
    spec = TableSpec(indexes=(IndexSpec.local("l", "a"), IndexSpec.local("lk", "a").keys_only(), IndexSpec.global_("g", "p"), IndexSpec.global_("gi", "p", "a").including("x", "y")))
    db = Database.open(s, stored(s, None, spec).path)
    return _rows(s, [(i.name, i.pk, i.sk, i.projection, ",".join(i.include)) for i in db.spec.indexes if (i.pk is not None) == kinds], "name string, pk string, sk string, projection string, include string")


add("lsi_def", lambda s, d: _specs(s, False), _values([("l", None, "a", "ALL", ""), ("lk", None, "a", "KEYS_ONLY", "")], "name, pk, sk, projection, include"))
add("gsi_def", lambda s, d: _specs(s, True), _values([("g", "p", None, "ALL", ""), ("gi", "p", "a", "INCLUDE", "x,y")], "name, pk, sk, projection, include"))


def _tries(s: SparkSession, d: str) -> DataFrame:
    from .errors import ConflictingCommit

    out = []
    for name in ("none", "fast", "standard"):
        for error in (ConflictingCommit, NotFound):
            waits: list[float] = []
            calls = []

            def fails(error=error, calls=calls):
                calls.append(1)
                raise error("again")

            try:
                getattr(Retry, name)(sleep=waits.append).run(fails)
            except StoreError:
                pass
            out.append((name, error.__name__, len(calls), round(1000 * sum(waits))))
    return _rows(s, out, "policy string, error string, calls long, waited_ms long")


add("retry", _tries, _values([("none", "ConflictingCommit", 1, 0), ("none", "NotFound", 1, 0), ("fast", "ConflictingCommit", 3, 30), ("fast", "NotFound", 1, 0), ("standard", "ConflictingCommit", 5, 1500), ("standard", "NotFound", 1, 0)], "policy, error, calls, waited_ms"))

# Files and text


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Items through JSON lines in the shared folder."""
    path = shared_dir(s)
    IO.write_json_lines(C.raw(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return IO.read_json_lines(s, path, "s_suppkey").select("pk", F.col("attrs")["s_name"]["s"].alias("name"), F.col("attrs")["s_nationkey"]["n"].alias("nation"))


add("src_json", _lines, "SELECT CAST(s_suppkey AS VARCHAR) AS pk, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
add("sink_json", lambda s, d: _rows(s, [(r["n_nationkey"], r["n_name"]) for r in json.loads(IO.pretty_json(C.raw(s, d, "nation")))], "n_nationkey long, n_name string"), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = shared_dir(s)
    IO.write_csv(customer_items(s, d), path)
    return s.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


add("sink_csv", _csv, f"SELECT name, nation, segment FROM {CUSTOMERS}")
add("sink_table", lambda s, d: _rows(s, [tuple(x.strip() for x in line.split(" | ")) for line in list(IO.table_lines(attributes(C.raw(s, d, "nation").selectExpr("string(n_nationkey) AS pk", "CAST(NULL AS STRING) AS sk", "n_name", "if(n_nationkey % 3 = 0, NULL, n_regionkey) AS r"), name=F.col("n_name"), n_region=F.col("r"))))[2:]], "name string, region string"),
    "SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '-' ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation")

# Hashes that SQL has to work out

_STEP = "list_reduce([{0}, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(pk, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c // 256, " + _STEP.format("xor(c, b) % 256") + ")), 4294967295)"
_PK = "SELECT CAST(o_custkey AS VARCHAR) AS pk, CAST(o_orderkey AS VARCHAR) AS sk FROM orders"
add("checksum", lambda s, d: C.orders(s, d).df.select("pk", "sk", K.stripe().cast("long").alias("stripe")), f"SELECT pk, sk, CAST({CRC} % 256 AS BIGINT) AS stripe FROM ({_PK})")
_LEAF = "sha256(CAST(o_orderkey AS VARCHAR) || chr(30) || concat_ws('|', o_orderstatus, o_orderpriority))"
_HEX = lambda x: f"CAST(('0x' || {x}) AS BIGINT)"
_UP = "SELECT {i} AS level, node // 16 AS node, sha256(string_agg(CAST(node AS VARCHAR) || hash, '' ORDER BY node)) AS hash FROM l{j} GROUP BY node // 16"


def _tree(s: SparkSession, d: str) -> DataFrame:
    own = C.raw(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("pk"), "o_orderstatus", "o_orderpriority")
    return replica.merkle_levels(replica.leaves(own, ("pk",), F.concat_ws("|", "o_orderstatus", "o_orderpriority")), ("pk",)).select(F.col("level").cast("long"), F.col("node").cast("long"), "hash")


add("merkle_build", _tree, f"""WITH h AS (SELECT {_LEAF} AS hash, {_HEX("substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12)")} % 4096 AS node FROM orders),
    l0 AS (SELECT CAST(0 AS BIGINT) AS level, node, sha256(concat_ws(':', count(*), CAST(sum(CAST({_HEX('substr(hash, 1, 15)')} AS HUGEINT)) AS VARCHAR), CAST(sum(CAST({_HEX('substr(hash, 33, 15)')} AS HUGEINT)) AS VARCHAR))) AS hash FROM h GROUP BY node),
    l1 AS ({_UP.format(i=1, j=0)}), l2 AS ({_UP.format(i=2, j=1)}), l3 AS ({_UP.format(i=3, j=2)})
    SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3""")  # fmt: skip
