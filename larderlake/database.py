"""A stored item table: schemaless items, a version log in Parquet, atomic commits, and the calls on it.

Layout of a folder:

    commits/00000000000000000007.json   what the table is after commit 7
    data/part=<id>/stripe=<n>/*.parquet      rows of one commit (or of a compaction)
    index=<name>/part=<id>/stripe=<n>/...    their keys by a global index's key, in its stripes

A commit first writes its rows, then creates the next commit file, which fails
if it exists: the writer that comes second gets ConflictingCommit and nothing
of it shows. The file lists the data folders in use, so readers see one
snapshot, old ones too (on an object store the rename must be one that fails
on an existing target, as in Hadoop's FileContext). Rows are (pk, sk, seq, deleted, at, attrs), in 256
stripes by crc32(pk) as partitions, so a read of a partition opens one stripe.

An index row holds while the version it was made from is the newest of its
key, so it is never updated: a read of a global index opens one stripe of it,
then the stripes of the keys found there. A compaction of some stripes leaves
the others' folders in use (`gone` in the commit says which are not).

One commit takes any number of operations. Rows given as Python objects go
through the driver; a DataFrame of any size doesn't.
"""

from __future__ import annotations

import dataclasses
import json
import time as clock
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConditionalCheckFailed, ConflictingCommit, InvalidArgument, NotFound, TransactionCanceled, ValidationFailed
from .functions import values as V
from .functions.keys import STRIPES, stripe
from .model import Page, StatementResult, TableSpec
from .operators import index as index_ops
from .operators import log as L
from .operators import read, ttl
from .operators.validate import violations
from .plans import expr as E
from .plans import partiql as P
from .sources.items import ItemTable
from .streaming import cdc

INDEX_ROWS = T.StructType([T.StructField("pk", T.StringType()), T.StructField("sk", T.StringType()), T.StructField("base_pk", T.StringType()), T.StructField("base_sk", T.StringType()), T.StructField("seq", T.LongType())])
ROWS = T.StructType([T.StructField("pk", T.StringType(), False), T.StructField("sk", T.StringType()), T.StructField("seq", T.LongType(), False), T.StructField("deleted", T.BooleanType(), False), T.StructField("at", T.LongType()), T.StructField("attrs", V.ATTRS)])
Key = Any  # a pk, or (pk, sk)


def _key(k: Key) -> tuple[str, str | None]:
    pk, sk = k if isinstance(k, tuple) else (k, None)
    text = lambda x: x.decode() if isinstance(x, bytes) else x if isinstance(x, str) or x is None else V.number_text(x)
    if pk is None or not len(text(pk)):
        raise InvalidArgument("a pk has a byte at least")
    return text(pk), text(sk)


@dataclass
class Operation:
    """One write. kind: put, delete, update or check; condition as in plans.expr."""

    kind: str
    key: Key
    item: dict | None = None
    expression: str | None = None
    condition: str | None = None
    values: dict = field(default_factory=dict)
    names: dict = field(default_factory=dict)


class Database:
    """An open table. `now` gives epoch milliseconds; a parameter, so that results can be repeated."""

    def __init__(self, spark: SparkSession, path: str, spec: TableSpec, now: Callable[[], int] | None = None):
        self.spark, self.path, self.now = spark, path.rstrip("/"), now or (lambda: int(clock.time() * 1000))
        self.spec = spec

    # opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: TableSpec = TableSpec(), now: Callable[[], int] | None = None) -> Database:
        """A new table; fails if there is one."""
        db = cls(spark, path, spec, now)
        db._publish({"commit": 0, "seq": 0, "data": [], "index": True, "spec": spec.to_json()})
        return db

    @classmethod
    def open(cls, spark: SparkSession, path: str, now: Callable[[], int] | None = None) -> Database:
        """An existing table, with its indexes, TTL, stream and rules."""
        db = cls(spark, path, TableSpec(), now)
        db.spec = TableSpec.from_json(db.head()["spec"])
        return db

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commits(self) -> list[int]:
        """The numbers of the commits that are there, ascending."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            raise NotFound(f"no table at {self.path}")
        return sorted(int(x.getPath().getName()[:20]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))

    def head(self, commit: int | None = None) -> dict:
        """The newest commit's description, or that of an older one."""
        n = commit if commit is not None else self.commits()[-1]
        fs, p = self._fs(f"{self.path}/commits/{n:020d}.json")
        if not fs.exists(p):
            raise NotFound(f"no commit {n}")
        with_stream = fs.open(p)
        try:
            return json.loads(bytes(with_stream.readAllBytes()).decode())
        finally:
            with_stream.close()

    def _publish(self, state: dict) -> None:
        """Makes a state visible: creates its file, or fails if another writer has."""
        fs, p = self._fs(f"{self.path}/commits/{state['commit']:020d}.json")
        if fs.exists(p):
            raise ConflictingCommit(f"commit {state['commit']} exists")
        _, temp = self._fs(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, p, none)  # fails if the target is there
        except Exception as e:
            fs.delete(temp, False)
            if "AlreadyExists" in str(e):
                raise ConflictingCommit(f"commit {state['commit']} exists") from None
            raise

    # what is stored

    def log(self, commit: int | None = None, folders: bool = False) -> DataFrame:
        """Every version of every item, as of a commit. folders: with `part`, the data folder."""
        state = self.head(commit)
        stored = T.StructType([*ROWS.fields, T.StructField("stripe", T.IntegerType()), T.StructField("part", T.StringType())])
        if not state["data"]:
            out = self.spark.createDataFrame([], stored)
        else:
            # one scan, whatever the number of commits
            out = self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*map(self._folder, state["data"]))
        replaced: dict[tuple, list[str]] = {}
        for name, stripes in state.get("gone", {}).items():
            replaced.setdefault(tuple(stripes), []).append(name)
        for stripes, names in replaced.items():
            out = out.where(~(F.col("part").isin(names) & F.col("stripe").isin(list(stripes))))
        return out if folders else out.drop("part")

    def _folder(self, name: str) -> str:
        return f"{self.path}/data/part={name}"

    def _live(self, log: DataFrame, now: float | None = None) -> DataFrame:
        return L.live(log, ttl_attribute=self.spec.ttl, now=self.now() / 1000 if now is None else now)

    def table(self, now: float | None = None, commit: int | None = None) -> ItemTable:
        """The live view as an item table (pk, sk, seq, at, attrs)."""
        return ItemTable(self._live(self.log(commit), now).drop("stripe", "at"), self.spec)

    def _partition(self, pks: list[str], commit: int | None = None) -> DataFrame:
        """The versions of some partitions: their stripes alone are opened."""
        import zlib

        stripes = sorted({zlib.crc32(p.encode()) % STRIPES for p in pks})
        return self.log(commit).where(F.col("stripe").isin(stripes)).where(F.col("pk").isin(pks))

    # writing

    def _commit(self, rows: DataFrame, head: dict, count: int, quiet: bool = False) -> int:
        """Appends rows (with seq above head's) in one commit. quiet: no index rows, and the change feed leaves them out."""
        name = uuid.uuid4().hex
        self._store(rows, name, not quiet, few=True)
        self._publish(head | {"commit": head["commit"] + 1, "seq": head["seq"] + count, "data": [*head["data"], name], "spec": self.spec.to_json()} | ({"quiet": [*head.get("quiet", []), name]} if quiet else {}))
        return head["seq"] + count

    def _store(self, rows: DataFrame, name: str, indexed: bool = True, few: bool = False) -> None:
        """Writes rows to a data folder by stripe, sorted by key, and then their index rows. few: the rows aren't dealt by stripe first."""
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in ROWS.fields]).withColumn("stripe", stripe())
        out = out if few else out.repartition("stripe").sortWithinPartitions("stripe", "pk", "sk")
        out.write.partitionBy("stripe").option("compression", "zstd").parquet(self._folder(name))
        for ix in self.spec.indexes if indexed else ():
            if ix.pk is None:
                continue  # its rows lie in the table's own stripe
            stored = self.spark.read.schema(ROWS).parquet(self._folder(name)).where("not deleted")
            keys = index_ops.index_view(ItemTable(stored, self.spec), dataclasses.replace(ix, projection="ALL")).select(*[F.col(f.name).cast(f.dataType) for f in INDEX_ROWS.fields]).withColumn("stripe", stripe())
            keys = keys if few else keys.repartition("stripe").sortWithinPartitions("stripe", "pk", "sk")
            keys.write.partitionBy("stripe").option("compression", "zstd").parquet(self._index_folder(ix.name, name))

    def _index_folder(self, index: str, name: str) -> str:
        return f"{self.path}/index={index}/part={name}"

    def _by_index(self, name: str, pk: str, now: float | None = None) -> DataFrame:
        """The live items that one key of an index leads to: of a local index its partition; of a global one the items whose newest version has an index row with that key."""
        import zlib

        ix, state = self.spec.index(name), self.head()
        if ix.pk is None:
            return self._live(self._partition([pk], state["commit"]), now)
        if not state.get("index"):
            return self._live(self.log(state["commit"]), now)
        folders = [self._index_folder(name, x) for x in state["data"] if x not in state.get("quiet", [])]
        if not folders:
            return self._live(self.log(state["commit"]), now).limit(0)
        stored = T.StructType([*INDEX_ROWS.fields, T.StructField("stripe", T.IntegerType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/index={name}").parquet(*folders)
        rows = rows.where((F.col("stripe") == zlib.crc32(pk.encode()) % STRIPES) & (F.col("pk") == pk)).select(F.col("base_pk").alias("_p"), F.col("base_sk").alias("_s"), F.col("seq").alias("_q")).distinct()
        stripes = [r[0] for r in rows.select(stripe("_p")).distinct().collect()]  # numbers below STRIPES
        log = self.log(state["commit"]).where(F.col("stripe").isin(stripes)).join(rows.select("_p").distinct(), F.col("pk") == F.col("_p"), "left_semi")
        return self._live(log, now).join(rows, F.expr("pk = _p and sk <=> _s and seq = _q"), "left_semi")

    def _check_items(self, rows: DataFrame) -> None:
        if self.spec.attributes:
            bad = rows.where(~F.col("deleted")).withColumn("v", violations(rows, self.spec.attributes)).where("size(v) > 0").select("pk", "v").take(1)
            if bad:
                raise ValidationFailed(f"{bad[0].pk}: {', '.join(bad[0].v)}")

    def write(self, operations: Iterable[Operation], atomic: bool = True, validate: bool = False, side_effects: bool = True) -> list[dict | None]:
        """All operations in one commit; the new item of each put and update.

        atomic: a false condition cancels everything (TransactionCanceled), and
        two operations on one key are refused. Else operations apply in order,
        a later one on the same key sees the earlier. Conditions and updates
        of operations on different keys are evaluated in one job. An operation
        that fails leaves nothing written. side_effects: whether indexes and
        the change feed see the writes.
        """
        ops = list(operations)
        keys = [_key(o.key) for o in ops]
        if atomic and len(set(keys)) < len(keys):
            raise TransactionCanceled("two operations on one key")
        for o in ops:
            if o.kind not in ("put", "update", "delete", "check"):
                raise InvalidArgument(f"operation {o.kind!r}")
        head = self.head()
        # keys travel as rows; the present items of the written keys alone come back
        wanted = self.spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "at int, pk string, sk string")
        present = self._live(self._partition([k[0] for k in dict.fromkeys(keys)], head["commit"])).alias("p")
        now = self._present(wanted, present)
        rows, results, seq, at = [], [], head["seq"], 0
        while at < len(ops):
            end = at + 1
            while end < len(ops) and keys[end] not in keys[at:end]:
                end += 1
            updated = self._evaluate(ops[at:end], keys[at:end], now, TransactionCanceled if atomic else ConditionalCheckFailed)
            for i, (o, k) in enumerate(zip(ops[at:end], keys[at:end])):
                if o.kind == "check":
                    results.append(None)
                    continue
                seq += 1
                attrs = {n: V.to_av(v) for n, v in (o.item or {}).items()} if o.kind == "put" else updated[i] if o.kind == "update" else None
                now[k] = attrs
                rows.append((*k, seq, attrs is None, self.now(), attrs))
                results.append(None if attrs is None else {n: V.from_av(dict(zip([f.name for f in V.AV.fields], a))) for n, a in attrs.items()})
            at = end
        if rows:
            df = self.spark.createDataFrame(rows, ROWS)
            if validate:
                self._check_items(df)
            self._commit(df, head, seq - head["seq"], not side_effects)
        return results

    def _present(self, wanted: DataFrame, present: DataFrame) -> dict:
        k = wanted.select("pk", "sk").distinct()
        found = present.join(k, (F.col("p.pk") == k.pk) & F.col("p.sk").eqNullSafe(k.sk), "left_semi").collect()
        names = [f.name for f in V.AV.fields]
        return {(r.pk, r.sk): {n: tuple(v[x] for x in names) for n, v in (r.attrs or {}).items()} for r in found}

    def _one(self, attrs: dict | None) -> DataFrame:
        return self.spark.createDataFrame([(attrs or {},)], T.StructType([T.StructField("attrs", V.ATTRS)]))

    def _evaluate(self, ops: list[Operation], keys: list, now: dict, error: type) -> dict[int, dict]:
        """The new attributes of each update, by its place; raises for a false condition. One job for all, none without conditions and updates."""
        from pyspark.errors import PySparkException

        from .errors import InvalidExpression

        tests: dict[tuple, list[int]] = {}
        sets: dict[tuple, list[int]] = {}
        for i, o in enumerate(ops):
            given = (repr(sorted(o.values.items(), key=repr)), repr(sorted(o.names.items())))
            if o.condition or o.kind == "check":
                tests.setdefault((o.condition or "", *given), []).append(i)
            if o.kind == "update":
                sets.setdefault((o.expression or "", *given), []).append(i)
        if not tests and not sets:
            return {}
        some = sorted({i for x in (tests, sets) for own in x.values() for i in own})
        df = self.spark.createDataFrame([(i, now.get(keys[i]) or {}) for i in some], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("attrs", V.ATTRS)]))
        ok: Column = F.lit(True)
        for own in tests.values():
            o = ops[own[0]]
            one = E.compile_condition(E.parse_condition(o.condition or "", o.values, o.names), E.Tagged("attrs", True))
            ok = F.when(F.col("i").isin(own), F.coalesce(one, F.lit(False))).otherwise(ok)
        new: Column = F.lit(None).cast(V.ATTRS)
        for own in sets.values():
            o = ops[own[0]]
            new = F.when(F.col("i").isin(own) & F.col("ok"), E.Tagged("attrs", True).apply(E.parse_update(o.expression or "", o.values, o.names))).otherwise(new)
        try:
            found = df.withColumn("ok", ok).select("i", "ok", new.alias("new")).collect()
        except PySparkException as e:
            raise InvalidExpression(str(e).split("\n")[0]) from None
        if bad := [r.i for r in found if not r.ok]:
            raise error(f"condition is false for {keys[min(bad)]}")
        names = [f.name for f in V.AV.fields]
        return {r.i: {n: tuple(v[x] for x in names) for n, v in r.new.items()} for r in found if r.new is not None}

    def put(self, key: Key, item: dict, condition: str | None = None, values: dict | None = None, names: dict | None = None, validate: bool = False) -> None:
        self._single(Operation("put", key, item, None, condition, values or {}, names or {}), validate)

    def delete(self, key: Key, condition: str | None = None, values: dict | None = None, names: dict | None = None) -> None:
        self._single(Operation("delete", key, None, None, condition, values or {}, names or {}))

    def update(self, key: Key, expression: str, condition: str | None = None, values: dict | None = None, names: dict | None = None) -> dict:
        """Applies an update expression; a missing item starts empty. Returns the new item."""
        return self._single(Operation("update", key, None, expression, condition, values or {}, names or {}))

    def _single(self, o: Operation, validate: bool = False):
        return self.write([o], atomic=False, validate=validate)[0]

    def append(self, rows: DataFrame, validate: bool = False) -> int:
        """Writes the rows of a DataFrame (pk, sk, attrs[, deleted][, at]) of any size in one commit; they never pass the driver.

        Of a repeated key an arbitrary row wins. Returns how many rows it wrote.
        """
        head = self.head()
        # sequence numbers by partition offsets: no sort, no single task
        extra = {"deleted": F.lit(False), "at": F.lit(self.now())}
        out = rows.select("pk", "sk", "attrs", *[c if c in rows.columns else v.alias(c) for c, v in extra.items()])
        out = out.withColumn("seq", F.lit(head["seq"]) + 1 + F.monotonically_increasing_id())
        if validate:
            self._check_items(out)
        name = uuid.uuid4().hex
        self._store(out, name)
        top = self.spark.read.schema(ROWS).parquet(self._folder(name)).agg(F.max("seq"), F.count("*")).first()
        if top[1]:
            self._publish(head | {"commit": head["commit"] + 1, "seq": top[0], "data": [*head["data"], name], "spec": self.spec.to_json()})
        return top[1]

    def put_many(self, rows: DataFrame, validate: bool = False) -> int:
        """Puts the rows of a DataFrame (pk, sk, attrs) of any size in one commit."""
        return self.append(rows.select("pk", "sk", "attrs"), validate)

    def batch_write(self, puts: Iterable[tuple[Key, dict]] = (), deletes: Iterable[Key] = (), operations: Iterable[Operation] = ()) -> int:
        """Ordered puts, then deletes, then operations; of one key the last wins. Returns how many were done."""
        ops = [*(Operation("put", k, i) for k, i in puts), *(Operation("delete", k) for k in deletes), *operations]
        self.write(ops, atomic=False)
        return len(ops)

    def transact_write(self, operations: Iterable[Operation], side_effects: bool = True) -> None:
        """All or nothing. side_effects=False: neither indexes nor the change feed see it."""
        self.write(operations, atomic=True, side_effects=side_effects)

    # reading

    def get(self, key: Key, exact: bool = False) -> dict | None:
        """The item of a key, or None. An expired one is None."""
        pk, sk = _key(key)
        rows = self._live(self._partition([pk])).where(F.col("sk").eqNullSafe(F.lit(sk))).select("attrs").take(1)
        return V.item(rows[0].attrs, exact) if rows else None

    def query(self, q: read.Query, now: float | None = None) -> Page:
        """The items of a partition, or of one of an index. Page.df has pk, sk, attrs."""
        if q.index_name:
            return read.query(ItemTable(self._by_index(q.index_name, _key(q.pk)[0], now).drop("stripe", "at"), self.spec), q)
        log = self._partition([_key(q.pk)[0]])
        page = read.query(ItemTable(self._live(log, now).select("pk", "sk", "attrs"), self.spec), q)
        if q.condition:
            log = log.where(read.sk_condition(*q.condition))
        page.matched = L.newest(log)
        return page

    def scan(self, s: read.Scan = read.Scan(), ordered: bool = False, now: float | None = None) -> Page:
        return read.scan(ItemTable(self.table(now).df.select("pk", "sk", "attrs"), self.spec), s, ordered=ordered)

    def scan_with_keys(self, limit: int | None = None) -> DataFrame:
        return read.scan_with_keys(ItemTable(self.table().df.select("pk", "sk", "attrs"), self.spec), limit)

    def batch_get(self, keys: Iterable[Key]) -> dict[tuple, dict]:
        ks = [_key(k) for k in keys]
        df = read.batch_get(ItemTable(self._live(self._partition([k[0] for k in ks])).select("pk", "sk", "attrs"), self.spec), ks)
        return {(r.pk, r.sk): V.item(r.attrs) for r in df.collect()}

    def transact_get(self, keys: Iterable[Key]) -> list[dict | None]:
        """The items in the order of the keys, from one snapshot."""
        ks = [_key(k) for k in keys]
        found = self.batch_get(ks)
        return [found.get(k) for k in ks]

    def index(self, name: str, over_log: bool = False) -> DataFrame:
        """The derived view of an index; over_log: of all versions."""
        t = ItemTable(self.log().drop("stripe", "at"), self.spec) if over_log else self.table()
        return index_ops.index_view(t, self.spec.index(name))

    # change feed

    def stream(self, after: int = 0) -> DataFrame:
        """Records later than `after`, oldest first, at most the last buffer_size; none if the feed is off."""
        s = self.spec.stream
        state = self.head()
        log = self.log(state["commit"], folders=True).drop("stripe")
        feed = cdc.changes(log.drop("part"), s.view if s else "KEYS_ONLY", time="at")
        if not s or not s.enabled:
            return feed.limit(0)
        if state.get("quiet"):
            feed = feed.join(log.where(F.col("part").isin(state["quiet"])).select("seq"), "seq", "left_anti")
        return cdc.read_after(cdc.buffer(feed, s.buffer_size), after)

    # maintenance

    def layout(self, state: dict | None = None) -> dict[int, list[str]]:
        """The data folders in use that hold rows of each stripe, oldest first."""
        state = state or self.head()
        out: dict[int, list[str]] = {}
        for name in state["data"]:
            fs, p = self._fs(self._folder(name))
            gone = set(state.get("gone", {}).get(name, ()))
            for x in fs.listStatus(p):
                n = x.getPath().getName()
                if n.startswith("stripe=") and int(n[7:]) not in gone:
                    out.setdefault(int(n[7:]), []).append(name)
        return out

    def compact(self, stripe_number: int | None = None, threshold: int = 1) -> dict:
        """Rewrites the log to its live items in one commit; older commits stay readable until vacuum().

        By default all of it; else one stripe, or the stripes with rows in
        `threshold` folders or more (two at least). Returns the counts of
        compact_stats.
        """
        return self._compact(stripe_number, threshold)[0]

    def _compact(self, stripe_number: int | None, threshold: int) -> tuple[dict, list[int]]:
        """The counts, and the stripes rewritten."""
        head = self.head()
        log = self.log(head["commit"])
        some = stripe_number is not None or threshold > 1
        layout = self.layout(head)
        chosen = sorted(n for n, names in layout.items() if (not some or len(names) >= max(2, threshold)) and stripe_number in (None, n))
        if some:
            log = log.where(F.col("stripe").isin(chosen))
        counts = L.compact_stats(log.drop("stripe")).first().asDict()
        if some and not chosen:
            return counts, chosen
        name = uuid.uuid4().hex
        self._store(L.compact(log.drop("stripe")), name)
        gone = {x: sorted({*head.get("gone", {}).get(x, ()), *(n for n in chosen if x in layout[n])}) for x in head["data"]}
        left = {x for n, names in layout.items() if n not in chosen for x in names}
        data = [x for x in head["data"] if x in left]
        self._publish(head | {"commit": head["commit"] + 1, "data": [*data, name], "gone": {x: gone[x] for x in data if gone[x]}, "spec": self.spec.to_json()})
        return counts, chosen

    def compact_due(self, threshold: int = 10) -> list[int]:
        """Compacts the stripes that have come to `threshold` folders, and no others; returns which."""
        return self._compact(None, max(2, threshold))[1]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data folders that none of the last `keep` commits uses, and the older commits. Returns how many folders went."""
        numbers = self.commits()
        used = {d for n in numbers[-max(1, keep):] for d in self.head(n)["data"]}
        fs, p = self._fs(f"{self.path}/data")
        gone = 0
        for x in fs.listStatus(p) if fs.exists(p) else []:
            if x.getPath().getName().removeprefix("part=") not in used:
                fs.delete(x.getPath(), True)
                for ix in self.spec.indexes:
                    fs.delete(self._fs(self._index_folder(ix.name, x.getPath().getName().removeprefix("part=")))[1], True)
                gone += 1
        for n in numbers[: -max(1, keep)]:
            fs.delete(self._fs(f"{self.path}/commits/{n:020d}.json")[1], False)
        return gone

    def purge_expired(self, now: float | None = None) -> int:
        """Tombstones for all expired items, in one commit."""
        if not self.spec.ttl:
            return 0
        at = self.now() / 1000 if now is None else now
        gone = ttl.expired(L.live(self.log()), self.spec.ttl, at)
        return self.append(gone.select("pk", "sk", F.lit(None).cast(V.ATTRS).alias("attrs"), F.lit(True).alias("deleted")))

    def stats(self) -> dict:
        """Counts of keys, partitions and stripes, and of the commits and data folders."""
        head = self.head()
        return L.stats(self.table().df).first().asDict() | {"commit": head["commit"], "seq": head["seq"], "data_folders": len(head["data"])}

    def health(self) -> str:
        """Healthy if the newest commit's data can be listed, else Unhealthy."""
        fs, _ = self._fs(self.path)
        return "Healthy" if all(fs.exists(self._fs(self._folder(d))[1]) for d in self.head()["data"]) else "Unhealthy"

    def snapshot(self, path: str) -> None:
        """Copies the live items to another folder as a table of its own."""
        other = Database.create(self.spark, path, self.spec, self.now)
        other.put_many(self.table().df.select("pk", "sk", "attrs"))

    def _sum(self, folder: str) -> list[int]:
        """Rows of a data folder, and a checksum of them in any order."""
        same = F.xxhash64("pk", "sk", "seq", "deleted", "at", F.to_json(F.array_sort(F.map_entries("attrs"))))
        n, h = self.spark.read.schema(ROWS).parquet(folder).agg(F.count("*"), F.sum(same.cast("decimal(38,0)"))).first()
        return [n, int(h or 0)]

    def push(self, path: str, verify: bool = False) -> dict:
        """Brings a copy of the table in another folder, of any file system that Spark has, up to this commit.

        Data folders never change, so only those go that aren't there; verify:
        those there are read, and go again if their checksum isn't what was
        sent. The copy is a table: open() reads it, its commits() are the
        snapshots, and its push() to a new folder restores it. Returns how
        many folders were copied and skipped.
        """
        head, other = self.head(), Database(self.spark, path, self.spec, self.now)
        fs, p = other._fs(f"{other.path}/commits")
        there = other.head() if fs.exists(p) and other.commits() else {"commit": -1, "sums": {}}
        sums, copied = dict(there.get("sums", {})), 0
        for name in head["data"]:
            if name in sums and (not verify or other._sum(other._folder(name)) == sums[name]):
                continue
            sums[name] = self._sum(self._folder(name))
            rows = self.spark.read.schema(T.StructType([*ROWS.fields, T.StructField("stripe", T.IntegerType())])).parquet(self._folder(name))
            rows.repartition("stripe").sortWithinPartitions("stripe", "pk", "sk").write.mode("overwrite").partitionBy("stripe").option("compression", "zstd").parquet(other._folder(name))
            copied += 1
        if there["commit"] < head["commit"]:
            other._publish(head | {"index": False, "sums": {x: sums[x] for x in head["data"]}})
        return {"copied": copied, "skipped": len(head["data"]) - copied}

    # statements

    def execute(self, text: str, limit_before_filter: bool = False, extended: bool = False) -> StatementResult:
        """Runs a PartiQL statement. Table names are free: there is one table."""
        s = P.parse(text, extended)
        if isinstance(s, P.Select):
            # a statement that names its keys opens their stripes alone
            pks = P.listed_keys(s)
            if pks is None or (s.index and len(pks) != 1):
                df = self.table().df
            else:
                df = (self._by_index(s.index, pks[0]) if s.index else self._live(self._partition(pks))).drop("stripe", "at")
            return StatementResult("select", P.run_select(s, ItemTable(df.drop("seq"), self.spec), None, limit_before_filter))
        if isinstance(s, P.Insert):
            self.put((s.pk, s.sk), s.item)
            return StatementResult("insert")
        key = (s.pk, s.sk)
        head = self.head()
        present = self._present(self.spark.createDataFrame([_key(key)], "pk string, sk string"), self._live(self._partition([_key(key)[0]], head["commit"])).alias("p"))
        now = present.get(_key(key))
        if s.condition is not None:
            one = lambda attrs: self.spark.createDataFrame([(attrs,)], T.StructType([T.StructField("attrs", V.ATTRS)]))
            ok = now is not None and one(now).select(E.compile_condition(s.condition, E.Tagged())).first()[0]
            if not ok:
                raise ConditionalCheckFailed(f"condition is false for {key}")
        if isinstance(s, P.Delete):
            self._commit(self.spark.createDataFrame([(*_key(key), head["seq"] + 1, True, self.now(), None)], ROWS), head, 1)
            return StatementResult("delete")
        row = self.spark.createDataFrame([(now or {},)], T.StructType([T.StructField("attrs", V.ATTRS)])).select(E.Tagged("attrs", True).apply(list(s.actions)).alias("attrs")).first()
        names = [f.name for f in V.AV.fields]
        attrs = {n: tuple(v[x] for x in names) for n, v in row.attrs.items()}
        self._commit(self.spark.createDataFrame([(*_key(key), head["seq"] + 1, False, self.now(), attrs)], ROWS), head, 1)
        return StatementResult("update", item={n: V.from_av(v) for n, v in row.attrs.items()})
