"""Reads: get, query, scan, and many keys at once. Every function takes rows and gives rows, lazily."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import keys as K
from ..model import Page
from ..sources.items import ItemTable, as_table
from . import ttl
from .index import index_view


def sk_condition(op: str, *v: Any) -> Column:
    """A condition on sk by plain byte order; rows without sk never fit."""
    sk = F.col("sk")
    try:
        return {
            "=": lambda a: sk == F.lit(a), "<": lambda a: sk < F.lit(a), "<=": lambda a: sk <= F.lit(a), ">": lambda a: sk > F.lit(a), ">=": lambda a: sk >= F.lit(a),
            "between": lambda a, b: sk.between(F.lit(a), F.lit(b)), "begins_with": lambda a: F.startswith(sk, F.lit(a)), "in": lambda *a: sk.isin(*a),
        }[op](*v)
    except KeyError:
        raise InvalidArgument(f"sort-key condition {op!r}") from None


@dataclass(frozen=True)
class Query:
    """A partition query, built step by step: Query("user#1").sk_begins_with("post#").forward(False).limit(10)."""

    pk: Any
    condition: tuple | None = None
    is_forward: bool = True
    most: int | None = None
    after: tuple | None = None
    index_name: str | None = None

    def _sk(self, *c) -> Query:
        return dataclasses.replace(self, condition=c)  # one condition: the last given

    def sk_eq(self, v) -> Query:
        return self._sk("=", v)

    def sk_lt(self, v) -> Query:
        return self._sk("<", v)

    def sk_lte(self, v) -> Query:
        return self._sk("<=", v)

    def sk_gt(self, v) -> Query:
        return self._sk(">", v)

    def sk_gte(self, v) -> Query:
        return self._sk(">=", v)

    def sk_between(self, a, b) -> Query:
        return self._sk("between", a, b)

    def sk_begins_with(self, p) -> Query:
        return self._sk("begins_with", p)

    def forward(self, yes: bool) -> Query:
        return dataclasses.replace(self, is_forward=yes)

    def limit(self, n: int) -> Query:
        return dataclasses.replace(self, most=n)

    def start_after(self, pk, sk=None) -> Query:
        return dataclasses.replace(self, after=(pk, sk))

    def index(self, name: str) -> Query:
        return dataclasses.replace(self, index_name=name)


@dataclass(frozen=True)
class Scan:
    """A scan of all items: Scan().segment(0, 4).limit(100)."""

    most: int | None = None
    after: tuple | None = None
    part: tuple[int, int] | None = None

    def limit(self, n: int) -> Scan:
        return dataclasses.replace(self, most=n)

    def start_after(self, pk, sk=None) -> Scan:
        return dataclasses.replace(self, after=(pk, sk))

    def segment(self, i: int, n: int) -> Scan:
        if not 0 <= i < n:
            raise InvalidArgument(f"segment {i} of {n}")
        return dataclasses.replace(self, part=(i, n))


def _standing(df: DataFrame, table: ItemTable, now: float | None) -> DataFrame:
    """Without tombstones and expired items."""
    if "deleted" in df.columns:
        df = df.where(~F.col("deleted")).drop("deleted")
    return ttl.live(df, table.spec.ttl, now) if now is not None else df


def get(table, pk, sk=None, now: float | None = None) -> DataFrame:
    """The item with that key, or no row. Without sk: the item that has none."""
    t = as_table(table)
    return _standing(t.where_pk([pk]).where(F.col("sk").eqNullSafe(F.lit(sk).cast(t.df.schema["sk"].dataType))), t, now)


def query(table, q: Query, now: float | None = None, where: Column | None = None) -> Page:
    """The items of one partition in key order, or backwards. A limit counts what is returned; 0 gives none.

    In an index the order is by the index's sort key, then by the table's key.
    """
    t = as_table(table)
    mode = t.spec.key_order
    if q.index_name:
        ix = t.spec.index(q.index_name)
        # a local index has the table's pk, so its partition alone is read
        base = t if ix.pk is not None else ItemTable(t.where_pk([q.pk]), t.spec)
        df = index_view(base, ix).where(F.col("pk") == F.lit(q.pk))
        sort = [F.col("sk"), F.col("base_pk"), F.col("base_sk")]
        sort = [c.asc_nulls_first() if q.is_forward else c.desc_nulls_last() for c in sort]
        bound = None if q.after is None else (F.col("sk") > F.lit(q.after[1])) if q.is_forward else (F.col("sk") < F.lit(q.after[1]))
    else:
        df = t.where_pk([q.pk])
        sort = K.order(mode, not q.is_forward)
        bound = None if q.after is None else K.beyond(q.after, mode, not q.is_forward)
    if q.condition:
        df = df.where(sk_condition(*q.condition))
    if bound is not None:
        df = df.where(bound)
    if where is not None:
        df = df.where(where)
    out = _standing(df, t, now).orderBy(*sort)
    return Page(out if q.most is None else out.limit(max(0, q.most)), df)


def scan(table, s: Scan = Scan(), now: float | None = None, ordered: bool = False) -> Page:
    """All items. In key order if limited or asked for: a sort of a whole table is work that few need."""
    t = as_table(table)
    df = t.df
    if s.part:
        df = df.where(K.stripe() % s.part[1] == s.part[0])
    if s.after:
        df = df.where(K.beyond(s.after, t.spec.key_order))
    out = _standing(df, t, now)
    if s.most is not None or ordered:
        out = out.orderBy(*K.order(t.spec.key_order))
    return Page(out if s.most is None else out.limit(max(0, s.most)), df)


def scan_with_keys(table, limit: int | None = None, now: float | None = None) -> DataFrame:
    """Keys and items without the rows of replica metadata (`_sync#`)."""
    t = as_table(table)
    df = _standing(t.df.where(~F.startswith(F.col("pk"), F.lit("_sync#"))), t, now)
    return df if limit is None else df.orderBy(*K.order(t.spec.key_order)).limit(limit)


def key_rows(spark: SparkSession, wanted: Iterable) -> DataFrame:
    """(at, pk, sk) of keys: a pk, or (pk, sk)."""
    rows = [(i, *(k if isinstance(k, tuple) else (k, None))) for i, k in enumerate(wanted)]
    return spark.createDataFrame(rows, "at int, pk string, sk string")


_SAME = "pk = __pk and sk <=> __sk"
LISTED = 10_000  # keys in a list up to which the scan gets them as a condition


def _of_keys(t: ItemTable, wanted) -> DataFrame:
    """The table's rows, of the partitions of a list of keys alone."""
    pks = list(dict.fromkeys(k[0] if isinstance(k, tuple) else k for k in wanted)) if not isinstance(wanted, DataFrame) else []
    return t.where_pk(pks) if 0 < len(pks) <= LISTED else t.df


def batch_get(table, wanted: DataFrame | list, now: float | None = None) -> DataFrame:
    """The items found among the keys, each once; missing ones are silently absent.

    wanted: a list of keys, or a DataFrame (pk, sk) of any size. Spark knows
    the size of either and sends it to the tasks only if it is small.
    """
    t = as_table(table)
    wanted = wanted if isinstance(wanted, DataFrame) else list(wanted)
    w = (key_rows(t.df.sparkSession, wanted) if not isinstance(wanted, DataFrame) else wanted).select(F.col("pk").alias("__pk"), F.col("sk").alias("__sk")).distinct()
    return _standing(_of_keys(t, wanted), t, now).join(w, F.expr(_SAME), "left_semi")


def txn_get(table, wanted: list, now: float | None = None) -> DataFrame:
    """A row for each key in the order given (`at`), found or not: `found`, and the item's columns or nulls."""
    t = as_table(table)
    w = key_rows(t.df.sparkSession, wanted).toDF("__at", "__pk", "__sk")
    df = _standing(_of_keys(t, wanted), t, now)
    rest = [f"`{c}`" for c in df.columns if c not in ("pk", "sk")]
    out = w.join(df, F.expr(_SAME), "left")
    return out.select(F.col("__at").alias("at"), F.col("__pk").alias("pk"), F.col("__sk").alias("sk"), F.col("pk").isNotNull().alias("found"), *rest).orderBy("at")


def multiget(table, pks: list, now: float | None = None) -> DataFrame:
    """The partitions in the order of a list (each once), each in key order, as a column `at` says."""
    t = as_table(table)
    listed = list(dict.fromkeys(pks))
    w = t.df.sparkSession.createDataFrame(list(enumerate(listed)), "at int, pk string")
    return _standing(t.where_pk(listed), t, now).join(w, "pk").orderBy("at", *K.order(t.spec.key_order)) if listed else t.df.where("false").withColumn("at", F.lit(0))
