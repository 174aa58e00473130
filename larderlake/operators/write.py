"""Writes as functions from a live view and operations to a new live view, on typed tables.

Operations are rows (op, pk, sk, seq, attributes) with op PUT or DELETE; all
of them are joined with the view at once. The schemaless, stored form is in
larderlake.database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TransactionCanceled
from ..plans import expr as E
from .log import live


def _log(table: DataFrame, seq: int = 0) -> DataFrame:
    return table.withColumn("seq", F.lit(seq).cast("long")).withColumn("deleted", F.lit(False))


def apply_operations(table: DataFrame, operations: DataFrame) -> DataFrame:
    """table after ordered puts and deletes: of each key the last operation wins. Not atomic by itself."""
    ops = operations.withColumn("deleted", F.col("op") == "DELETE").withColumn("seq", F.col("seq").cast("long") + 1).drop("op")
    return live(_log(table).unionByName(ops.select(*table.columns, "seq", "deleted"))).drop("seq")


def put(table: DataFrame, items: DataFrame) -> DataFrame:
    """table with items put; an item replaces the whole item of its key."""

    return live(_log(table).unionByName(_log(items.select(*table.columns), 1))).drop("seq")


def _keys(keys: DataFrame) -> DataFrame:
    """Distinct keys under names of their own, so that a join with a table they come from is clear."""
    return keys.select(F.col("pk").alias("__pk"), F.col("sk").alias("__sk")).distinct()


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """table without the items of those keys (pk, sk). Keys that aren't there don't matter."""
    return table.join(_keys(keys), F.expr("pk = __pk and sk <=> __sk"), "left_anti")


def update(table: DataFrame, where: Column, text: str, values: dict | None = None, names: dict | None = None) -> DataFrame:
    """table with an update expression applied to the rows where a condition holds; new attributes become columns."""
    new = E.Typed(table).apply(E.parse_update(text, values, names))
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, c).otherwise(F.col(f"`{n}`") if n in table.columns else F.lit(None)).alias(n) for n, c in new.items()])


def upsert(table: DataFrame, keys: DataFrame, text: str, values: dict | None = None, names: dict | None = None) -> DataFrame:
    """table with an update applied to each of the keys (pk, sk); a missing key starts from an empty item."""
    joined = table.join(_keys(keys).withColumn("__hit", F.lit(True)), F.expr("pk = __pk and sk <=> __sk"), "full_outer")
    joined = joined.select(F.coalesce("pk", "__pk").alias("pk"), F.coalesce("sk", "__sk").alias("sk"), *[f"`{c}`" for c in table.columns if c not in ("pk", "sk")], "__hit")
    return update(joined, F.col("__hit"), text, values, names).drop("__hit")


def put_if(table: DataFrame, items: DataFrame, condition: str, values: dict | None = None, names: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after, keys that failed): each item is put where the condition holds for the present item, absent ones as an empty item."""
    passed, failed = _split(table, items.select("pk", "sk"), condition, values, names)
    good = items.join(_keys(passed), F.expr("pk = __pk and sk <=> __sk"), "left_semi")
    return put(table, good), failed


def delete_if(table: DataFrame, keys: DataFrame, condition: str, values: dict | None = None, names: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after, keys that failed)."""
    passed, failed = _split(table, keys, condition, values, names)
    return delete(table, passed), failed


def update_if(table: DataFrame, keys: DataFrame, text: str, condition: str, values: dict | None = None, names: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after, keys that failed)."""
    passed, failed = _split(table, keys, condition, values, names)
    return upsert(table, passed, text, values, names), failed


def _split(table: DataFrame, keys: DataFrame, condition: str, values, names) -> tuple[DataFrame, DataFrame]:
    joined = _keys(keys).join(table, F.expr("pk = __pk and sk <=> __sk"), "left")
    joined = joined.select(F.col("__pk").alias("pk"), F.col("__sk").alias("sk"), *[f"`{c}`" for c in table.columns if c not in ("pk", "sk")])
    holds = E.condition(condition, table, values, names)
    checked = joined.select("pk", "sk", holds.alias("__ok"))
    return checked.where("__ok").select("pk", "sk"), checked.where("not __ok").select("pk", "sk")


def transact(table: DataFrame, puts: DataFrame | None = None, deletes: DataFrame | None = None, updates: list[tuple[DataFrame, str, dict | None]] = (), checks: list[tuple[DataFrame, str, dict | None]] = ()) -> DataFrame:
    """All or nothing: table after the writes if every check (keys, condition, values) holds for every key, else TransactionCanceled.

    All checks are evaluated in one job against the table as it is before.
    Two operations on one key are refused.
    """
    parts = [x.select("pk", "sk") for x in (puts, deletes) if x is not None] + [x[0].select("pk", "sk") for x in updates]
    if parts:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionAll(p)
        if every.groupBy("pk", "sk").count().where("count > 1").take(1):
            raise TransactionCanceled("two operations on one key")
    failed = None
    for keys, text, values in checks:
        bad = _split(table, keys, text, values, None)[1]
        failed = bad if failed is None else failed.unionAll(bad)
    if failed is not None and (row := failed.take(1)):
        raise TransactionCanceled(f"condition is false for {tuple(row[0])}")
    out = table
    for keys, text, values in updates:
        out = upsert(out, keys, text, values)
    if puts is not None:
        out = put(out, puts)
    return delete(out, deletes) if deletes is not None else out
