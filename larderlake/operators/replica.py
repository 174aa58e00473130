"""Replicas: difference, transfer, conflicts, vector clocks, hash trees, the offline queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument

KEYS = ("pk", "sk")


def _attributes(df: DataFrame, keys) -> list[str]:
    return sorted(c for c in df.columns if c not in keys)


def canonical(df: DataFrame, keys=KEYS) -> Column:
    """A text of an item that equal items share: attributes by name, absent ones left out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in _attributes(df, keys)]))


def leaves(df: DataFrame, keys=KEYS, value: Column | None = None) -> DataFrame:
    """(keys, hash): SHA-256 of key and value of each item."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    return df.select(*keys, F.sha2(F.concat(key, F.lit("\x1e"), value if value is not None else canonical(df, keys)), 256).alias("hash"))


def merkle_levels(hashed: DataFrame, keys=KEYS, fan_out: int = 16, buckets: int = 4096) -> DataFrame:
    """(level, node, hash): a tree over buckets of the key space, level 0 at the leaves' buckets, one root at the top.

    A bucket is part of the key's SHA-256, so equal tables have equal trees
    and a change touches one path. Its hash is of the number of its leaves and
    the sums of both halves of their hashes: no bucket is gathered, whatever
    its size. The hash of a higher node is of its children's, in order.
    fan_out: 2 at least.
    """
    if fan_out < 2:
        raise InvalidArgument("a tree needs a fan-out of 2 or more")
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    number = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("decimal(38,0)")
    bucket = F.pmod(number(F.sha2(key, 256), 1, 12).cast("long"), F.lit(buckets))
    sums = [F.sum(number("hash", at, 15)).cast("string") for at in (1, 33)]
    level = hashed.groupBy(bucket.alias("node")).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("hash"))
    out, n, i = level.select(F.lit(0).alias("level"), "node", "hash"), buckets, 0
    while n > 1:
        n, i = -(-n // fan_out), i + 1
        pairs = F.array_sort(F.collect_list(F.struct("node", "hash")))  # fan_out at most
        level = level.groupBy(F.expr(f"node div {fan_out}").alias("up")).agg(F.sha2(F.array_join(F.transform(pairs, lambda x: F.concat(x["node"].cast("string"), x["hash"])), ""), 256).alias("hash")).withColumnRenamed("up", "node")
        out = out.union(level.select(F.lit(i).alias("level"), "node", "hash"))
    return out


def diff(left: DataFrame, right: DataFrame, keys=KEYS, value_left: Column | None = None, value_right: Column | None = None) -> DataFrame:
    """(keys, kind): LocalOnly, RemoteOnly or Modified. Exact, over all rows."""
    a, b = leaves(left, keys, value_left), leaves(right, keys, value_right)
    return _outer(a, b, keys, ["hash"]).select(*keys, F.when(~F.col("__b"), "LocalOnly").when(~F.col("__a"), "RemoteOnly").when(F.col("l_hash") != F.col("r_hash"), "Modified").alias("kind")).where("kind is not null")


def _outer(a: DataFrame, b: DataFrame, keys, rest: list[str]) -> DataFrame:
    """Full outer join on null-safe keys: keys, l_*, r_*, __a, __b (whether the side is there). Sides may share a lineage."""

    def side(df: DataFrame, p: str, mark: str) -> DataFrame:
        own = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).alias(p + c) for c in rest]
        return df.select(*[F.col(f"`{k}`").alias(mark + k) for k in keys], *own, F.lit(True).alias(mark))

    same = " and ".join(f"`__a{k}` <=> `__b{k}`" for k in keys)
    both = side(a, "l_", "__a").join(side(b, "r_", "__b"), F.expr(same), "full_outer")
    there = [F.coalesce(m, F.lit(False)).alias(m) for m in ("__a", "__b")]
    return both.select(*[F.coalesce("__a" + k, "__b" + k).alias(k) for k in keys], *["l_" + c for c in rest], *["r_" + c for c in rest], *there)


STRATEGIES = ("lww", "fww", "local", "remote", "attr_merge")


def merge(local: DataFrame, remote: DataFrame, strategy: str | Callable[[DataFrame], DataFrame] = "lww", time: str = "updated_at", deleted: str | None = None, keys=KEYS) -> DataFrame:
    """Both replicas' items, one a key. Items on one side are kept; those on both are resolved by `strategy`.

    lww, fww: the later or earlier `time`; equal times go to local. local,
    remote: always that side. attr_merge: the union of attributes, shared ones
    from the later side; with `deleted` a later delete wins over the item and
    at equal times the item stays. A function gets the conflicts (keys, l_*,
    r_*) and gives the rows to keep, with the columns of local.
    """
    rest = [c for c in local.columns if c not in keys] + [c for c in remote.columns if c not in keys and c not in local.columns]
    both = _outer(local, remote, keys, rest)
    one = both.where("not (__a and __b)").select(*keys, *[F.coalesce("l_" + c, "r_" + c).alias(c) for c in rest])
    two = both.where("__a and __b")
    if callable(strategy):
        return one.unionByName(strategy(two.drop("__a", "__b")).select(*one.columns))
    return one.unionByName(two.select(*keys, *resolve(strategy, rest, time, deleted)))


def resolve(strategy: str, columns: list[str], time: str = "updated_at", deleted: str | None = None) -> list[Column]:
    """The columns of the item that wins, over l_* and r_*."""
    lt, rt = F.col("l_" + time), F.col("r_" + time)
    if strategy in ("lww", "fww", "local", "remote"):
        win = {"lww": lt >= rt, "fww": lt <= rt, "local": F.lit(True), "remote": F.lit(False)}[strategy]
        return [F.when(F.coalesce(win, rt.isNull()), F.col("l_" + c)).otherwise(F.col("r_" + c)).alias(c) for c in columns]
    if strategy != "attr_merge":
        raise InvalidArgument(f"strategy {strategy!r}")
    newer = F.coalesce(lt >= rt, rt.isNull())
    pick = lambda c: F.when(newer, F.coalesce("l_" + c, "r_" + c)).otherwise(F.coalesce("r_" + c, "l_" + c))
    if not deleted:
        return [pick(c).alias(c) for c in columns]
    ld, rd = F.coalesce(F.col("l_" + deleted), F.lit(False)), F.coalesce(F.col("r_" + deleted), F.lit(False))
    # one side deleted: the later side whole, the item at equal times
    item_left = rd & ~ld
    left = F.when(item_left, lt >= rt).when(ld & ~rd, lt > rt)
    return [F.when(ld != rd, F.when(left, F.col("l_" + c)).otherwise(F.col("r_" + c))).otherwise(pick(c)).alias(c) for c in columns]


def transfer(local: DataFrame, remote: DataFrame, keys=KEYS, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(rows to push, rows to pull): LocalOnly is pushed, RemoteOnly pulled, Modified both ways."""
    d = diff(local, remote, keys)

    def rows(df, kinds):
        k = d.where(F.col("kind").isin(kinds)).select(*[F.col(c).alias("__" + c) for c in keys])
        return df.join(k, F.expr(" and ".join(f"`{c}` <=> `__{c}`" for c in keys)), "left_semi")

    push, pull = rows(local, ["LocalOnly", "Modified"]), rows(remote, ["RemoteOnly", "Modified"])
    return (push if direction != "pull" else local.limit(0)), (pull if direction != "push" else remote.limit(0))


# Vector clocks: MAP<STRING, BIGINT>; an absent replica counts 0


def vclock_increment(clock: Column, replica: str) -> Column:
    now = F.coalesce(clock[replica], F.lit(0).cast("long")) + 1
    return F.map_concat(F.map_filter(clock, lambda k, _: k != replica), F.create_map(F.lit(replica), now))


def vclock_merge(a: Column, b: Column) -> Column:
    """The larger count of each replica."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("long")), F.coalesce(y, F.lit(0).cast("long"))))


def _all_le(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(a), lambda e: e["value"] <= F.coalesce(b[e["key"]], F.lit(0).cast("long")))


def vclock_compare(a: Column, b: Column) -> Column:
    """Equal, Before, After or Concurrent."""
    return F.when(_all_le(a, b) & _all_le(b, a), "Equal").when(_all_le(a, b), "Before").when(_all_le(b, a), "After").otherwise("Concurrent")


def vclock_happens_before(a: Column, b: Column) -> Column:
    return vclock_compare(a, b) == "Before"


def vclock_concurrent(a: Column, b: Column) -> Column:
    return vclock_compare(a, b) == "Concurrent"


def resolve_vclock(both: DataFrame, columns: list[str], clock: str = "clock", time: str = "updated_at") -> list[Column]:
    """Winner by clocks: an older side gives way, equal ones are local, concurrent ones go by time. The clock becomes the merged one."""
    order = vclock_compare(F.col("l_" + clock), F.col("r_" + clock))
    left = F.when(order == "Before", False).when(order.isin("After", "Equal"), True).otherwise(F.col("l_" + time) >= F.col("r_" + time))
    return [(vclock_merge(F.col("l_" + clock), F.col("r_" + clock)) if c == clock else F.when(left, F.col("l_" + c)).otherwise(F.col("r_" + c))).alias(c) for c in columns]


# The offline queue: rows (seq, pk, priority, queued_at, attempts, last_attempt), times in epoch seconds


def queue_state(queue: DataFrame, now: float, expiry: float = 86400, base: float = 1, most: int = 5) -> DataFrame:
    """queue with `state`: expired, failed (attempts used up), waiting (in its back-off of base * 2 ** min(attempts, 10)) or ready."""
    wait = F.lit(float(base)) * F.pow(F.lit(2.0), F.least("attempts", F.lit(10)))
    ready = F.col("last_attempt").isNull() | (F.col("last_attempt") + wait <= F.lit(float(now)))
    return queue.withColumn("state", F.when(F.lit(float(now)) - F.col("queued_at") > expiry, "expired").when(F.col("attempts") >= most, "failed").when(ready, "ready").otherwise("waiting"))


def queue_next(queue: DataFrame, now: float, limit: int | None = None, blocking: bool = False, **options) -> DataFrame:
    """Ready entries, highest priority first, first queued first. blocking: none after the first that waits."""
    states = queue_state(queue, now, **options)
    order = [F.col("priority").desc(), F.col("seq")]
    if blocking:
        first = states.where("state = 'waiting'").orderBy(*order).limit(1).select(F.col("priority").alias("_p"), F.col("seq").alias("_s"))
        states = states.join(F.broadcast(first), (F.col("priority") < F.col("_p")) | ((F.col("priority") == F.col("_p")) & (F.col("seq") > F.col("_s"))), "left_anti")
    out = states.where("state = 'ready'").orderBy(*order)
    return out if limit is None else out.limit(limit)


def tracked(changes: DataFrame, size: int = 10_000, seconds: int = 300, time: str = "at", keys=("pk", "sk")) -> DataFrame:
    """Pending changes: the last `size` of those that don't follow another of their key within `seconds`."""
    from ..streaming.cdc import dedup

    return dedup(changes, list(keys), time, seconds).orderBy(F.col("seq").desc()).limit(size)


def versions(df: DataFrame, keys=KEYS) -> DataFrame:
    """df with `version`: the place of a row among its key's by seq, from 1."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
