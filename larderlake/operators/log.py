"""The version log: every write is a row (pk, sk, seq, deleted, attributes); the highest seq of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ttl

KEYS = ("pk", "sk")


def newest(log: DataFrame, keys: tuple[str, ...] = KEYS, seq: str = "seq") -> DataFrame:
    """One row a key: the one with the highest seq, tombstones among them.

    Spark drops all but the first of a key before the shuffle as well, so old
    versions that lie together never move.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc()))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def live(log: DataFrame, keys: tuple[str, ...] = KEYS, ttl_attribute: str | None = None, now: float | None = None) -> DataFrame:
    """The live view: newest versions that are neither tombstones nor expired, without `deleted`."""
    out = newest(log, keys).where(~F.col("deleted")).drop("deleted")
    return ttl.live(out, ttl_attribute, now) if now is not None else out


def compact(log: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The log that a compaction leaves: what live() gives, still as a log."""
    return newest(log, keys).where(~F.col("deleted"))


def compact_stats(log: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row: versions_in, keys, records_removed, tombstones_removed, records_out."""
    per = log.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("deleted", "seq").alias("gone"))
    out = per.agg(F.sum("n").alias("versions_in"), F.count("*").alias("keys"), F.sum(F.col("gone").cast("long")).alias("tombstones_removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        zero(F.col("versions_in")).alias("versions_in"), zero(F.col("keys")).alias("keys"), zero(F.col("versions_in") - F.col("keys")).alias("records_removed"),
        zero(F.col("tombstones_removed")).alias("tombstones_removed"), zero(F.col("keys") - F.col("tombstones_removed")).alias("records_out"),
    )


def stats(table: DataFrame) -> DataFrame:
    """One row: total_keys, partitions, stripes_used."""
    from ..functions.keys import stripe

    one = table.select("pk", "sk", stripe().alias("stripe"))
    return one.agg(F.count("*").alias("total_keys"), F.countDistinct("pk").alias("partitions"), F.countDistinct("stripe").alias("stripes_used"))


def purge(table: DataFrame, attribute: str, now: float, seq: Column) -> DataFrame:
    """Tombstones for the expired items, to be appended to the log."""
    gone = ttl.expired(table, attribute, now)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in ("pk", "sk", "seq", "deleted")]
    return gone.select("pk", "sk", seq.alias("seq"), F.lit(True).alias("deleted"), *rest)
