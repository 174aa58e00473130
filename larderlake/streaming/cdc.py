"""Change feeds: INSERT, MODIFY and REMOVE records from a version log, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import InvalidArgument
from ..model import VIEWS

KEYS = ("pk", "sk")


def changes(log: DataFrame, view: str = "NEW_AND_OLD_IMAGES", keys: tuple[str, ...] = KEYS, time: str | None = None) -> DataFrame:
    """(seq, op, keys, old_image, new_image[, time]) of a whole log (keys, seq, deleted, attributes).

    A write is an INSERT if its key had no live item, else a MODIFY; a delete
    is a REMOVE if there was one, else nothing. Images are structs of the
    attributes; the view decides which ones are kept.
    """
    if view not in VIEWS:
        raise InvalidArgument(f"view {view!r}")
    rest = [c for c in log.columns if c not in (*keys, "seq", "deleted", time)]
    image = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("string").alias("_"))
    w = Window.partitionBy(*keys).orderBy("seq")
    there = F.coalesce(~F.lag("deleted").over(w), F.lit(False))
    rows = log.withColumn("__there", there).withColumn("__image", image).withColumn("__old", F.lag("__image").over(w))
    op = F.when(F.col("deleted") & F.col("__there"), "REMOVE").when(~F.col("deleted") & F.col("__there"), "MODIFY").when(~F.col("deleted"), "INSERT")
    old = F.when(F.col("__there") & F.lit(view in ("OLD_IMAGE", "NEW_AND_OLD_IMAGES")), F.col("__old"))
    new = F.when(~F.col("deleted") & F.lit(view in ("NEW_IMAGE", "NEW_AND_OLD_IMAGES")), F.col("__image"))
    return rows.select("seq", op.alias("op"), *keys, old.alias("old_image"), new.alias("new_image"), *([time] if time else [])).where("op is not null")


def read_after(feed: DataFrame, after: int) -> DataFrame:
    """Records later than a sequence number, oldest first."""
    return feed.where(F.col("seq") > after).orderBy("seq")


def buffer(feed: DataFrame, size: int = 1000) -> DataFrame:
    """The last `size` records."""
    return feed.orderBy(F.col("seq").desc()).limit(max(0, size))


def replay(base: DataFrame, feed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The live view that a feed with new images leads to from an older one."""
    attributes = [c for c in base.columns if c not in keys]
    last = feed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seq").desc()))).where("__r = 1")
    gone = last.select(*[F.col(k).alias("__" + k) for k in keys])
    kept = base.join(gone, F.expr(" and ".join(f"`{k}` <=> `__{k}`" for k in keys)), "left_anti")
    return kept.unionByName(last.where("op <> 'REMOVE'").select(*keys, *[F.col("new_image")[c].alias(c) for c in attributes]))


def dedup(records: DataFrame, keys: list[str], time: str, seconds: int = 300) -> DataFrame:
    """Records without those that come at most `seconds` after another of the same keys."""
    w = Window.partitionBy(*keys).orderBy(time)
    last = F.lag(time).over(w)
    return records.withColumn("__last", last).where(F.col("__last").isNull() | (F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.col("__last").cast("timestamp")) > seconds)).drop("__last")


def stream_changes(log: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """A streaming DataFrame of (key, seq, op, old_image, new_image as JSON) from a streaming log (key, seq, deleted, attributes).

    One value a key is state: its live item or nothing. Rows of a key are put
    in seq order within a micro-batch; over batches the source must be in
    order. State isn't bounded in time, as a feed never forgets a key. Needs
    the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    columns = list(attributes)
    schema = T.StructType([T.StructField(key, log.schema[key].dataType), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("old_image", T.StringType()), T.StructField("new_image", T.StringType())])

    class Changes(StatefulProcessor):
        def init(self, handle):
            self.item = handle.getValueState("item", "image string")

        def handleInputRows(self, key_, rows, timers):
            image = self.item.get()[0] if self.item.exists() else None
            out = []
            for part in [pd.concat(list(rows)).sort_values("seq", kind="stable")]:
                for seq, gone, text in zip(part["seq"], part["deleted"], part["image"]):
                    if gone and image is not None:
                        out.append((key_[0], seq, "REMOVE", image, None))
                    elif not gone:
                        out.append((key_[0], seq, "INSERT" if image is None else "MODIFY", image, text))
                    image = None if gone else text
            if image is None:
                self.item.clear()
            else:
                self.item.update((image,))
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

        def close(self):
            pass

    rows = log.select(key, F.col("seq").cast("long"), "deleted", F.to_json(F.struct(*columns)).alias("image"))
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Changes(), outputStructType=schema, outputMode="append", timeMode="none")
