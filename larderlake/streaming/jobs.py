"""Streams run to their end: what a batch caller needs of a streaming operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from .cdc import stream_changes


def run_to_end(spark: SparkSession, d: str) -> DataFrame:
    """(pk, seq, op): the change feed of the events table, streamed with state into Parquet until no input is left."""
    path = shared_dir(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    rows = events.select(F.col("user_id").cast("string").alias("pk"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") == "error").alias("deleted"), "event_type", "value")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream_changes(rows, "pk", ["event_type", "value"]).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.parquet(f"{path}/out").select("pk", "seq", "op")
