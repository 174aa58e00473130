"""The test tables as item tables: which columns are keys, which are attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IndexSpec, TableSpec
from .items import ItemTable, item_table


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark, d, spec: TableSpec | None = None) -> ItemTable:
    """pk o_custkey, sk o_orderkey; local index on the price."""
    spec = spec or TableSpec(indexes=(IndexSpec.local("by_price", "o_totalprice"), IndexSpec.local("by_date", "o_orderdate", "INCLUDE", ("o_orderstatus",))))
    return item_table(raw(spark, d, "orders"), "o_custkey", "o_orderkey", spec=spec)


def orders_by_id(spark, d, spec: TableSpec = TableSpec()) -> ItemTable:
    """pk o_orderkey, no sk."""
    return item_table(raw(spark, d, "orders"), "o_orderkey", spec=spec)


def customers(spark, d, spec: TableSpec | None = None) -> ItemTable:
    """pk c_custkey, no sk; global index by market segment and balance."""
    spec = spec or TableSpec(indexes=(
        IndexSpec.global_("by_segment", "c_mktsegment", "c_acctbal"), IndexSpec.global_("segment_names", "c_mktsegment", "c_acctbal", "INCLUDE", ("c_name",)),
        IndexSpec.global_("segment_keys", "c_mktsegment", "c_acctbal", "KEYS_ONLY"),
    ))
    return item_table(raw(spark, d, "customer"), "c_custkey", spec=spec)


def lines(spark, d) -> ItemTable:
    """pk l_orderkey, sk l_linenumber#l_partkey#l_suppkey."""
    df = raw(spark, d, "lineitem")
    sk = F.concat_ws("#", "l_linenumber", "l_partkey", "l_suppkey")
    return item_table(df, "l_orderkey", sk, [c for c in df.columns if c not in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def line_log(spark, d) -> DataFrame:
    """lineitem as a version log: pk l_orderkey, sk l_linenumber, returned lines as tombstones."""
    df = raw(spark, d, "lineitem")
    return df.select(
        F.col("l_orderkey").cast("string").alias("pk"), F.col("l_linenumber").cast("string").alias("sk"), (F.col("l_partkey").cast("long") * 100000 + F.col("l_suppkey")).alias("seq"),
        (F.col("l_returnflag") == "R").alias("deleted"), "l_quantity", "l_extendedprice", "l_linestatus",
    )


def parts(spark, d) -> ItemTable:
    return item_table(raw(spark, d, "part"), "p_partkey")


def suppliers(spark, d) -> ItemTable:
    return item_table(raw(spark, d, "supplier"), "s_suppkey")


def event_log(spark, d) -> DataFrame:
    """events as a version log: pk user_id, seq event_id, errors as tombstones."""
    return raw(spark, d, "events").select(F.col("user_id").cast("string").alias("pk"), F.lit(None).cast("string").alias("sk"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") == "error").alias("deleted"), "event_type", "value")


def chats(spark, d) -> ItemTable:
    return item_table(raw(spark, d, "conversations"), "conv_id", "turn")


def web(spark, d) -> ItemTable:
    return item_table(raw(spark, d, "pages"), "page_id")


def vectors(spark, d) -> ItemTable:
    return item_table(raw(spark, d, "embeddings"), "label", "vec_id")
