"""Secondary indexes as derived views: always consistent with the table, sparse, sorted by logical values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..model import IndexSpec
from ..sources.items import ItemTable


def _value(df: DataFrame, name: str) -> Column:
    """An attribute as an index key; null where it can't be one (absent, list, map, vector, explicit Null)."""
    if "attrs" in df.columns and isinstance(df.schema["attrs"].dataType, T.MapType):
        v = F.col("attrs")[name]
        return F.when(v["t"] == "N", v["n"]).when(v["t"] == "S", v["s"]).when(v["t"] == "BOOL", v["bool"].cast("string")).when(v["t"] == "TS", v["ts"].cast("string")).when(v["t"] == "B", F.hex(v["b"]))
    if name not in df.columns:
        return F.lit(None).cast("string")
    if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast("string")
    return F.col(name)


def index_view(table: ItemTable, index: IndexSpec, text: bool = False) -> DataFrame:
    """(pk, sk, base_pk, base_sk, attributes): the table by the index's keys.

    Rows without an index key are absent. Sort keys keep their column's type,
    so numbers sort as numbers; text: they compare as text, as they always do
    for schemaless items, whose kinds may be mixed. Index keys are
    attributes too. An index over a version log (columns seq, deleted) gives
    the rows of all versions.
    """
    df = table.df
    if index.projection not in ("ALL", "KEYS_ONLY", "INCLUDE"):
        raise InvalidArgument(f"projection {index.projection!r}")
    pk = F.col("pk") if index.pk is None else _value(df, index.pk).cast("string")
    sk = _value(df, index.sk) if index.sk else F.lit(None).cast("string")
    if text:
        sk = sk.cast("string")
    out = df.select(pk.alias("pk"), sk.alias("sk"), F.col("pk").alias("base_pk"), F.col("sk").alias("base_sk"), *[c for c in df.columns if c not in ("pk", "sk")])
    out = out.where("pk is not null").where(F.col("sk").isNotNull() if index.sk else F.lit(True))
    return project(out, index)


def project(view: DataFrame, index: IndexSpec) -> DataFrame:
    """The columns that the index's projection keeps, its own key attributes among them."""
    if index.projection == "ALL":
        return view
    own = {index.pk, index.sk} | (set(index.include) if index.projection == "INCLUDE" else set())
    keys = ["pk", "sk", "base_pk", "base_sk"]
    if "attrs" in view.columns and isinstance(view.schema["attrs"].dataType, T.MapType):
        names = sorted(x for x in own if x)
        return view.select(*keys, F.map_filter("attrs", lambda k, _: k.isin(names)).alias("attrs"))
    return view.select(*keys, *[c for c in view.columns if c in own and c not in keys])
