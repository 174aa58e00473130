"""Time to live: an item is expired when now is later than its TTL attribute, in epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def expires(df: DataFrame, attribute: str) -> Column:
    """Epoch seconds of the attribute as a double; null where absent or unparsable.

    Whole numbers and texts of them are seconds; timestamps, and TS values in
    milliseconds, are turned into seconds.
    """
    if "attrs" in df.columns and isinstance(df.schema["attrs"].dataType, T.MapType):
        v = F.col("attrs")[attribute]
        return F.when(v["t"] == "N", v["n"].try_cast("bigint").cast("double")).when(v["t"] == "TS", v["ts"] / 1000.0)
    kind = df.schema[attribute].dataType if attribute in df.columns else None
    if kind is None:
        return F.lit(None).cast("double")
    c = F.col(attribute)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(c.cast("timestamp")).cast("double")
    return c.try_cast("bigint").cast("double")


def live(df: DataFrame, attribute: str | None, now: float) -> DataFrame:
    """Rows that aren't expired. Strict: at the very second an item still lives."""
    if not attribute:
        return df
    return df.where(F.coalesce(~(F.lit(float(now)) > expires(df, attribute)), F.lit(True)))


def expired(df: DataFrame, attribute: str, now: float) -> DataFrame:
    return df.where(F.coalesce(F.lit(float(now)) > expires(df, attribute), F.lit(False)))
