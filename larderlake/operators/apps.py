"""What applications over item tables ask: top lists, tags, an author's newest, nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.items import as_table


def top(df: DataFrame, by: str, n: int, key: str = "pk") -> DataFrame:
    """The n items with the highest attribute; ties by key."""
    return df.orderBy(F.col(by).desc_nulls_last(), key).limit(n)


def _tags(column: str):
    return F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    """(tag, n) of comma-separated tags."""
    return df.select(F.explode(_tags(column)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def by_tag(df: DataFrame, column: str, tag: str, newest: str) -> DataFrame:
    """Items with a tag, whatever its case, newest first."""
    return df.where(F.exists(_tags(column), lambda x: F.lower(x) == tag.lower())).orderBy(F.col(newest).desc_nulls_last())


def newest_of(table, pk: str, time: str) -> DataFrame:
    """A partition's items, newest first."""
    return as_table(table).where_pk([pk]).orderBy(F.col(time).desc_nulls_last())


def nearest(df: DataFrame, column: str, key: str, n: int, to: int = 0) -> DataFrame:
    """(key, similarity): the n vectors with the highest cosine to the vector of key `to`."""
    one = df.where(F.col(key) == to).select(F.col(column).alias("__q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, q = F.col(column), F.col("__q")
    both = df.join(F.broadcast(one))  # one row
    return both.select(key, (dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))).alias("similarity")).orderBy(F.col("similarity").desc(), key).limit(n)
