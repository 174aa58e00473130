"""Item tables: rows with pk, sk and attributes, from any DataFrame."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TableSpec


@dataclass(frozen=True)
class ItemTable:
    """df has pk, sk (null where there is none) and attributes. source: a typed column of `base` that pk is the text of.

    A condition on a cast key isn't pushed into a file scan, so pk conditions
    are put on the typed column as well.
    """

    df: DataFrame
    spec: TableSpec = TableSpec()
    base: DataFrame | None = None
    source: str | None = None
    select: tuple[Column, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def where_pk(self, values: list) -> DataFrame:
        """df with those partitions; the scan reads no others where the key is typed."""
        df = self.df
        if self.base is not None and self.source:
            kind = self.base.schema[self.source].dataType
            typed = []
            for v in values:
                if isinstance(kind, T.IntegralType):
                    try:
                        typed.append(int(v))
                    except (TypeError, ValueError):
                        continue
                else:
                    typed.append(v)
            limits = {T.IntegerType: 31, T.LongType: 63, T.ShortType: 15}
            bound = next((1 << b for k, b in limits.items() if isinstance(kind, k)), 1 << 63)
            typed = [x for x in typed if not isinstance(x, int) or -bound <= x < bound]
            df = self.base.where(F.col(self.source).isin(typed) if typed else F.lit(False)).select(*self.select)
        return df.where(F.col("pk") == F.lit(values[0]) if len(values) == 1 else F.col("pk").isin(values))

    def with_spec(self, **changes) -> ItemTable:
        return dataclasses.replace(self, spec=dataclasses.replace(self.spec, **changes))


def item_table(base: DataFrame, pk: str, sk: Column | str | None = None, attributes: list | None = None, spec: TableSpec = TableSpec()) -> ItemTable:
    """An item table with pk (and sk) as text of columns, and the other columns, or those named, as attributes."""
    key = F.col(pk).cast("string").alias("pk")
    sort = F.lit(None).cast("string") if sk is None else (F.col(sk) if isinstance(sk, str) else sk).cast("string")
    rest = attributes if attributes is not None else [c for c in base.columns if c != pk and c != sk]
    select = (key, sort.alias("sk"), *[F.col(c) if isinstance(c, str) else c for c in rest])
    typed = not isinstance(base.schema[pk].dataType, T.StringType)
    return ItemTable(base.select(*select), spec, base if typed else None, pk if typed else None, select)


def as_table(x) -> ItemTable:
    return x if isinstance(x, ItemTable) else ItemTable(x)
