"""Descriptions of item tables: keys, indexes, time to live, change feed, attribute rules."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_ORDERS = ("bytes", "encoded")
PROJECTIONS = ("ALL", "KEYS_ONLY", "INCLUDE")
VIEWS = ("KEYS_ONLY", "NEW_IMAGE", "OLD_IMAGE", "NEW_AND_OLD_IMAGES")


@dataclass(frozen=True)
class IndexSpec:
    """A secondary ordering. Without `pk` it is local (the table's pk), with it global."""

    name: str
    sk: str | None = None
    pk: str | None = None
    projection: str = "ALL"
    include: tuple[str, ...] = ()

    @classmethod
    def local(cls, name: str, sort: str, projection: str = "ALL", include: tuple[str, ...] = ()) -> IndexSpec:
        return cls(name, sort, None, projection, tuple(include))

    @classmethod
    def global_(cls, name: str, partition: str, sort: str | None = None, projection: str = "ALL", include: tuple[str, ...] = ()) -> IndexSpec:
        return cls(name, sort, partition, projection, tuple(include))

    def keys_only(self) -> IndexSpec:
        return dataclasses.replace(self, projection="KEYS_ONLY")

    def including(self, *attributes: str) -> IndexSpec:
        return dataclasses.replace(self, projection="INCLUDE", include=tuple(attributes))


@dataclass(frozen=True)
class StreamSpec:
    """A change feed: which images it carries and how many records a bounded read returns."""

    enabled: bool = True
    view: str = "NEW_AND_OLD_IMAGES"
    buffer_size: int = 1000


@dataclass(frozen=True)
class AttributeSchema:
    """Rules for one attribute. kind: String, Number, Binary, Boolean, List, Map, Vector, Timestamp or None for any."""

    name: str
    kind: str | None = None
    required: bool = False
    min_value: float | None = None
    max_value: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    enum: tuple[Any, ...] | None = None


@dataclass(frozen=True)
class TableSpec:
    """Everything about a table but its rows. Kept as JSON beside the data."""

    indexes: tuple[IndexSpec, ...] = ()
    ttl: str | None = None
    stream: StreamSpec | None = None
    attributes: tuple[AttributeSchema, ...] = ()
    key_order: str = "bytes"

    def index(self, name: str) -> IndexSpec:
        from .errors import NotFound

        for i in self.indexes:
            if i.name == name:
                return i
        raise NotFound(f"no index {name!r}")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        x = json.loads(text)
        return cls(
            tuple(IndexSpec(**(i | {"include": tuple(i["include"])})) for i in x["indexes"]), x["ttl"], StreamSpec(**x["stream"]) if x["stream"] else None,
            tuple(AttributeSchema(**(a | {"enum": tuple(a["enum"]) if a["enum"] is not None else None})) for a in x["attributes"]), x["key_order"],
        )


@dataclass
class Page:
    """A lazy result: rows in key order. count, scanned_count and last_key run a job when asked for."""

    df: DataFrame
    matched: DataFrame | None = None
    keys: tuple[str, ...] = ("pk", "sk")
    _last: tuple | None = field(default=None, repr=False)

    @property
    def count(self) -> int:
        return self.df.count()

    @property
    def scanned_count(self) -> int:
        """Keys examined before tombstones and expired items were removed."""
        return (self.df if self.matched is None else self.matched).count()

    @property
    def last_key(self) -> tuple | None:
        """The key to go on after; the last returned one, also at the end. None of an empty page."""
        rows = self.df.select(*self.keys).tail(1)
        return tuple(rows[0]) if rows else None


@dataclass
class StatementResult:
    """What a statement gave. kind: select, insert, update or delete."""

    kind: str
    page: Page | None = None
    item: dict | None = None
    rows: DataFrame | None = None

    @property
    def items(self) -> DataFrame | None:
        return self.page.df if self.page else None


def existing(df: DataFrame, names) -> list[str]:
    return [x for x in names if x in df.columns]


def absent(kind: str = "string"):
    """A column of an attribute that no item has."""
    return F.lit(None).cast(kind)
