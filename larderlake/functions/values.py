"""Dynamically typed values: Python objects, tagged structs, and text of numbers.

A schemaless item is a map from attribute to a tagged struct AV. t is one of
N, S, B, BOOL, NULL, L, M, VEC, TS; the payload stands in the field of that
kind. Numbers keep their text. Lists and maps are tagged JSON text in j, so
nested values keep their kinds as well.
"""

from __future__ import annotations

import base64
import json
import math
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

AV = T.StructType([
    T.StructField("t", T.StringType()), T.StructField("n", T.StringType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType()),
    T.StructField("bool", T.BooleanType()), T.StructField("ts", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("j", T.StringType()),
])
ATTRS = T.MapType(T.StringType(), AV)
#: Kind names of attribute rules by tag; NULL has none.
KINDS = {"N": "Number", "S": "String", "B": "Binary", "BOOL": "Boolean", "L": "List", "M": "Map", "VEC": "Vector", "TS": "Timestamp"}


@dataclass(frozen=True)
class Number:
    """A number by its text."""

    text: str


@dataclass(frozen=True)
class Timestamp:
    """Milliseconds since the epoch, negative before it."""

    ms: int


@dataclass(frozen=True)
class Vector:
    """Floats of 32 bits."""

    values: tuple[float, ...]


def number_text(x: int | float | Decimal) -> str:
    """Shortest decimal text without an exponent; whole floats without a fraction."""
    if isinstance(x, bool):
        raise InvalidArgument("a boolean is not a number")
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float) and not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    text = format(Decimal(repr(x)) if isinstance(x, float) else x, "f")
    return text.rstrip("0").rstrip(".") if isinstance(x, float) and "." in text else text


def tag(x: Any) -> dict:
    """A Python object as {tag: payload}, nested values too. JSON can carry it."""
    if x is None:
        return {"NULL": True}
    if isinstance(x, bool):
        return {"BOOL": x}
    if isinstance(x, Number):
        return {"N": x.text}
    if isinstance(x, (int, float, Decimal)):
        return {"N": number_text(x)}
    if isinstance(x, str):
        return {"S": x}
    if isinstance(x, (bytes, bytearray)):
        return {"B": base64.b64encode(bytes(x)).decode()}
    if isinstance(x, Timestamp):
        return {"TS": x.ms}
    if isinstance(x, Vector):
        return {"VEC": list(x.values)}
    if isinstance(x, (list, tuple)):
        return {"L": [tag(y) for y in x]}
    if isinstance(x, dict):
        return {"M": {k: tag(v) for k, v in x.items()}}
    raise InvalidArgument(f"no value kind for {type(x).__name__}")


def untag(x: dict, exact: bool = False) -> Any:
    """The Python object of {tag: payload}. exact: numbers as Number, else int or float where the text is one."""
    (t, p), = x.items()
    if t == "NULL":
        return None
    if t == "N":
        return Number(p) if exact else plain_number(p)
    if t == "B":
        return base64.b64decode(p)
    if t == "TS":
        return Timestamp(p)
    if t == "VEC":
        return Vector(tuple(p))
    if t == "L":
        return [untag(y, exact) for y in p]
    if t == "M":
        return {k: untag(v, exact) for k, v in p.items()}
    return p


def plain_number(text: str) -> int | float | str:
    """The int of a text, else its float, else the text."""
    if re.fullmatch(r"[+-]?\d+", text) and abs(int(text)) < 1 << 63:
        return int(text)
    try:
        x = float(text)
        return x if math.isfinite(x) else text
    except ValueError:
        return text


def to_av(x: Any) -> tuple:
    """A Python object as the row of an AV."""
    (t, p), = tag(x).items()
    fields = dict.fromkeys(("n", "s", "b", "bool", "ts", "vec", "j"))
    if t in ("L", "M"):
        fields["j"] = json.dumps(p, ensure_ascii=False, sort_keys=True)
    elif t == "B":
        fields["b"] = bytes(x)
    elif t != "NULL":
        fields[{"N": "n", "S": "s", "BOOL": "bool", "TS": "ts", "VEC": "vec"}[t]] = p
    return (t, *fields.values())


def from_av(row, exact: bool = False) -> Any:
    """The Python object of an AV row."""
    if row["t"] in ("L", "M"):
        return untag({row["t"]: json.loads(row["j"])}, exact)
    if row["t"] == "B":
        return bytes(row["b"])
    p = {"N": "n", "S": "s", "BOOL": "bool", "TS": "ts", "VEC": "vec"}.get(row["t"])
    return untag({row["t"]: row[p] if p else True}, exact)


def item(attrs, exact: bool = False) -> dict[str, Any]:
    """The Python dict of an attrs map."""
    return {k: from_av(v, exact) for k, v in (attrs or {}).items()}


def av_literal(x: Any) -> Column:
    """An AV as a literal column."""
    row = to_av(x)
    parts = []
    for f, v in zip(AV.fields, row):
        c = F.array(*[F.lit(float(y)).cast("float") for y in v]) if isinstance(v, list) else F.lit(v)
        parts.append((c if v is not None else F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*parts)


def av_number(text: Column) -> Column:
    """An AV of a number's text."""
    return F.struct(F.lit("N").alias("t"), text.alias("n"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in AV.fields[2:]])


def double_text(x: Column) -> Column:
    """Decimal text of a double: no exponent, no fraction where it is whole."""
    plain = F.format_string("%.0f", x)
    text = x.cast("string")
    small = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when((x == F.floor(x)) | (F.abs(x) >= 1e15), plain).when(text.contains("E"), small).otherwise(text)


def to_json_text(av: Column) -> Column:
    """JSON text of an AV as the output formats show it: numbers plain, binary base64, timestamps as numbers, null."""
    number = F.when(av["n"].rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), av["n"]).otherwise(F.to_json(F.struct(av["n"].alias("x"))))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    return (
        F.when(av["t"] == "N", F.when(number.startswith("{"), quoted(av["n"])).otherwise(number))
        .when(av["t"] == "S", quoted(av["s"])).when(av["t"] == "B", quoted(F.base64(av["b"]))).when(av["t"] == "BOOL", av["bool"].cast("string"))
        .when(av["t"] == "TS", av["ts"].cast("string")).when(av["t"] == "VEC", F.to_json(av["vec"])).when(av["t"] == "NULL", F.lit("null")).otherwise(av["j"])
    )
