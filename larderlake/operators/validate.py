"""Attribute rules: what each item breaks, as an array of messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import KINDS
from ..model import AttributeSchema

_TYPES = {
    "String": (T.StringType,), "Number": (T.NumericType,), "Binary": (T.BinaryType,), "Boolean": (T.BooleanType,), "List": (T.ArrayType,), "Map": (T.MapType, T.StructType),
    "Vector": (T.ArrayType,), "Timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def _typed(df: DataFrame, rule: AttributeSchema) -> dict[str, Column | None]:
    if rule.name not in df.columns:
        return {"here": F.lit(False), "null": F.lit(False), "kind": F.lit(True), "number": None, "text": None, "size": None}
    c, t = F.col(rule.name), df.schema[rule.name].dataType
    text, number, array = isinstance(t, T.StringType), isinstance(t, T.NumericType), isinstance(t, T.ArrayType)
    return {
        "here": c.isNotNull(), "null": F.lit(False), "kind": F.lit(rule.kind is None or isinstance(t, _TYPES[rule.kind])), "number": c.cast("double") if number else None,
        "text": c if text else None, "size": F.octet_length(c) if text else F.size(c) if array else None, "value": c,
    }


def _tagged(rule: AttributeSchema) -> dict[str, Column | None]:
    v = F.col("attrs")[rule.name]
    tags = {k: t for t, k in KINDS.items()}
    return {
        "here": F.coalesce(F.map_contains_key("attrs", rule.name), F.lit(False)), "null": v["t"] == "NULL", "kind": F.lit(True) if rule.kind is None else v["t"] == tags[rule.kind],
        "number": v["n"].try_cast("double"), "text": v["s"], "size": F.coalesce(F.octet_length(v["s"]), F.size(F.from_json(F.when(v["t"] == "L", v["j"]), "array<string>"))), "value": F.coalesce(v["s"], v["n"], v["bool"].cast("string")),
    }


def violations(df: DataFrame, rules: tuple[AttributeSchema, ...]) -> Column:
    """Messages of the rules that a row breaks, in the order of the rules; empty if none.

    Lengths are bytes of UTF-8 for texts and counts for lists. A pattern may
    match anywhere in a text (Java's dialect). Bounds that don't apply to an
    attribute's kind pass. Absent attributes break `required` only.
    """
    tagged = "attrs" in df.columns and isinstance(df.schema["attrs"].dataType, T.MapType)
    found = []
    for r in rules:
        p = _tagged(r) if tagged else _typed(df, r)

        def broken(what: str, when: Column | None, p=p, r=r) -> None:
            if when is not None:
                found.append(F.when(p["here"] & F.coalesce(when, F.lit(False)), F.lit(f"{r.name}: {what}")))

        if r.required:
            found.append(F.when(~p["here"], F.lit(f"{r.name}: required")))
        if r.kind:
            broken(f"not a {r.kind}", ~p["kind"])
        for what, bound, column, below in (("min_value", r.min_value, p["number"], True), ("max_value", r.max_value, p["number"], False), ("min_length", r.min_length, p["size"], True), ("max_length", r.max_length, p["size"], False)):
            if bound is not None and column is not None:
                broken(what, column < bound if below else column > bound)
        if r.pattern is not None and p["text"] is not None:
            broken("pattern", ~p["text"].rlike(r.pattern))
        if r.enum is not None and p.get("value") is not None:
            options = [json.dumps(x) if isinstance(x, bool) else str(x) for x in r.enum] if tagged else list(r.enum)
            broken("enum", ~p["value"].isin(options))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def validate(df: DataFrame, rules: tuple[AttributeSchema, ...]) -> DataFrame:
    """df with a column `violations`."""
    return df.withColumn("violations", violations(df, rules))
