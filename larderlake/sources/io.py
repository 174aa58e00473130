"""JSON and CSV in and out, and plain tables as text."""

from __future__ import annotations

import itertools
import json
import textwrap
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions import values as V


def _tagged(df: DataFrame) -> bool:
    return "attrs" in df.columns and isinstance(df.schema["attrs"].dataType, T.MapType)


def parse_item(text: str) -> dict[str, Any]:
    """The item of a JSON object; numbers keep their text, nested values their structure."""
    number = lambda x: V.Number(x)
    try:
        x = json.loads(text, parse_int=number, parse_float=number)
    except ValueError as e:
        raise InvalidArgument(f"not JSON: {e}") from None
    if not isinstance(x, dict):
        raise InvalidArgument("an item is a JSON object")
    return x


def plain_json(text: str | None) -> str | None:
    """Plain JSON of the tagged JSON of a list or map."""
    if text is None:
        return None
    x = json.loads(text)
    show = lambda v: v.hex() if isinstance(v, bytes) else v.ms if isinstance(v, V.Timestamp) else list(v.values) if isinstance(v, V.Vector) else [show(y) for y in v] if isinstance(v, list) else {k: show(y) for k, y in v.items()} if isinstance(v, dict) else v
    out = {k: show(V.untag(v)) for k, v in x.items()} if isinstance(x, dict) else [show(V.untag(v)) for v in x]
    return json.dumps(out, ensure_ascii=False)


def json_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON object an item, absent attributes left out, attributes in column order (schemaless: by name).

    Typed columns need no Python. Lists and maps of schemaless items are
    turned from their tagged text in Arrow batches, only where there are any.
    """
    if not _tagged(df):
        return df.select(F.to_json(F.struct(*[F.base64(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema.fields])).alias("value"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    names = F.array_sort(F.map_keys("attrs"))
    deep = F.exists(F.map_values("attrs"), lambda v: v["t"].isin("L", "M"))
    js = F.when(deep, F.transform(names, lambda k: F.col("attrs")[k]["j"]))
    flat = df.withColumn("__n", names).withColumn("__j", js)

    all_nested = F.pandas_udf(lambda s: s.map(lambda xs: None if xs is None else [plain_json(x) for x in xs]), "array<string>", F.PandasUDFType.SCALAR)
    flat = flat.withColumn("__p", all_nested("__j"))
    parts = F.transform(F.col("__n"), lambda k, i: F.concat(quoted(k), F.lit(":"), F.coalesce(F.when(F.col("attrs")[k]["t"].isin("L", "M"), F.col("__p")[i]), V.to_json_text(F.col("attrs")[k]))))
    return flat.select(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.text(path)


def pretty_json_lines(df: DataFrame) -> Iterator[str]:
    """The lines of a JSON array of all items, indented, as they come from the executors."""
    before = None
    for r in json_lines(df).toLocalIterator():
        if before is not None:
            yield before + ","
        elif before is None:
            yield "["
        *lines, before = textwrap.indent(json.dumps(json.loads(r[0]), indent=2, ensure_ascii=False), "  ").split("\n")
        yield from lines
    yield from ("[]",) if before is None else (before, "]")


def pretty_json(df: DataFrame) -> str:
    """A JSON array of all items, indented."""
    return "\n".join(pretty_json_lines(df))


def attribute_names(df: DataFrame) -> list[str]:
    """The sorted union of the attributes' names: of the columns, or of all items' maps."""
    if not _tagged(df):
        return sorted(c for c in df.columns if c not in ("pk", "sk"))
    return [r[0] for r in df.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().orderBy("k").collect()]


def text_columns(df: DataFrame, missing: str = "", names: list[str] | None = None) -> DataFrame:
    """Every attribute as text, by name: lists and maps as [object], binaries as [binary], vectors as [vector], absent ones as `missing`."""
    names = names or attribute_names(df)
    if _tagged(df):
        def show(k):
            v = F.col("attrs")[k]
            return F.when(v["t"] == "N", v["n"]).when(v["t"] == "S", v["s"]).when(v["t"] == "BOOL", v["bool"].cast("string")).when(v["t"] == "TS", v["ts"].cast("string")).when(v["t"] == "NULL", "null").when(v["t"] == "B", "[binary]").when(v["t"] == "VEC", "[vector]").when(v["t"].isin("L", "M"), "[object]")
    else:
        def show(k):
            t, c = df.schema[k].dataType, F.col(f"`{k}`")
            mark = "[binary]" if isinstance(t, T.BinaryType) else "[vector]" if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType) else "[object]" if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else None
            return F.when(c.isNotNull(), F.lit(mark)) if mark else c.cast("string")
    return df.select(*[F.coalesce(show(k), F.lit(missing)).alias(k) for k in names])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header of the sorted attribute names; absent ones empty; quotes doubled."""
    text_columns(df, "").write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def csv_lines(df: DataFrame) -> Iterator[str]:
    """The lines of the CSV text of all items (a quoted line end stays inside one)."""
    import csv
    import io

    shown = text_columns(df, "")
    for r in itertools.chain([shown.columns], shown.toLocalIterator()):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(tuple(r))
        yield out.getvalue()


def csv_text(df: DataFrame) -> str:
    """The CSV text of all items."""
    return "".join(x + "\n" for x in csv_lines(df))


def table_lines(df: DataFrame) -> Iterator[str]:
    """The lines of aligned columns of all items, `-` for absent attributes. The widths are found first, in a pass of their own."""
    shown = text_columns(df, "-")
    if not shown.columns:
        yield "(no items)"
        return
    widths = shown.agg(*[F.max(F.length(f"`{c}`")) for c in shown.columns]).first()
    widths = [max(len(c), w or 0) for c, w in zip(shown.columns, widths)]
    line = lambda cells: " | ".join(x.ljust(w) for x, w in zip(cells, widths)).rstrip()
    yield line(shown.columns)
    yield "-+-".join("-" * w for w in widths)
    for r in shown.toLocalIterator():
        yield line(tuple(r))


def table_text(df: DataFrame) -> str:
    """All items as aligned columns."""
    return "\n".join(table_lines(df))


def read_json_lines(spark: SparkSession, path: str, pk: str, sk: str | None = None) -> DataFrame:
    """(pk, sk, attrs) of JSON lines; keys are taken from two attributes, which stay attributes too."""
    import pandas as pd

    schema = T.StructType([T.StructField("pk", T.StringType()), T.StructField("sk", T.StringType()), T.StructField("attrs", V.ATTRS)])
    fields = [f.name for f in V.AV.fields]

    def run(it):
        for b in it:
            rows = []
            for line in b["value"]:
                x = parse_item(line)
                text = lambda k: None if k is None or k not in x else x[k].text if isinstance(x[k], V.Number) else str(x[k])  # noqa: B023, E731
                rows.append((text(pk), text(sk), {k: dict(zip(fields, V.to_av(v))) for k, v in x.items()}))
            yield pd.DataFrame(rows, columns=["pk", "sk", "attrs"])

    return spark.read.text(path).where("trim(value) <> ''").mapInPandas(run, schema)
