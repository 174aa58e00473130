"""python -m larderlake TABLE COMMAND ...: one call on a stored table, printed as table, json, jsonl or csv."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import functions as F

from .database import Database
from .operators.read import Query, Scan
from .sources import io as IO


def show(df, form: str) -> Iterator[str]:
    """The lines of all rows."""
    if form == "jsonl":
        return (r[0] for r in IO.json_lines(df).toLocalIterator())
    return {"json": IO.pretty_json_lines, "csv": IO.csv_lines, "table": IO.table_lines}[form](df)


def main(args: list[str], spark=None) -> str:
    """What a call prints, as one text."""
    return "\n".join(lines(args, spark))


def lines(args: list[str], spark=None) -> Iterator[str]:
    """What a call prints, a line at a time: all rows, however many there are. --limit is the only bound."""
    p = argparse.ArgumentParser(prog="larderlake")
    p.add_argument("table")
    p.add_argument("--format", choices=("table", "json", "jsonl", "csv"), default="table")
    c = p.add_subparsers(dest="command", required=True)
    for name, words in (("create", ()), ("put", ("pk", "item")), ("get", ("pk",)), ("delete", ("pk",)), ("query", ("pk",)), ("scan", ()), ("sql", ("statement",)), ("stats", ()), ("compact", ()), ("stream", ())):
        s = c.add_parser(name)
        for w in words:
            s.add_argument(w)
        if name in ("put", "get", "delete"):
            s.add_argument("--sk")
        if name in ("query", "scan"):
            s.add_argument("--limit", type=int)
        if name == "query":
            s.add_argument("--begins-with")
            s.add_argument("--reverse", action="store_true")
            s.add_argument("--index")
        if name == "stream":
            s.add_argument("--after", type=int, default=0)
    a = p.parse_args(args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("larderlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "create":
        Database.create(spark, a.table)
        return iter(["created"])
    db = Database.open(spark, a.table)
    if a.command == "put":
        db.put((a.pk, a.sk), IO.parse_item(a.item))
        return iter(["ok"])
    if a.command == "delete":
        db.delete((a.pk, a.sk))
        return iter(["ok"])
    if a.command == "get":
        return show(db._live(db._partition([a.pk])).where(F.col("sk").eqNullSafe(F.lit(a.sk))).select("pk", "sk", "attrs"), a.format)
    if a.command in ("stats", "compact"):
        return iter([f"{k}: {v}" for k, v in getattr(db, a.command)().items()])
    if a.command == "stream":
        return (f"{r.seq} {r.op} {r.pk} {r.sk or ''}".rstrip() for r in db.stream(a.after).toLocalIterator())
    if a.command == "sql":
        r = db.execute(a.statement)
        return show(r.page.df, a.format) if r.page else iter([r.kind])
    if a.command == "scan":
        return show(db.scan(Scan(a.limit)).df, a.format)
    q = Query(a.pk).forward(not a.reverse)
    q = q.sk_begins_with(a.begins_with) if a.begins_with else q
    q = q.index(a.index) if a.index else q
    return show(db.query(q if a.limit is None else q.limit(a.limit)).df.select("pk", "sk", "attrs"), a.format)


if __name__ == "__main__":
    for x in lines(sys.argv[1:]):
        print(x)
