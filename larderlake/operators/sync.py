"""Synchronising two stored tables: what differs is pushed, pulled or resolved, in one commit a side.

What was done is kept beside the data (`sync/<peer>/<n>.json`), not in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..database import Database
from ..errors import InvalidArgument
from ..functions import values as V
from ..functions.shared import forget, shared_dir
from . import log as L
from .replica import _outer

DIRECTIONS = ("both", "push", "pull")


def _versions(db: Database) -> DataFrame:
    """The newest version of every key, with a text that equal versions share."""
    same = F.when(F.col("deleted"), F.lit("gone")).otherwise(F.to_json(F.array_sort(F.map_entries("attrs"))))
    return L.newest(db.log().drop("stripe")).select("pk", "sk", "deleted", "at", "attrs", F.sha2(same, 256).alias("hash"))


def pending(local: Database, remote: Database) -> DataFrame:
    """(pk, sk, l_*, r_*, kind): keys whose newest versions differ. Tombstones are versions; one that faces nothing doesn't count."""
    both = _outer(_versions(local), _versions(remote), ("pk", "sk"), ["deleted", "at", "attrs", "hash"])
    kind = F.when(F.col("__a") & F.col("__b"), "Modified").when(F.col("__a"), "LocalOnly").otherwise("RemoteOnly")
    live = F.coalesce(~F.col("l_deleted"), F.lit(False)) | F.coalesce(~F.col("r_deleted"), F.lit(False))
    return both.withColumn("kind", kind).where(~F.col("l_hash").eqNullSafe(F.col("r_hash")) & live).drop("__a", "__b")


def _merged(newer: str, older: str):
    n, o = F.col(newer + "attrs"), F.col(older + "attrs")
    none = F.create_map().cast(V.ATTRS)
    return F.map_concat(F.map_filter(F.coalesce(o, none), lambda k, _: ~F.coalesce(F.map_contains_key(n, k), F.lit(False))), F.coalesce(n, none))


def synchronise(local: Database, remote: Database, strategy: str | Callable[[DataFrame], DataFrame] = "lww", direction: str = "both", peer: str = "remote") -> dict:
    """Brings both tables together; returns counts of pushed, pulled, conflicts and unresolved.

    LocalOnly goes to remote, RemoteOnly to local. Of Modified: lww and fww by
    time, ties to local; local, remote: that side; attr_merge: the union of
    attributes, shared ones from the later side, a later delete wins; manual:
    stays unresolved. A function gets the conflicts and gives (pk, sk,
    deleted, at, attrs). direction push or pull changes one side only.
    """
    if direction not in DIRECTIONS:
        raise InvalidArgument(f"direction {direction!r}")
    path = shared_dir(local.spark)
    pending(local, remote).write.option("compression", "zstd").parquet(path)  # survives lost executors, and both sides are read once
    diff = local.spark.read.parquet(path)
    try:
        side = lambda p: [F.col(p + c).alias(c) for c in ("deleted", "at", "attrs")]
        only_l, only_r, both = (diff.where(F.col("kind") == k) for k in ("LocalOnly", "RemoteOnly", "Modified"))
        counts = {r.kind: r["count"] for r in diff.groupBy("kind").count().collect()}
        unresolved = 0
        if callable(strategy):
            won = strategy(both).select("pk", "sk", "deleted", "at", "attrs")
        elif strategy == "manual":
            won, unresolved = both.select("pk", "sk", *side("l_")).limit(0), counts.get("Modified", 0)
        elif strategy == "attr_merge":
            newer = F.col("l_at") >= F.col("r_at")
            edit = ~F.col("l_deleted") & ~F.col("r_deleted")
            attrs = F.when(edit, F.when(newer, _merged("l_", "r_")).otherwise(_merged("r_", "l_")))
            # a delete against an edit: the later one, the edit at equal times
            left = F.when(F.col("l_deleted"), F.col("l_at") > F.col("r_at")).otherwise(newer)
            won = both.select("pk", "sk", F.when(edit, F.lit(False)).when(left, F.col("l_deleted")).otherwise(F.col("r_deleted")).alias("deleted"), F.greatest("l_at", "r_at").alias("at"), F.when(edit, attrs).when(left, F.col("l_attrs")).otherwise(F.col("r_attrs")).alias("attrs"))
        elif strategy in ("lww", "fww", "local", "remote"):
            left = {"lww": F.col("l_at") >= F.col("r_at"), "fww": F.col("l_at") <= F.col("r_at"), "local": F.lit(True), "remote": F.lit(False)}[strategy]
            won = both.select("pk", "sk", *[F.when(left, F.col("l_" + c)).otherwise(F.col("r_" + c)).alias(c) for c in ("deleted", "at", "attrs")])
        else:
            raise InvalidArgument(f"strategy {strategy!r}")
        push = only_l.select("pk", "sk", *side("l_")).unionByName(won)
        pull = only_r.select("pk", "sk", *side("r_")).unionByName(won)
        out = {"pushed": remote.append(push) if direction != "pull" else 0, "pulled": local.append(pull) if direction != "push" else 0, "conflicts": counts.get("Modified", 0), "unresolved": unresolved}
    finally:
        forget(local.spark, path)
    record(local, peer, out | {"at": local.now(), "local_commit": local.head()["commit"], "remote_commit": remote.head()["commit"]})
    return out


def record(db: Database, peer: str, entry: dict) -> None:
    """Adds an entry to the history with a peer."""
    fs, p = db._fs(f"{db.path}/sync/{peer}/{len(history(db, peer)):010d}.json")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()


def history(db: Database, peer: str) -> list[dict]:
    """What was done with a peer, oldest first."""
    fs, p = db._fs(f"{db.path}/sync/{peer}")
    found = []
    for x in sorted((x.getPath() for x in fs.listStatus(p)) if fs.exists(p) else [], key=lambda x: x.getName()):
        s = fs.open(x)
        found.append(json.loads(bytes(s.readAllBytes()).decode()))
        s.close()
    return found
