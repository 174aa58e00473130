"""Two stored tables brought together, and the command line."""

import json

import pytest

from larderlake.__main__ import main
from larderlake.database import Database
from larderlake.errors import InvalidArgument
from larderlake.functions import values as V
from larderlake.operators import sync


@pytest.fixture
def pair(spark, tmp_path):
    clock = {"now": 100}
    a, b = (Database.create(spark, str(tmp_path / x), now=lambda: clock["now"]) for x in "ab")
    a.batch_write(puts=[("one", {"v": "local", "x": 1}), ("same", {"v": 5}), ("mine", {"v": [1, 2]}), ("gone", {"v": 1})])
    b.batch_write(puts=[("same", {"v": 5}), ("yours", {"v": b"\x01"}), ("gone", {"v": 1})])
    clock["now"] = 200
    b.batch_write(puts=[("one", {"v": "remote", "y": 2})], deletes=["gone"])
    return a, b


def view(db):
    return {r.pk: V.item(r.attrs) for r in db.scan().df.collect()}


def test_both_ways(pair):
    a, b = pair
    assert {r.pk: r.kind for r in sync.pending(a, b).collect()} == {"one": "Modified", "mine": "LocalOnly", "yours": "RemoteOnly", "gone": "Modified"}
    assert sync.synchronise(a, b) == {"pushed": 3, "pulled": 3, "conflicts": 2, "unresolved": 0}
    assert view(a) == view(b) == {"one": {"v": "remote", "y": 2}, "same": {"v": 5}, "mine": {"v": [1, 2]}, "yours": {"v": b"\x01"}}
    assert sync.synchronise(a, b) == {"pushed": 0, "pulled": 0, "conflicts": 0, "unresolved": 0}
    assert [h["conflicts"] for h in sync.history(a, "remote")] == [2, 0] and a.scan().count == 4


@pytest.mark.parametrize(("strategy", "one", "gone"), [("fww", {"v": "local", "x": 1}, {"v": 1}), ("local", {"v": "local", "x": 1}, {"v": 1}), ("remote", {"v": "remote", "y": 2}, None), ("attr_merge", {"v": "remote", "x": 1, "y": 2}, None)])
def test_strategies(pair, strategy, one, gone):
    a, b = pair
    sync.synchronise(a, b, strategy)
    assert view(a) == view(b) and view(a)["one"] == one and view(a).get("gone") == gone


def test_one_way_and_manual(pair):
    a, b = pair
    assert sync.synchronise(a, b, "manual", "push") == {"pushed": 1, "pulled": 0, "conflicts": 2, "unresolved": 2}
    assert "yours" not in view(a) and view(b)["mine"] == {"v": [1, 2]} and view(a)["one"]["v"] == "local"
    for bad in ({"strategy": "nope"}, {"direction": "up"}):
        with pytest.raises(InvalidArgument):
            sync.synchronise(a, b, **bad)


def test_command_line(spark, tmp_path):
    run = lambda *x: main([str(tmp_path / "t"), *x], spark)
    assert run("create") == "created" and run("put", "a", '{"n": 1.0, "t": "x"}', "--sk", "s1") == "ok" and run("put", "a", '{"n": 2}', "--sk", "s2") == "ok"
    assert run("get", "a", "--sk", "s1").splitlines()[2].split(" | ") == ["1.0", "x"]
    assert json.loads(run("--format", "jsonl", "query", "a", "--reverse", "--limit", "1")) == {"n": 2}
    assert run("--format", "csv", "scan").splitlines()[0] == "n,t" and run("sql", "DELETE FROM t WHERE pk = 'a' AND sk = 's1'") == "delete"
    assert "total_keys: 1" in run("stats") and "keys: 2" in run("compact") and run("--format", "json", "sql", "SELECT n FROM t WHERE n = 2").count("n") == 1
