"""The PartiQL dialect: text to statements, statements to DataFrames.

SELECT with a conjunction of comparisons, IN and BETWEEN; INSERT of one JSON
item; UPDATE with SET and REMOVE; DELETE. What the dialect leaves out is
refused by name. With extended=True the WHERE of a SELECT may also use OR,
NOT, parentheses and attribute_exists, attribute_not_exists, begins_with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQuery, NotFound
from ..functions import keys as K
from ..functions.values import Number, plain_number
from ..model import Page
from ..operators import read
from ..operators.index import index_view
from ..sources.items import ItemTable, as_table
from . import expr as E

MAX_BYTES = 8192
_TOKEN = re.compile(r"""\s*(?:('(?:[^']|'')*')|("(?:[^"]|"")*")|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_][A-Za-z0-9_]*(?:-[A-Za-z_][A-Za-z0-9_]*)*)|(<=|>=|<>|!=|[=<>(),.*;+\-{}\[\]:])|(\S))""")
#: Words that begin what the dialect leaves out, where they may stand.
_AFTER_FROM = {"JOIN": "JOIN", "INNER": "JOIN", "LEFT": "JOIN", "RIGHT": "JOIN", "FULL": "JOIN", "CROSS": "JOIN", "GROUP": "GROUP BY", "HAVING": "HAVING", "UNION": "set operations", "INTERSECT": "set operations", "EXCEPT": "set operations", "WINDOW": "named windows", "QUALIFY": "QUALIFY", "FETCH": "FETCH", "FOR": "FOR", "AS": "table aliases"}


@dataclass(frozen=True)
class Select:
    table: str
    index: str | None
    columns: tuple[tuple[str, str], ...] | None  # (attribute, output name); None: *
    where: Any = None  # a tree of plans.expr, or None
    order_by: tuple[str, bool] | None = None  # (attribute, ascending)
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Insert:
    table: str
    pk: Any
    sk: Any
    item: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Update:
    table: str
    pk: Any
    sk: Any
    actions: tuple[E.Action, ...]
    condition: Any = None


@dataclass(frozen=True)
class Delete:
    table: str
    pk: Any
    sk: Any
    condition: Any = None


class _Parser:
    def __init__(self, text: str, extended: bool):
        size = len(text.encode())
        if not 1 <= size <= MAX_BYTES or not text.strip():
            raise InvalidQuery(f"a statement has 1 to {MAX_BYTES} bytes, this one {size}")
        self.extended, self.at, self.tokens = extended, 0, []
        for text_, name, number, word, op, odd in _TOKEN.findall(text):
            if odd:
                raise InvalidQuery(f"unexpected {odd!r}")
            self.tokens.append(("text", text_[1:-1].replace("''", "'")) if text_ else ("name", name[1:-1].replace('""', '"')) if name else ("number", number) if number else ("word", word) if word else ("op", op))
        if self.tokens and self.tokens[-1] == ("op", ";"):
            self.tokens.pop()
        if ("op", ";") in self.tokens:
            raise InvalidQuery("one statement at a time")

    # tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def upper(self, ahead: int = 0) -> str:
        kind, x = self.peek(ahead)
        return x.upper() if kind == "word" else ""

    def take(self, *words: str) -> bool:
        if self.upper() in words:
            self.at += 1
            return True
        return False

    def op(self, x: str) -> bool:
        if self.peek() == ("op", x):
            self.at += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not (self.take(x) if x.isalpha() else self.op(x)):
            raise InvalidQuery(f"expected {x}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, x = self.peek()
        if kind not in ("word", "name"):
            raise InvalidQuery(f"expected a name, found {x!r}")
        self.at += 1
        return x

    # values

    def literal(self) -> Any:
        sign = -1 if self.op("-") else 1 if self.op("+") else 0
        kind, x = self.peek()
        self.at += 1
        if kind == "number":
            text = f"-{x}" if sign < 0 else x
            return plain_number(text)
        if sign:
            raise InvalidQuery("a sign before something other than a number")
        if kind == "text":
            return x
        if kind == "word" and x.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[x.upper()]
        raise InvalidQuery(f"expected a literal, found {x!r}: columns can't be compared with columns or expressions")

    def json(self) -> Any:
        """A JSON value whose texts stand in single or double quotes."""
        if self.op("{"):
            out = {}
            while not self.op("}"):
                kind, key = self.peek()
                if kind not in ("text", "name"):
                    raise InvalidQuery(f"expected a quoted attribute, found {key!r}")
                self.at += 1
                self.need(":")
                out[key] = self.json()
                if not self.op(","):
                    self.need("}")
                    break
            return out
        if self.op("["):
            out = []
            while not self.op("]"):
                out.append(self.json())
                if not self.op(","):
                    self.need("]")
                    break
            return out
        kind, x = self.peek()
        if kind == "name":
            self.at += 1
            return x
        if kind == "number" or (kind, x) == ("op", "-"):
            minus = self.op("-")
            kind, x = self.peek()
            if kind != "number":
                raise InvalidQuery(f"expected a number, found {x!r}")
            self.at += 1
            return Number(("-" if minus else "") + x)
        return self.literal()

    # conditions

    def where(self):
        if not self.take("WHERE"):
            return None
        if self.extended:
            return self._either()
        parts = [self._predicate()]
        while True:
            if self.take("AND"):
                parts.append(self._predicate())
            elif self.upper() == "OR":
                raise InvalidQuery("OR is not supported")
            else:
                return parts[0] if len(parts) == 1 else E.Logic("AND", tuple(parts))

    def _either(self):
        parts = [self._both()]
        while self.take("OR"):
            parts.append(self._both())
        return parts[0] if len(parts) == 1 else E.Logic("OR", tuple(parts))

    def _both(self):
        parts = [self._negated()]
        while self.take("AND"):
            parts.append(self._negated())
        return parts[0] if len(parts) == 1 else E.Logic("AND", tuple(parts))

    def _negated(self):
        return E.Logic("NOT", (self._negated(),)) if self.take("NOT") else self._predicate()

    def _predicate(self):
        if self.peek() == ("op", "("):
            if not self.extended:
                raise InvalidQuery("parentheses are not supported")
            self.need("(")
            x = self._either()
            self.need(")")
            return x
        if self.upper() in ("NOT", "EXISTS"):
            raise InvalidQuery(f"{self.upper()} is not supported")
        if self.peek()[0] not in ("word", "name"):
            raise InvalidQuery(f"the left side must be an attribute, found {self.peek()[1]!r}")
        if self.peek(1) == ("op", "("):
            if not self.extended:
                raise InvalidQuery("functions are not supported in WHERE")
            f = self.name().lower()
            self.need("(")
            p = E.Path(self.name())
            if f == "begins_with":
                self.need(",")
                x = E.Begins(p, E.Value(self.literal()))
            elif f in ("attribute_exists", "attribute_not_exists"):
                x = E.Exists(p, f == "attribute_exists")
            else:
                raise InvalidQuery(f"no function {f}")
            self.need(")")
            return x
        p = E.Path(self.name())
        if self.peek() == ("op", "."):
            raise InvalidQuery("nested attributes are not supported")
        if self.upper() in ("LIKE", "ILIKE", "IS", "SIMILAR"):
            raise InvalidQuery(f"{self.upper()} is not supported")
        if self.take("NOT"):
            raise InvalidQuery(f"NOT {self.upper()} is not supported")
        if self.take("IN"):
            self.need("(")
            if self.upper() == "SELECT":
                raise InvalidQuery("subqueries are not supported")
            options = [E.Value(self.literal())]
            while self.op(","):
                options.append(E.Value(self.literal()))
            self.need(")")
            return E.Within(p, tuple(options))
        if self.take("BETWEEN"):
            a = self.literal()
            self.need("AND")
            return E.Between(p, E.Value(a), E.Value(self.literal()))
        for op in ("<=", ">=", "<>", "!=", "=", "<", ">"):
            if self.op(op):
                if self.peek() == ("op", "("):
                    raise InvalidQuery("subqueries and parentheses are not supported")
                return E.Compare("<>" if op == "!=" else op, p, E.Value(self.literal()))
        raise InvalidQuery(f"expected a comparison, found {self.peek()[1]!r}")

    def count(self, what: str) -> int:
        kind, x = self.peek()
        if kind != "number" or not x.isdigit():
            raise InvalidQuery(f"{what} needs a whole number that isn't negative, found {x!r}")
        self.at += 1
        return int(x)

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise InvalidQuery(f"unexpected {self.peek()[1]!r}")

    # statements

    def statement(self):
        if self.upper() == "WITH":
            raise InvalidQuery("WITH is not supported")
        for word, parse in (("SELECT", self.select), ("INSERT", self.insert), ("UPDATE", self.update), ("DELETE", self.delete)):
            if self.take(word):
                x = parse()
                self.end()
                return x
        raise InvalidQuery(f"expected SELECT, INSERT, UPDATE or DELETE, found {self.peek()[1]!r}")

    def select(self) -> Select:
        if self.upper() in ("DISTINCT", "TOP") and self.peek(1) != ("op", ",") and self.upper(1) != "FROM":
            raise InvalidQuery(f"{self.upper()} is not supported")
        columns: list[tuple[str, str]] | None = None
        if not self.op("*"):
            columns = []
            while True:
                kind, x = self.peek()
                if kind not in ("word", "name"):
                    raise InvalidQuery(f"only attributes can be selected, found {x!r}")
                n = self.name()
                if self.peek() == ("op", "("):
                    raise InvalidQuery(f"functions and aggregates are not supported: {n}")
                if self.peek() == ("op", "."):
                    raise InvalidQuery("nested attributes are not supported")
                if self.peek()[0] == "op" and self.peek()[1] in "+-*":
                    raise InvalidQuery("expressions are not supported in SELECT")
                columns.append((n, self.name() if self.take("AS") else n))
                if not self.op(","):
                    break
        self.need("FROM")
        if self.peek() == ("op", "("):
            raise InvalidQuery("subqueries are not supported")
        table, index = self.name(), None
        if self.op("."):
            index = self.name()
        if self.peek() == ("op", ","):
            raise InvalidQuery("several tables are not supported")
        where = self.where()
        order = None
        self._refuse()
        if self.take("ORDER"):
            self.need("BY")
            n = self.name()
            up = not self.take("DESC")
            if up:
                self.take("ASC")
            if self.peek() == ("op", ","):
                raise InvalidQuery("ORDER BY takes one attribute")
            order = (n, up)
        limit, offset = None, 0
        while self.upper() in ("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                limit = self.count("LIMIT")
            else:
                self.need("OFFSET")
                offset = self.count("OFFSET")
        self._refuse()
        return Select(table, index, tuple(columns) if columns is not None else None, where, order, limit, offset)

    def _refuse(self) -> None:
        if self.upper() in _AFTER_FROM:
            raise InvalidQuery(f"{_AFTER_FROM[self.upper()]} not supported")

    def insert(self) -> Insert:
        self.need("INTO")
        table = self.name()
        if not self.take("VALUE"):
            raise InvalidQuery("INSERT takes VALUE and one item")
        item = self.json()
        if not isinstance(item, dict):
            raise InvalidQuery("INSERT takes an item in braces")
        if self.peek() == ("op", ","):
            raise InvalidQuery("INSERT takes one item")
        if "pk" not in item:
            raise InvalidQuery("INSERT needs a pk")
        key = lambda x: x.text if isinstance(x, Number) else x
        pk, sk = key(item.pop("pk")), key(item.pop("sk", None))
        if not isinstance(pk, (str, bytes)) or not isinstance(sk, (str, bytes, type(None))):
            raise InvalidQuery("keys are strings or numbers")
        return Insert(table, pk, sk, item)

    def update(self) -> Update:
        table, actions = self.name(), []
        while self.upper() in ("SET", "REMOVE"):
            if self.take("SET"):
                while True:
                    n = self.name()
                    self.need("=")
                    actions.append(E.Action("SET", n, self._amount()))
                    if not self.op(","):
                        break
            else:
                self.need("REMOVE")
                while True:
                    actions.append(E.Action("REMOVE", self.name()))
                    if not self.op(","):
                        break
        if not actions:
            raise InvalidQuery("UPDATE needs SET or REMOVE")
        if any(a.name in ("pk", "sk") for a in actions):
            raise InvalidQuery("a key can't be updated")
        pk, sk, rest = self._key("UPDATE")
        return Update(table, pk, sk, tuple(actions), rest)

    def _amount(self):
        def one():
            kind, x = self.peek()
            if kind == "name" or (kind == "word" and x.upper() not in ("TRUE", "FALSE", "NULL")):
                return E.Path(self.name())
            return E.Value(self.json() if (kind, x) in (("op", "{"), ("op", "[")) else self.literal())

        x = one()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.peek()[1]
            self.at += 1
            x = E.Arithmetic(op, x, one())
        return x

    def delete(self) -> Delete:
        self.need("FROM")
        table = self.name()
        pk, sk, rest = self._key("DELETE")
        return Delete(table, pk, sk, rest)

    def _key(self, what: str) -> tuple[Any, Any, Any]:
        """pk, sk and the other predicates, which are the write's condition."""
        tree = self.where()
        parts = () if tree is None else tree.parts if isinstance(tree, E.Logic) and tree.op == "AND" else (tree,)
        key, rest = {}, []
        for p in parts:
            if isinstance(p, (E.Compare, E.Within, E.Between)) and isinstance(p_path := getattr(p, "left", getattr(p, "path", None)), E.Path) and p_path.name in ("pk", "sk"):
                if not isinstance(p, E.Compare) or p.op != "=" or p_path.name in key:
                    raise InvalidQuery(f"{what} takes one = for each key")
                v = p.right.value
                key[p_path.name] = v if isinstance(v, (str, bytes)) else key_text(v)
            else:
                rest.append(p)
        if "pk" not in key:
            raise InvalidQuery(f"{what} needs WHERE pk = ...")
        return key["pk"], key.get("sk"), None if not rest else rest[0] if len(rest) == 1 else E.Logic("AND", tuple(rest))


def key_text(v: Any) -> str:
    """The text of a key literal; numbers are their text."""
    if isinstance(v, bool) or v is None:
        raise InvalidQuery("keys are strings or numbers")
    from ..functions.values import number_text

    return v if isinstance(v, str) else number_text(v)


def parse(text: str, extended: bool = False) -> Select | Insert | Update | Delete:
    return _Parser(text, extended).statement()


def _parts(tree) -> tuple:
    return () if tree is None else tree.parts if isinstance(tree, E.Logic) and tree.op == "AND" else (tree,)


def _as_key(p, typed_sk: bool):
    """Key literals as text, so that pk = 85 means the key '85'."""
    path = getattr(p, "left", getattr(p, "path", None))
    if not isinstance(path, E.Path) or path.name not in ("pk", "sk") or (path.name == "sk" and typed_sk):
        return p
    text = lambda v: E.Value(v.value if isinstance(v.value, (str, bytes)) or v.value is None else key_text(v.value))
    if isinstance(p, E.Compare):
        return E.Compare(p.op, p.left, text(p.right))
    if isinstance(p, E.Within):
        return E.Within(p.path, tuple(text(o) for o in p.options))
    if isinstance(p, E.Between):
        return E.Between(p.path, text(p.low), text(p.high))
    return p


def route(s: Select) -> str:
    """query (pk =), multiget (pk IN) or scan: decides the order of the result and what a limit counts."""
    for p in _parts(s.where):
        if isinstance(p, E.Compare) and p.op == "=" and p.left == E.Path("pk"):
            return "query"
        if isinstance(p, E.Within) and p.path == E.Path("pk"):
            return "multiget"
    return "scan"


def listed_keys(s: Select) -> list[str] | None:
    """The pks that a statement names by = or IN, as text; None where it names none."""
    for p in _parts(s.where):
        if isinstance(p, E.Compare) and p.op == "=" and p.left == E.Path("pk") or isinstance(p, E.Within) and p.path == E.Path("pk"):
            p = _as_key(p, False)
            values = [p.right.value] if isinstance(p, E.Compare) else [o.value for o in p.options]
            if all(isinstance(v, str) for v in values):
                return list(dict.fromkeys(values))
    return None


def run_select(s: Select, table: ItemTable | DataFrame, now: float | None = None, limit_before_filter: bool = False, keys_too: bool = False) -> Page:
    """The rows of a SELECT.

    All predicates apply. Order: ORDER BY, then the key; else the key order
    for a partition, the order of the list for pk IN, none for an unlimited
    scan. limit_before_filter: on scans LIMIT and OFFSET count items before
    WHERE, as DynamoDB does. keys_too: `*` includes pk and sk.
    """
    t = as_table(table)
    kind = route(s)
    if s.index:
        view = index_view(t, t.spec.index(s.index))
        df, mode = view, "index"
        sort = [F.col("sk").asc_nulls_first(), F.col("base_pk").asc(), F.col("base_sk").asc_nulls_first()]
    else:
        df, mode = t.df, t.spec.key_order
        sort = K.order(mode)
        for p in _parts(s.where):
            if isinstance(p, E.Compare) and p.op == "=" and p.left == E.Path("pk"):
                df = t.where_pk([key_text(p.right.value) if not isinstance(p.right.value, str) else p.right.value])
            elif isinstance(p, E.Within) and p.path == E.Path("pk"):
                df = t.where_pk([key_text(o.value) if not isinstance(o.value, str) else o.value for o in p.options])
    df = read._standing(df, t, now)
    if s.order_by and s.order_by[0] not in df.columns and not _tagged(df):
        raise InvalidQuery(f"no attribute {s.order_by[0]!r} to order by")

    def limited(df: DataFrame) -> DataFrame:
        df = df.offset(s.offset) if s.offset else df
        return df if s.limit is None else df.limit(s.limit)

    ordering = sort
    if kind == "multiget" and not s.index:
        listed = next(p for p in _parts(s.where) if isinstance(p, E.Within) and p.path == E.Path("pk"))
        at = {}
        for o in listed.options:
            at.setdefault(o.value if isinstance(o.value, str) else key_text(o.value), len(at))
        place = F.lit(len(at))
        for k, i in at.items():
            place = F.when(F.col("pk") == F.lit(k), F.lit(i)).otherwise(place)
        ordering = [place, *sort]
    if s.order_by:
        c = _attribute(df, s.order_by[0])
        ordering = [c.asc_nulls_first() if s.order_by[1] else c.desc_nulls_last(), *(sort if s.order_by[1] else [*_turned(sort, mode)])]
    typed_sk = "sk" in df.columns and not isinstance(df.schema["sk"].dataType, (T.StringType, T.BinaryType))
    where = None
    if s.where is not None:
        tree = E.Logic("AND", tuple(_as_key(p, typed_sk) for p in _parts(s.where))) if len(_parts(s.where)) > 1 else _as_key(s.where, typed_sk)
        where = compile_where(tree, df, True)
    bounded = s.limit is not None or s.offset
    if limit_before_filter and kind == "scan":
        df = limited(df.orderBy(*ordering)) if bounded else df
        df = df.where(where) if where is not None else df
        df = df.orderBy(*ordering) if s.order_by or bounded else df
        matched = df
    else:
        df = df.where(where) if where is not None else df
        matched = df
        if bounded or s.order_by or kind != "scan":
            df = df.orderBy(*ordering)
        df = limited(df)
    return Page(project(df, s.columns, keys_too), matched)


def _turned(sort: list[Column], mode: str) -> list[Column]:
    return K.order(mode, True) if mode != "index" else [F.col("sk").desc_nulls_last(), F.col("base_pk").desc(), F.col("base_sk").desc_nulls_last()]


def _tagged(df: DataFrame) -> bool:
    return "attrs" in df.columns and isinstance(df.schema["attrs"].dataType, T.MapType)


def _attribute(df: DataFrame, name: str) -> Column:
    if name in df.columns or not _tagged(df):
        return F.col(f"`{name}`")
    v = F.col("attrs")[name]
    return F.struct(v["t"], v["n"].try_cast("double"), v["s"], v["ts"])


class _Keyed(E.Tagged):
    """Attributes of a map, and the key columns beside it."""

    def __init__(self, df: DataFrame):
        super().__init__()
        self.plain = E.Typed(df)

    def _key(self, *xs) -> bool:
        return any(isinstance(x, E.Path) and x.name in ("pk", "sk", "base_pk", "base_sk") for x in xs)

    def present(self, x):
        return self.plain.present(x) if self._key(x) else super().present(x)

    def equal(self, a, b):
        return self.plain.equal(a, b) if self._key(a, b) else super().equal(a, b)

    def less(self, a, b, op):
        return self.plain.less(a, b, op) if self._key(a, b) else super().less(a, b, op)

    def begins(self, a, b):
        return self.plain.begins(a, b) if self._key(a, b) else super().begins(a, b)


def compile_where(tree, df: DataFrame, filter_only: bool = False) -> Column:
    return E.compile_condition(tree, _Keyed(df) if _tagged(df) else E.Typed(df), filter_only)


def project(df: DataFrame, columns: tuple | None, keys_too: bool = False) -> DataFrame:
    """The selected attributes; null is absent. From schemaless rows a map of those that are there."""
    hidden = ("pk", "sk", "base_pk", "base_sk", "seq", "deleted", "__nulls")
    if _tagged(df):
        if columns is None:
            return df.select("pk", "sk", "attrs")
        out = F.create_map().cast(df.schema["attrs"].dataType)
        for n, alias in columns:
            one = F.create_map(F.lit(alias), F.col("attrs")[n])
            out = F.map_concat(out, F.when(F.map_contains_key("attrs", n), one).otherwise(F.create_map().cast(df.schema["attrs"].dataType)))
        return df.select("pk", "sk", out.alias("attrs"))
    if columns is None:
        return df.select(*[f"`{c}`" for c in df.columns if keys_too and c in ("pk", "sk") or c not in hidden])
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string")).alias(a) for n, a in columns])


def select(text: str, tables: dict[str, ItemTable | DataFrame], **options) -> Page:
    """Parses a SELECT and runs it against named tables."""
    s = parse(text, options.pop("extended", False))
    if not isinstance(s, Select):
        raise InvalidQuery("a SELECT is needed here")
    if s.table not in tables:
        raise NotFound(f"no table {s.table!r}")
    return run_select(s, tables[s.table], **options)
