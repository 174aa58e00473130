"""Condition and update expressions: one grammar, compiled to columns.

Conditions compare attributes with placeholders (`:v`, names through `#n`),
joined by AND, OR, NOT and parentheses, with attribute_exists,
attribute_not_exists and begins_with. Updates are SET, REMOVE, ADD and DELETE
clauses. A compiler turns the tree into a Column, in one of two modes:

* bulk: an absent attribute makes a comparison unknown; what is unknown in the
  end is false, also under NOT;
* strict, for single items: an absent attribute, or an order between kinds
  that have none, is an error in the job. AND and OR skip what they needn't
  evaluate.
"""

from __future__ import annotations

import datetime
import decimal
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidExpression
from ..functions import values as V

# The tree


@dataclass(frozen=True)
class Path:
    name: str


@dataclass(frozen=True)
class Value:
    value: Any


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR, NOT
    parts: tuple


@dataclass(frozen=True)
class Exists:
    path: Path
    wanted: bool


@dataclass(frozen=True)
class Begins:
    path: Any
    prefix: Any


@dataclass(frozen=True)
class Within:
    path: Any
    options: tuple


@dataclass(frozen=True)
class Between:
    path: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Action:
    kind: str  # SET, REMOVE, ADD, DELETE
    name: str
    value: Any = None


OPS = ("<=", ">=", "<>", "=", "<", ">")
_TOKEN = re.compile(r"\s*(?:(<=|>=|<>|[=<>(),+\-])|([:#]?[A-Za-z_][A-Za-z0-9_.]*)|(\S))")
_FUNCTIONS = {"attribute_exists": 1, "attribute_not_exists": 1, "begins_with": 2}


class _Reader:
    """Tokens of an expression with names and placeholders put in."""

    def __init__(self, text: str, values: dict | None, names: dict | None):
        self.values, self.names, self.at = values or {}, names or {}, 0
        self.tokens = []
        for op, word, odd in _TOKEN.findall(text):
            if odd:
                raise InvalidExpression(f"unexpected {odd!r}")
            self.tokens.append(op or word)
        if not self.tokens:
            raise InvalidExpression("empty expression")

    @property
    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def word(self, *wanted: str) -> bool:
        if self.next.upper() in wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.word(wanted):
            raise InvalidExpression(f"expected {wanted!r}, found {self.next!r}")

    def end(self) -> None:
        if self.next:
            raise InvalidExpression(f"unexpected {self.next!r}")

    def operand(self) -> Path | Value:
        t = self.next
        if not t or not re.match(r"[:#]?[A-Za-z_]", t):
            raise InvalidExpression(f"expected an attribute or a placeholder, found {t!r}")
        self.at += 1
        if t[0] == ":":
            for key in (t, t[1:]):
                if key in self.values:
                    return Value(self.values[key])
            raise InvalidExpression(f"no value for {t}")
        if t[0] == "#":
            return Path(self.names.get(t, self.names.get(t[1:], t)))
        return Path(t)

    def path(self) -> Path:
        x = self.operand()
        if not isinstance(x, Path):
            raise InvalidExpression("expected an attribute")
        return x


def _keywords(r: _Reader) -> None:
    if r.next.upper() in ("AND", "OR", "NOT", "SET", "REMOVE", "ADD", "DELETE"):
        raise InvalidExpression(f"unexpected {r.next!r}")


def parse_condition(text: str, values: dict | None = None, names: dict | None = None):
    """The tree of a condition. values: by placeholder, names: by #name; an unknown #name stands for itself."""
    r = _Reader(text, values, names)

    def level(op: str, lower):
        parts = [lower()]
        while r.word(op):
            parts.append(lower())
        return parts[0] if len(parts) == 1 else Logic(op, tuple(parts))

    def negated():
        return Logic("NOT", (negated(),)) if r.word("NOT") else primary()

    def primary():
        if r.word("("):
            x = either()
            r.need(")")
            return x
        name = r.next.lower()
        if name in _FUNCTIONS and r.at + 1 < len(r.tokens) and r.tokens[r.at + 1] == "(":
            r.at += 2
            if name == "begins_with":
                p = r.path()
                r.need(",")
                x = Begins(p, r.operand())
            else:
                x = Exists(r.path(), name == "attribute_exists")
            r.need(")")
            return x
        _keywords(r)
        left = r.operand()
        if r.next not in OPS:
            raise InvalidExpression(f"expected a comparison, found {r.next!r}")
        op = r.next
        r.at += 1
        _keywords(r)
        return Compare(op, left, r.operand())

    def either():
        return level("OR", lambda: level("AND", negated))

    tree = either()
    r.end()
    return tree


def parse_update(text: str, values: dict | None = None, names: dict | None = None) -> list[Action]:
    """The actions of an update, in order. Sums and differences are left-associative."""
    r = _Reader(text, values, names)
    out: list[Action] = []

    def amount():
        x = r.operand()
        while r.next in ("+", "-"):
            op = r.next
            r.at += 1
            x = Arithmetic(op, x, r.operand())
        return x

    while r.next:
        kind = r.next.upper()
        if not r.word("SET", "REMOVE", "ADD", "DELETE"):
            raise InvalidExpression(f"expected SET, REMOVE, ADD or DELETE, found {r.next!r}")
        while True:
            _keywords(r)
            name = r.path().name
            if kind == "SET":
                r.need("=")
                out.append(Action(kind, name, amount()))
            else:
                out.append(Action(kind, name, None if kind == "REMOVE" else r.operand()))
            if not r.word(","):
                break
    return out


# The compilers


class Typed:
    """Attributes are ordinary columns; null is absent. A name listed in the array column __nulls is an explicit Null."""

    def __init__(self, schema: T.StructType | DataFrame, strict: bool = False):
        self.schema = schema.schema if isinstance(schema, DataFrame) else schema
        self.types, self.strict = {f.name: f.dataType for f in self.schema.fields}, strict

    def family(self, x) -> str:
        if isinstance(x, Path):
            t = self.types.get(x.name)
            if t is None:
                return "absent"
            for name, kinds in (("number", T.NumericType), ("text", (T.StringType, T.CharType, T.VarcharType)), ("bytes", T.BinaryType), ("bool", T.BooleanType), ("time", (T.TimestampType, T.TimestampNTZType, T.DateType))):
                if isinstance(t, kinds):
                    return name
            return "other"
        v = x.value
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "bool"
        if isinstance(v, (int, float, decimal.Decimal, V.Number)):
            return "number"
        return "text" if isinstance(v, str) else "bytes" if isinstance(v, (bytes, bytearray)) else "time" if isinstance(v, (datetime.date, V.Timestamp)) else "other"

    def column(self, x) -> Column:
        if isinstance(x, Path):
            return F.col(f"`{x.name}`") if x.name in self.types else F.lit(None)
        if isinstance(x.value, V.Number):
            return F.lit(V.plain_number(x.value.text))
        return F.timestamp_millis(F.lit(x.value.ms)) if isinstance(x.value, V.Timestamp) else F.lit(x.value)

    def present(self, x) -> Column:
        if isinstance(x, Value):
            return F.lit(True)
        if x.name not in self.types:
            return F.lit(False)
        here = self.column(x).isNotNull()
        return here | F.coalesce(F.array_contains("__nulls", x.name), F.lit(False)) if "__nulls" in self.types else here

    def null(self, x) -> Column:
        """Whether x is an explicit Null."""
        if isinstance(x, Value):
            return F.lit(x.value is None)
        return F.coalesce(F.array_contains("__nulls", x.name), F.lit(False)) if "__nulls" in self.types else F.lit(False)

    def equal(self, a, b) -> Column:
        fa, fb = self.family(a), self.family(b)
        if "null" in (fa, fb):
            return self.null(a) & self.null(b)
        if fa != fb or fa == "absent":
            return F.lit(False)
        if self.plain(a, b):
            return self.column(a) == self.column(b)
        return F.coalesce(self.column(a) == self.column(b), self.null(a) & self.null(b))

    def plain(self, *parts) -> bool:
        """Whether a comparison of these is null just where an attribute is absent, so that it can be pushed into a scan as it is."""
        return not self.strict and "__nulls" not in self.types and len({self.family(p) for p in parts}) == 1 and self.family(parts[0]) not in ("absent", "null", "other")

    def less(self, a, b, op: str) -> Column:
        fa, fb = self.family(a), self.family(b)
        if fa != fb or fa not in ("number", "text", "bytes", "time"):
            return F.raise_error(F.lit(f"no order between {a} and {b}")).cast("boolean") if self.strict else F.lit(False)
        x, y = self.column(a), self.column(b)
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return out if self.plain(a, b) else F.coalesce(out, F.lit(False))

    def begins(self, a, b) -> Column:
        if self.family(a) != self.family(b) or self.family(a) not in ("text", "bytes"):
            return F.raise_error(F.lit("begins_with needs strings or binaries")).cast("boolean") if self.strict else F.lit(False)
        return F.startswith(self.column(a), self.column(b))

    # updates

    def start(self) -> dict[str, Column]:
        return {n: F.col(f"`{n}`") for n in self.types}

    def amount(self, x, now: dict[str, Column]) -> Column:
        if isinstance(x, Arithmetic):
            a, b = self.amount(x.left, now), self.amount(x.right, now)
            return a + b if x.op == "+" else a - b
        if isinstance(x, Value):
            return self.column(x)
        if x.name not in now:
            raise InvalidExpression(f"no attribute {x.name!r}")
        return F.when(now[x.name].isNull(), F.raise_error(F.lit(f"no attribute {x.name}")).cast(self.types.get(x.name, T.StringType()))).otherwise(now[x.name]) if self.strict else now[x.name]

    def apply(self, actions: list[Action], keys=("pk", "sk")) -> dict[str, Column]:
        """The columns after an update, in order; later actions see earlier results."""
        now = self.start()
        for a in actions:
            if a.name in keys:
                raise InvalidExpression(f"the key {a.name!r} can't be updated")
            kind = self.types.get(a.name)
            if a.kind == "SET":
                now[a.name] = self.amount(a.value, now)
            elif a.kind == "REMOVE":
                now[a.name] = F.lit(None)
            elif a.kind == "ADD":
                x = self.amount(a.value, now)
                now[a.name] = F.coalesce(now[a.name] + x, x) if a.name in now else x
            else:
                raise InvalidExpression("DELETE needs sets, which don't exist")
            if kind is not None:
                now[a.name] = now[a.name].cast(kind)
        return now


class Tagged:
    """Attributes are entries of a map from name to AV. exact: numbers are equal by text, else by value."""

    def __init__(self, attrs: str = "attrs", strict: bool = False, exact: bool = False):
        self.attrs, self.strict, self.exact = attrs, strict, exact

    def column(self, x) -> Column:
        return F.col(self.attrs)[x.name] if isinstance(x, Path) else V.av_literal(x.value)

    def present(self, x) -> Column:
        return F.coalesce(F.map_contains_key(self.attrs, x.name), F.lit(False)) if isinstance(x, Path) else F.lit(True)

    def equal(self, a, b) -> Column:
        x, y = self.column(a), self.column(b)
        number = x["n"] == y["n"] if self.exact else F.coalesce(self._double(x) == self._double(y), x["n"] == y["n"])
        rest = F.lit(True)
        for f in ("s", "b", "bool", "ts", "vec", "j"):
            rest = rest & x[f].eqNullSafe(y[f])
        return (x["t"] == y["t"]) & F.when(x["t"] == "N", number).otherwise(rest)

    @staticmethod
    def _double(x: Column) -> Column:
        return x["n"].try_cast("double")

    def less(self, a, b, op: str) -> Column:
        x, y = self.column(a), self.column(b)
        do = lambda p, q: {"<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[op]
        none = F.raise_error(F.lit("no order between these kinds")).cast("boolean") if self.strict else F.lit(False)
        same = x["t"] == y["t"]
        return F.when(same & (x["t"] == "N"), F.coalesce(do(self._double(x), self._double(y)), F.lit(False))).when(same & (x["t"] == "S"), do(x["s"], y["s"])).when(same & (x["t"] == "B"), do(x["b"], y["b"])).otherwise(none)

    def begins(self, a, b) -> Column:
        x, y = self.column(a), self.column(b)
        none = F.raise_error(F.lit("begins_with needs strings or binaries")).cast("boolean") if self.strict else F.lit(False)
        return F.when((x["t"] == "S") & (y["t"] == "S"), F.startswith(x["s"], y["s"])).when((x["t"] == "B") & (y["t"] == "B"), F.startswith(x["b"], y["b"])).otherwise(none)

    def apply(self, actions: list[Action]) -> Column:
        """The attrs map after an update."""
        none = F.create_map().cast(V.ATTRS)
        now = F.coalesce(F.col(self.attrs), none)

        def amount(x, now):
            if isinstance(x, Arithmetic):
                a, b = amount(x.left, now), amount(x.right, now)
                u, v = self._double(a), self._double(b)
                bad = F.raise_error(F.lit("arithmetic needs numbers")).cast("double")
                return V.av_number(V.double_text(F.coalesce(u + v if x.op == "+" else u - v, bad)))
            if isinstance(x, Value):
                return V.av_literal(x.value)
            return F.when(F.map_contains_key(now, x.name), now[x.name]).otherwise(F.raise_error(F.lit(f"no attribute {x.name}")).cast(V.AV))

        def without(now, name):
            return F.map_filter(now, lambda k, _: k != name)

        def put(now, name, av):
            return F.map_concat(without(now, name), F.create_map(F.lit(name), av.cast(V.AV)))

        for a in actions:
            if a.kind == "SET":
                now = put(now, a.name, amount(a.value, now))
            elif a.kind == "REMOVE":
                now = without(now, a.name)
            elif a.kind == "ADD":
                v = amount(a.value, now)
                now = put(now, a.name, F.when(F.map_contains_key(now, a.name), amount(Arithmetic("+", Path(a.name), a.value), now)).otherwise(v))
            else:
                raise InvalidExpression("DELETE needs sets, which don't exist")
        return now


def compile_condition(tree, to: Typed | Tagged, filter_only: bool = False) -> Column:
    """The tree as a boolean column, never null. filter_only: null where unknown, for use in where(): scans take more of it."""

    def known(parts, value: Column) -> Column:
        """value where all attributes are there; else unknown, or an error in strict mode."""
        out = value
        if isinstance(to, Typed) and to.plain(*parts):
            return out
        for p in parts:
            if isinstance(p, Path):
                gone = F.raise_error(F.lit(f"no attribute {p.name}")).cast("boolean") if to.strict else F.lit(None).cast("boolean")
                out = F.when(to.present(p), out).otherwise(gone)
        return out

    def walk(x) -> Column:
        if isinstance(x, Logic):
            if x.op == "NOT":
                return ~walk(x.parts[0])
            out = walk(x.parts[-1])
            for p in reversed(x.parts[:-1]):
                left = walk(p)
                if to.strict:  # CASE keeps the order of evaluation
                    out = F.when(left, out).otherwise(F.lit(False)) if x.op == "AND" else F.when(left, F.lit(True)).otherwise(out)
                else:
                    out = left & out if x.op == "AND" else left | out
            return out
        if isinstance(x, Exists):
            return to.present(x.path) if x.wanted else ~to.present(x.path)
        if isinstance(x, Begins):
            return known((x.path, x.prefix), to.begins(x.path, x.prefix))
        if isinstance(x, Within):
            if isinstance(to, Typed) and to.plain(x.path, *x.options) and all(isinstance(o, Value) for o in x.options):
                return to.column(x.path).isin([V.plain_number(o.value.text) if isinstance(o.value, V.Number) else o.value for o in x.options])
            out = F.lit(False)
            for o in x.options:
                out = out | to.equal(x.path, o)
            return known((x.path, *x.options), out)
        if isinstance(x, Between):
            return known((x.path, x.low, x.high), to.less(x.path, x.low, ">=") & to.less(x.path, x.high, "<="))
        if x.op == "=":
            return known((x.left, x.right), to.equal(x.left, x.right))
        if x.op == "<>":
            return known((x.left, x.right), ~to.equal(x.left, x.right))
        return known((x.left, x.right), to.less(x.left, x.right, x.op))

    return walk(tree) if filter_only else F.coalesce(walk(tree), F.lit(False))


def condition(text: str, df: DataFrame, values: dict | None = None, names: dict | None = None, strict: bool = False, exact: bool = False, filter_only: bool = False) -> Column:
    """Parses and compiles a condition for the rows of df: its columns, or its attrs map if it has one."""
    tree = parse_condition(text, values, names)
    tagged = "attrs" in df.columns and isinstance(df.schema["attrs"].dataType, T.MapType)
    return compile_condition(tree, Tagged("attrs", strict, exact) if tagged else Typed(df, strict), filter_only)
