"""Column expressions that know the names of what they yield.

An expression is a function from a frame to (name, Column) pairs. The leftmost column names the result
of an operation. Row-order operations refer to the frame's order when they are resolved.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.errors import UnknownColumn
from gridlark.functions.dtypes import of_spark
from gridlark.operators.schema import nearest


@dataclass(frozen=True)
class Context:
    """What an expression sees of a frame: (name, type name) pairs and the columns of its row order.

    partition: the columns of over(), inside it. asked: row-order functions met so far; outside over() the
    frame computes the i-th of them as column __w<i>.
    """

    columns: tuple[tuple[str, str], ...]
    order: tuple[str, ...] = ()
    partition: tuple[str, ...] | None = None
    asked: list = field(default_factory=list, compare=False, repr=False)

    @classmethod
    def of(cls, df, order=()) -> Context:
        hidden = set(order) if set(order) <= {"__ord"} else set()
        return cls(tuple((f.name, of_spark(f.dataType)) for f in df.schema.fields if f.name not in hidden), tuple(order))

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def window(self, partition, backward: bool = False):
        keys = [F.col(f"`{o}`").desc_nulls_last() if backward else F.col(f"`{o}`").asc_nulls_first() for o in self.order]
        return W.partitionBy(*[quoted(p) for p in partition]).orderBy(*keys or [F.lit(0)])


Pairs = list[tuple[str, Column]]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Expr:
    def __init__(self, resolve: Callable[[Context], Pairs]):
        self.resolve = resolve

    # building blocks

    def _map(self, f: Callable[..., Column], *others) -> Expr:
        def resolve(ctx: Context) -> Pairs:
            args = [one(o, ctx) for o in others]
            return [(n, f(settle(c), *args)) for n, c in self.resolve(ctx)]

        return Expr(resolve)

    def _ordered(self, f: Callable[[Column, object], Column]) -> Expr:
        return Expr(lambda ctx: [(n, f(c, ctx)) for n, c in self.resolve(ctx)])

    def __getattr__(self, name: str):
        if name in _UNARY:
            return lambda *a: self._map(lambda c: _UNARY[name](c, *a))
        if name in _AGGREGATES:
            return lambda: self._map(_AGGREGATES[name])
        raise AttributeError(name)

    # names

    def alias(self, name: str) -> Expr:
        return Expr(lambda ctx: [(name, c) for _, c in self.resolve(ctx)])

    def _named(self, f: Callable[[str], str]) -> Expr:
        return Expr(lambda ctx: [(f(n), c) for n, c in self.resolve(ctx)])

    @property
    def name(self) -> _Names:
        return _Names(self)

    @property
    def str(self) -> _Text:
        return _Text(self)

    @property
    def dt(self) -> _Time:
        return _Time(self)

    @property
    def list(self) -> _List:
        return _List(self)

    @property
    def struct(self) -> _Struct:
        return _Struct(self)

    # operators: the leftmost name wins

    def __add__(self, o):
        return self._map(lambda a, b: a + b, o)

    def __radd__(self, o):
        return self._map(lambda a, b: b + a, o)

    def __sub__(self, o):
        return self._map(lambda a, b: a - b, o)

    def __rsub__(self, o):
        return self._map(lambda a, b: b - a, o)

    def __mul__(self, o):
        return self._map(lambda a, b: a * b, o)

    def __rmul__(self, o):
        return self._map(lambda a, b: b * a, o)

    def __truediv__(self, o):
        return self._map(lambda a, b: F.try_divide(a.cast("double"), b), o)

    def __floordiv__(self, o):
        return self._map(lambda a, b: F.floor(F.try_divide(a.cast("double"), b)), o)

    def __mod__(self, o):
        return self._map(lambda a, b: F.pmod(a, b), o)

    def __pow__(self, o):
        return self._map(F.pow, o)

    def __neg__(self):
        return self._map(lambda a: -a)

    def __eq__(self, o):  # noqa: PLW1641
        return self._map(lambda a, b: a == b, o)

    def __ne__(self, o):
        return self._map(lambda a, b: a != b, o)

    def __lt__(self, o):
        return self._map(lambda a, b: a < b, o)

    def __le__(self, o):
        return self._map(lambda a, b: a <= b, o)

    def __gt__(self, o):
        return self._map(lambda a, b: a > b, o)

    def __ge__(self, o):
        return self._map(lambda a, b: a >= b, o)

    def __and__(self, o):
        return self._map(lambda a, b: a & b, o)

    def __or__(self, o):
        return self._map(lambda a, b: a | b, o)

    def __xor__(self, o):
        return self._map(lambda a, b: (a | b) & ~(a & b), o)

    def __invert__(self):
        return self._map(lambda a: ~a)

    eq, ne, lt, le, gt, ge, not_ = __eq__, __ne__, __lt__, __le__, __gt__, __ge__, __invert__
    __hash__ = None

    def eq_missing(self, o):
        return self._map(lambda a, b: a.eqNullSafe(b), o)

    def ne_missing(self, o):
        return self._map(lambda a, b: ~a.eqNullSafe(b), o)

    def is_in(self, values):
        return self._map(lambda a: a.isin(list(values)))

    def is_between(self, low, high):
        return self._map(lambda a, x, y: a.between(x, y), low, high)

    def cast(self, kind: str, strict: bool = False):
        return self._map(lambda a: a.cast(SPARK_TYPES.get(kind, kind)) if strict else a.try_cast(SPARK_TYPES.get(kind, kind)))

    def fill_null(self, value):
        return self._map(F.coalesce, value)

    def fill_nan(self, value):
        return self._map(F.nanvl, value)

    def clip(self, low, high):
        return self._map(lambda a, x, y: F.greatest(F.least(a, y), x), low, high)

    def filter(self, predicate: Expr):
        return self._map(lambda a, p: F.when(p, a), predicate)

    def quantile(self, q: float):
        return self._map(lambda a: F.percentile(a, q))

    def n_unique(self):
        return self._map(lambda a: F.count_distinct(a) + F.max(a.isNull().cast("int")))

    def first(self):
        return self._ordered(lambda c, ctx: F.min_by(c, _order(ctx)))

    def last(self):
        return self._ordered(lambda c, ctx: F.max_by(c, _order(ctx)))

    def implode(self):
        """All values, nulls included, in row order."""
        return self._ordered(lambda c, ctx: F.transform(F.array_sort(F.collect_list(F.struct(_order(ctx).alias("o"), c.alias("v")))), lambda x: x["v"]))

    def unique(self):
        return self._map(lambda a: F.array_sort(F.collect_set(a)))

    def head(self, n: int = 5):
        return self.implode()._map(lambda a: F.slice(a, 1, n))

    def tail(self, n: int = 5):
        return self.implode()._map(lambda a: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n))

    def slice(self, start: int, n: int):
        return self.implode()._map(lambda a: F.slice(a, start + 1, n))

    def gather(self, places: list[int]):
        return self.implode()._map(lambda a: F.array(*[F.get(a, p) for p in places]))

    take = gather

    def drop_nulls(self):
        return self._map(lambda a: F.collect_list(a))

    def drop_nans(self):
        return self._map(lambda a: F.collect_list(F.when(~F.isnan(a), a)))

    def sort(self, descending: bool = False):
        return self._map(lambda a: F.sort_array(F.collect_list(a), not descending))

    def sort_by(self, by, descending: bool = False):
        def f(a, b):
            pairs = F.sort_array(F.collect_list(F.struct(b.alias("k"), a.alias("v"))), not descending)
            return F.transform(pairs, lambda x: x["v"])

        return self._map(f, as_expr(by))

    def reverse(self):
        return self.implode()._map(F.reverse)

    # windows

    def over(self, *partition: str) -> Expr:
        """Aggregates become window aggregates; row-order functions run inside each partition."""

        def resolve(ctx: Context) -> Pairs:
            inner = replace(ctx, partition=partition, asked=[])
            out = []
            for n, c in self.resolve(inner):
                c = settle(c)
                out.append((n, c if inner.asked else c.over(W.partitionBy(*[quoted(p) for p in partition]))))
            return out

        return Expr(resolve)

    def _running(self, kind: str, n: int = 0) -> Expr:
        return self._ordered(lambda c, ctx: _Pending(settle(c), ctx, kind, n))

    def cum_sum(self):
        return self._running("sum")

    def cum_count(self):
        return self._running("count")

    def cum_min(self):
        return self._running("min")

    def cum_max(self):
        return self._running("max")

    def shift(self, n: int = 1):
        return self._running("shift", n)

    def diff(self, n: int = 1):
        return self._running("diff", n)

    def pct_change(self, n: int = 1):
        return self._running("change", n)

    def forward_fill(self):
        return self._running("forward")

    def backward_fill(self):
        return self._running("backward")

    def rank(self):
        """Ranks from 1, ties at their average; nulls have none."""
        return self._running("rank")


FOLDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def moved(kind: str, now: Column, was: Column) -> Column:
    """A shifted value, the difference from it, or the relative change."""
    return {"shift": lambda: was, "diff": lambda: now - was, "change": lambda: F.try_divide(now.cast("double"), was) - 1}[kind]()


class _Pending:
    """A row-order function that waits for its partition, or for the frame to compute it by ranges of its order."""

    def __init__(self, column: Column, ctx: Context, kind: str, n: int):
        self.column, self.ctx, self.kind, self.n = column, ctx, kind, n

    def settled(self) -> Column:
        self.ctx.asked.append(self)
        return quoted(f"__w{len(self.ctx.asked) - 1}") if self.ctx.partition is None else self._of(self.ctx.partition)

    def _of(self, partition) -> Column:
        c, so_far = self.column, (W.unboundedPreceding, 0)
        window = self.ctx.window(partition, self.kind == "backward")
        if self.kind in FOLDS:
            run = FOLDS[self.kind](c).over(window.rowsBetween(*so_far))
            return run if self.kind == "count" else F.when(c.isNotNull(), run)
        if self.kind in ("forward", "backward"):
            return F.last(c, ignorenulls=True).over(window.rowsBetween(*so_far))
        if self.kind == "rank":
            keys = [quoted(p) for p in partition]
            return F.when(c.isNotNull(), F.rank().over(W.partitionBy(*keys).orderBy(c.asc_nulls_last())) + (F.count(c).over(W.partitionBy(*keys, c)) - 1) / 2)
        return moved(self.kind, c, F.lag(c, self.n).over(window))


def settle(c) -> Column:
    return c.settled() if isinstance(c, _Pending) else c


def _order(ctx: Context) -> Column:
    return F.struct(*[quoted(o) for o in ctx.order]) if ctx.order else F.lit(0)


class _Space:
    def __init__(self, e: Expr):
        self.e = e


class _Names(_Space):
    def suffix(self, s):
        return self.e._named(lambda n: n + s)

    def prefix(self, s):
        return self.e._named(lambda n: s + n)

    def keep(self):
        return self.e

    def to_lowercase(self):
        return self.e._named(lambda n: n.lower())

    def to_uppercase(self):
        return self.e._named(lambda n: n.upper())


class _Text(_Space):
    def contains(self, pattern: str, literal: bool = False):
        return self.e._map(lambda c: c.contains(pattern) if literal else c.rlike(pattern))

    def contains_any(self, patterns: list[str], literal: bool = False):
        tests = [re.escape(p) if literal else p for p in patterns]
        return self.e._map(lambda c: c.rlike("|".join(tests)))

    def find(self, pattern: str, literal: bool = False):
        """Place of the first match from 0, or null."""
        return self.e._map(lambda c: F.nullif(F.instr(c, pattern) if literal else F.char_length(F.regexp_substr(c, F.lit(f"(?s)^.*?(?={pattern})"))) + 1, F.lit(0)) - 1)

    def starts_with(self, s):
        return self.e._map(lambda c: c.startswith(s))

    def ends_with(self, s):
        return self.e._map(lambda c: c.endswith(s))

    def __getattr__(self, name):
        known = {"to_lowercase": F.lower, "to_uppercase": F.upper, "len_chars": F.char_length, "len_bytes": F.octet_length, "strip_chars": F.trim, "replace_all": F.regexp_replace, "split": lambda c, s: F.split(c, re.escape(s)), "slice": lambda c, a, n: F.substring(c, a + 1, n), "to_date": F.to_date}
        if name not in known:
            raise AttributeError(name)
        return lambda *a: self.e._map(lambda c: known[name](c, *a))


class _Time(_Space):
    def __getattr__(self, name):
        known = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": lambda c: F.weekday(c) + 1, "ordinal_day": F.dayofyear, "quarter": F.quarter, "week": F.weekofyear, "date": F.to_date, "truncate": lambda c, g: F.date_trunc(g, c).cast("timestamp_ntz"), "strftime": F.date_format}
        if name not in known:
            raise AttributeError(name)
        return lambda *a: self.e._map(lambda c: known[name](c, *a))


class _List(_Space):
    def __getattr__(self, name):
        known = {"len": F.size, "first": lambda c: F.get(c, 0), "last": lambda c: F.element_at(c, -1), "get": F.get, "contains": F.array_contains, "join": F.array_join, "sort": F.array_sort, "unique": F.array_distinct, "max": F.array_max, "min": F.array_min, "sum": lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)}
        if name not in known:
            raise AttributeError(name)
        return lambda *a: self.e._map(lambda c: known[name](c, *a))


class _Struct(_Space):
    def field(self, name: str):
        return Expr(lambda ctx: [(name, c.getField(name)) for _, c in self.e.resolve(ctx)])


_UNARY = {
    "abs": F.abs, "round": F.round, "floor": F.floor, "ceil": F.ceil, "exp": F.exp, "sqrt": F.sqrt, "log": lambda c, base=None: F.log(c) if base is None else F.log(float(base), c), "is_null": lambda c: c.isNull(), "is_not_null": lambda c: c.isNotNull(),
    "is_nan": F.isnan, "flatten": F.flatten, "explode": F.explode_outer,
}
_AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count, "len": lambda c: F.count("*"), "mode": lambda c: F.mode(c, True), "product": F.product, "null_count": lambda c: F.count_if(c.isNull()),
}
SPARK_TYPES = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "f32": "float", "f64": "double", "str": "string", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz", "binary": "binary"}


def one(value, ctx: Context) -> Column:
    """A single column from an expression, a Column or a plain value."""
    if isinstance(value, Expr):
        return settle(value.resolve(ctx)[0][1])
    return value if isinstance(value, Column) else F.lit(value)


def named_column(name: str, ctx: Context) -> Pairs:
    if name == "*":
        return [(n, quoted(n)) for n in ctx.names]
    if name.startswith("^") and name.endswith("$"):
        return [(n, quoted(n)) for n in ctx.names if re.search(name, n)]
    if name not in ctx.names and name not in ctx.order:
        raise UnknownColumn(name, nearest(name, ctx.names))
    return [(name, quoted(name))]


def col(*names: str) -> Expr:
    return Expr(lambda ctx: [p for n in names for p in named_column(n, ctx)])


def all_() -> Expr:
    return col("*")


def exclude(*names: str) -> Expr:
    return Expr(lambda ctx: [(n, quoted(n)) for n in ctx.names if n not in names])


def lit(value) -> Expr:
    return Expr(lambda ctx: [("literal", F.lit(value))])


def len_() -> Expr:
    return Expr(lambda ctx: [("len", F.count("*"))])


def _first_named(parts, build) -> Expr:
    def resolve(ctx: Context) -> Pairs:
        pairs = [p for e in parts for p in as_expr(e).resolve(ctx)]
        return [(pairs[0][0], build([settle(c) for _, c in pairs], [n for n, _ in pairs]))]

    return Expr(resolve)


def struct(*parts) -> Expr:
    return _first_named(parts, lambda cs, ns: F.struct(*[c.alias(n) for c, n in zip(cs, ns)]))


def concat_str(*parts, separator: str = "") -> Expr:
    """Null if any part is."""

    def build(cs, _):
        out = [cs[0].cast("string")]
        for c in cs[1:]:
            out += [F.lit(separator), c.cast("string")]
        return F.concat(*out)

    return _first_named(parts, build)


def concat_list(*parts) -> Expr:
    return _first_named(parts, lambda cs, _: F.array(*cs))


def coalesce(*parts) -> Expr:
    return _first_named(parts, lambda cs, _: F.coalesce(*cs))


def format_(pattern: str, *parts) -> Expr:
    """Each {} of the pattern takes the next part."""
    return _first_named(parts, lambda cs, _: F.format_string(pattern.replace("%", "%%").replace("{}", "%s"), *[c.cast("string") for c in cs]))


class when:  # noqa: N801
    """when(p).then(a).when(q).then(b).otherwise(c), named after the first result."""

    def __init__(self, predicate, cases=()):
        self.cases, self.predicate = list(cases), predicate

    def then(self, value):
        return _Then([*self.cases, (self.predicate, value)])


class _Then(Expr):
    def __init__(self, cases, default=None):
        self.cases, self.default = cases, default
        super().__init__(self._resolve)

    def when(self, predicate):
        return when(predicate, self.cases)

    def otherwise(self, value):
        return _Then(self.cases, value)

    def _resolve(self, ctx: Context) -> Pairs:
        first = self.cases[0][1]
        name = first.resolve(ctx)[0][0] if isinstance(first, Expr) else "literal"
        out = F
        for p, v in self.cases:
            out = out.when(one(p, ctx), one(v, ctx))
        return [(name, out if self.default is None else out.otherwise(one(self.default, ctx)))]


def as_expr(value) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, str):
        return col(value)
    if isinstance(value, Column):
        return Expr(lambda ctx: [("literal", value)])
    return lit(value)
