"""A frame: a DataFrame with an optional total order of rows and the usual verbs.

Frames are immutable and lazy. Verbs that need values to know their columns (pivot, to_dummies) ask for the
distinct values first; nothing else runs before the caller acts. Order-dependent verbs use the frame's
order, never the order in which partitions happen to come.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.errors import TooManyValues, UnknownColumn
from gridlark.functions.dtypes import of_spark
from gridlark.functions.expr import Context, Expr, as_expr, col, moved, one, quoted, settle
from gridlark.functions.selectors import Selector
from gridlark.operators.schema import check_columns, nearest
from gridlark.plans.order import FOLDS, ORD, Ordered, block_column, cuts_of, with_file_order

MICROS = {"us": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def micros(span: str) -> int:
    """Microseconds of a span such as 15m, 1h or 2d."""
    parts = re.findall(r"(\d+)(us|ms|[smhdw])", span)
    return sum(int(n) * MICROS[u] for n, u in parts)


MOST_VALUES = 10_000


def _few(rows: DataFrame, what: str, order: Sequence[str] = ()) -> list:
    """The distinct rows, of which there have to be MOST_VALUES at most."""
    found = rows.distinct().orderBy(*[quoted(n) for n in order]).limit(MOST_VALUES + 1).collect() if order else rows.distinct().limit(MOST_VALUES + 1).collect()
    if len(found) > MOST_VALUES:
        raise TooManyValues(f"{what} has more than {MOST_VALUES} distinct values")
    return found


class Frame:
    def __init__(self, df: DataFrame, order: Sequence[str] = (), index: Sequence[str] = ()):
        self._df, self.order, self.index = df, tuple(order), tuple(index)

    @classmethod
    def from_files(cls, df: DataFrame) -> Frame:
        """A frame over a file source, in the files' row order."""
        return cls(with_file_order(df), (ORD,))

    # what is there

    @property
    def df(self) -> DataFrame:
        return self._df.drop(ORD)

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c != ORD]

    @property
    def schema(self) -> list[tuple[str, str]]:
        return [(f.name, of_spark(f.dataType)) for f in self._df.schema.fields if f.name != ORD]

    def _ctx(self) -> Context:
        return Context.of(self._df, self.order)

    def _with(self, df: DataFrame, order: Sequence[str] | None = None) -> Frame:
        order = self.order if order is None else order
        return Frame(df, order if set(order) <= set(df.columns) else (), self.index if set(self.index) <= set(df.columns) else ())

    def _pairs(self, exprs: Iterable, named: dict | None = None, ctx: Context | None = None) -> list[tuple[str, Column]]:
        """Names and columns; without a context of the caller's, row-order functions need over()."""
        given, ctx, flat = ctx, ctx or self._ctx(), []
        for e in exprs:
            flat += list(e) if isinstance(e, (list, tuple)) else [e]
        pairs = [(n, settle(c)) for e in flat for n, c in as_expr(e).resolve(ctx)]
        pairs += [(n, one(as_expr(e), ctx)) for n, e in (named or {}).items()]
        if ctx.asked and given is None:
            raise ValueError("a row-order function without over() has to be selected first")
        return pairs

    def _ready(self, ctx: Context) -> Frame:
        """This frame with the row-order functions that were asked for, each computed by ranges of the order."""
        if not ctx.asked:
            return self
        order, df = self._need_order(), self._df
        first = Ordered(df, order)
        todo = list(enumerate(ctx.asked))
        while todo:
            # those that need no other that is still to be computed go together
            ready = [(i, p) for i, p in todo if not any(f"__w{j}" in str(p.column) for j, _ in todo)]
            todo = [t for t in todo if t not in ready]
            df = self._computed(df, first, ready)
        return self._with(df)

    def _computed(self, df: DataFrame, first: Ordered, asked: list) -> DataFrame:
        x, w = (lambda i: f"__x{i}"), (lambda i: f"__w{i}")
        df = df.withColumns({x(i): p.column for i, p in asked})
        running = [(i, p) for i, p in asked if p.kind in FOLDS or p.kind in ("forward", "backward")]
        if running:
            df = Ordered(df, first.by, like=first).many([(p.kind, F.col(x(i)), w(i)) for i, p in running])
            df = df.withColumns({w(i): F.when(F.col(x(i)).isNotNull(), F.col(w(i))) for i, p in running if p.kind in ("sum", "min", "max")})
        moves: dict[int, list] = {}
        for i, p in asked:
            if p.kind in ("shift", "diff", "change"):
                moves.setdefault(p.n, []).append((i, p))
        for n, some in moves.items():
            df = Ordered(df, first.by, like=first).shift([x(i) for i, _ in some], n, "__was")
            df = df.withColumns({w(i): moved(p.kind, F.col(x(i)), F.col(x(i) + "__was")) for i, p in some}).drop(*[x(i) + "__was" for i, _ in some])
        for i, p in asked:
            if p.kind == "rank":
                ties = df.where(F.col(x(i)).isNotNull()).groupBy(F.col(x(i)).alias("__v")).agg(F.count("*").alias("__n"))
                upto = Ordered(ties, ["__v"]).cumulative("__n", "sum", "__upto")
                df = df.join(upto, F.col(x(i)) == F.col("__v"), "left").withColumn(w(i), F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).drop("__v", "__n", "__upto")
        return df.drop(*[x(i) for i, _ in asked])

    def _where(self, test: Column, ctx: Context) -> Frame:
        return self._with(self._ready(ctx)._df.where(test).drop(*[f"__w{i}" for i in range(len(ctx.asked))]))

    def _names(self, exprs: Iterable) -> list[str]:
        out: list[str] = []
        for e in exprs:
            out += self._names(e) if isinstance(e, (list, tuple)) else e.names(self._ctx()) if isinstance(e, Selector) else [e] if isinstance(e, str) else [n for n, _ in e.resolve(self._ctx())]
        return out

    def _select(self, pairs: list[tuple[str, Column]]) -> Frame:
        hidden = [F.col(ORD)] if ORD in self._df.columns else []
        return self._with(self._df.select(*[c.alias(n) for n, c in pairs], *hidden))

    def _need_order(self) -> list[str]:
        if not self.order:
            raise ValueError("this verb depends on the order of rows: give the frame one (order=...)")
        return list(self.order)

    def _by_order(self, desc: bool = False):
        return [F.col(f"`{o}`").desc() if desc else F.col(f"`{o}`").asc() for o in self._need_order()]

    def transform(self, f) -> Frame:
        return f(self)

    # projection

    def select(self, *exprs, **named) -> Frame:
        pairs = dict(self._pairs(exprs, named, ctx := self._ctx()))
        return self._ready(ctx)._select(list(pairs.items()))

    def with_columns(self, *exprs, **named) -> Frame:
        new = dict(self._pairs(exprs, named, ctx := self._ctx()))
        return self._ready(ctx)._select([(c, new.pop(c, quoted(c))) for c in self.columns] + list(new.items()))

    assign = with_columns

    def drop(self, *exprs, columns=()) -> Frame:
        gone = set(self._names([*exprs, *([columns] if isinstance(columns, str) else columns)]))
        return self._select([(c, quoted(c)) for c in self.columns if c not in gone])

    def drop_in_place(self, name: str) -> tuple[Frame, Frame]:
        return self.select(name), self.drop(name)

    def rename(self, mapping: dict[str, str] | None = None, columns: dict[str, str] | None = None) -> Frame:
        to = {**(mapping or {}), **(columns or {})}
        return self._select([(to.get(c, c), quoted(c)) for c in self.columns])

    def __getitem__(self, key) -> Frame:
        return self.select(*key) if isinstance(key, list) else self.select(key) if isinstance(key, str) else self

    def get_column(self, name: str) -> Frame:
        return self.select(name)

    def get_column_index(self, name: str) -> int:
        check_columns(self.df, [name])
        return self.columns.index(name)

    def cast(self, kinds: dict[str, str]) -> Frame:
        return self.with_columns(*[col(c).cast(k) for c, k in kinds.items()])

    astype = cast

    def with_row_index(self, name: str = "index") -> Frame:
        numbered = Ordered(self._df, self._need_order()).row_index(name)
        return self._with(numbered.select(F.col(name), *[quoted(c) for c in self._df.columns]))

    with_row_count = with_row_index

    def unnest(self, *names) -> Frame:
        pairs = []
        for c in self.columns:
            kind = self._df.schema[c].dataType
            if c in self._names(names) and isinstance(kind, T.StructType):
                pairs += [(f, quoted(c).getField(f)) for f in kind.fieldNames()]
            else:
                pairs.append((c, quoted(c)))
        return self._select(pairs)

    def unpivot(self, on=None, index=(), variable_name: str = "variable", value_name: str = "value") -> Frame:
        index = self._names([index] if isinstance(index, (str, Expr)) else index)
        on = self._names([on] if isinstance(on, (str, Expr)) else on) if on is not None else [c for c in self.columns if c not in index]
        return Frame(self.df.unpivot([quoted(c) for c in index], [quoted(c) for c in on], variable_name, value_name))

    def melt(self, id_vars=(), value_vars=None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return self.unpivot(value_vars, id_vars, var_name, value_name)

    def set_index(self, keys) -> Frame:
        """Columns that name the rows: first in the frame, and what stack and unstack go by."""
        names = self._names([keys] if isinstance(keys, (str, Expr)) else keys)
        out = self._select([(c, quoted(c)) for c in [*names, *[c for c in self.columns if c not in names]]])
        return Frame(out._df, out.order, names)

    def reset_index(self, drop: bool = False) -> Frame:
        """Index columns become ordinary ones, or go; without an index a row number from 0 comes, unless dropped."""
        if not self.index:
            return self if drop else self.with_row_index("index")
        out = self.drop(*self.index) if drop else self
        return Frame(out._df, out.order)

    def stack(self, variable_name: str = "variable", value_name: str = "value") -> Frame:
        """A row for each cell outside the index that is not null."""
        out = self.unpivot(index=list(self.index), variable_name=variable_name, value_name=value_name)
        return Frame(out._df.where(quoted(value_name).isNotNull()), (), [*self.index, variable_name])

    def unstack(self, values: str | None = None) -> Frame:
        """The last index column's values become columns; the frame needs one column besides its index, or `values`."""
        if not self.index:
            raise ValueError("unstack needs an index: call set_index first")
        rest = [values] if values else [c for c in self.columns if c not in self.index]
        if len(rest) != 1:
            raise ValueError(f"unstack needs one column of values, not {len(rest)}")
        out = self.pivot(self.index[-1], list(self.index[:-1]), rest[0])
        return Frame(out._df, (), self.index[:-1])

    def transpose(self, column_names: list[str], include_header: bool = False, header_name: str = "column") -> Frame:
        """Columns become rows; as many rows as there are column_names, each of which names one, in row order."""
        numbered = Ordered(self._df, self._need_order()).row_index("__row")
        long = numbered.unpivot(["__row"], [quoted(c) for c in self.columns], header_name, "__value")
        place = F.element_at(F.create_map(*[x for i, c in enumerate(self.columns) for x in (F.lit(c), F.lit(i))]), F.col(header_name))
        wide = long.groupBy(place.alias("__place"), header_name).pivot("__row", list(range(len(column_names)))).agg(F.first("__value"))
        head = [quoted(header_name)] if include_header else []
        out = wide.select("__place", *head, *[quoted(str(i)).alias(n) for i, n in enumerate(column_names)])
        return Frame(out.withColumnRenamed("__place", ORD), (ORD,))

    def explode(self, *columns) -> Frame:
        """One row an element; an empty or null list is one null."""
        names = self._names(columns)
        if len(names) == 1:
            return self._select([(c, F.explode_outer(quoted(c)) if c in names else quoted(c)) for c in self.columns])
        zipped = self._df.withColumn("__z", F.explode_outer(F.arrays_zip(*[quoted(n).alias(n) for n in names])))
        return self._with(zipped)._select([(c, F.col("__z").getField(c) if c in names else quoted(c)) for c in self.columns])

    # rows

    def filter(self, *predicates, **equal) -> Frame:
        ctx = self._ctx()
        tests = [one(as_expr(p), ctx) for p in predicates] + [quoted(c) == F.lit(v) for c, v in equal.items() if self._known(c)]
        return self._where(reduce(lambda a, b: a & b, tests, F.lit(True)), ctx)

    def _known(self, name: str) -> bool:
        if name not in self.columns:
            raise UnknownColumn(name, nearest(name, self.columns))
        return True

    def remove(self, *predicates, **equal) -> Frame:
        ctx = self._ctx()
        tests = [one(as_expr(p), ctx) for p in predicates] + [quoted(c) == F.lit(v) for c, v in equal.items() if self._known(c)]
        return self._where(~F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)), ctx)

    def query(self, text: str) -> Frame:
        """A predicate in text, with ==, and, or, not."""
        return self._with(self._df.where(re.sub(r"==", "=", text)))

    def clear(self) -> Frame:
        return self._with(self._df.where(F.lit(False)))

    def where(self, predicate, other=None) -> Frame:
        """Keeps cells where the predicate holds; others become `other`."""
        test = one(as_expr(predicate), ctx := self._ctx())
        return self._ready(ctx)._select([(c, F.when(test, quoted(c)).otherwise(F.lit(other))) for c in self.columns])

    def mask(self, predicate, other=None) -> Frame:
        return self.where(~as_expr(predicate), other)

    def _same(self, *_, **__) -> Frame:
        return self

    lazy = collect = clone = rechunk = copy = set_sorted = to_df = fetchdf = from_pandas = from_arrow = _same

    def cache(self) -> Frame:
        return self._with(self._df.cache())

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow(self):
        return self.df.toArrow()

    def sort(self, *by, descending=False) -> Frame:
        """Nulls last both ways, ties in row order."""
        names = self._pairs(by)
        desc = [descending] * len(names) if isinstance(descending, bool) else list(descending)
        keys = [c.desc_nulls_last() if d else c.asc_nulls_last() for (_, c), d in zip(names, desc)]
        return self._with(self._df.orderBy(*keys, *[F.col(f"`{o}`") for o in self.order]))

    sort_values = sort_by = sort

    def sort_index(self, descending: bool = False) -> Frame:
        return self._with(self._df.orderBy(*self._by_order(descending)))

    def reverse(self) -> Frame:
        return self.sort_index(descending=True)

    def top_k(self, k: int, by, largest: bool = True) -> Frame:
        """The k rows with the largest keys; nulls never come before values."""
        keys = [c.desc_nulls_last() if largest else c.asc_nulls_last() for _, c in self._pairs([by] if not isinstance(by, list) else by)]
        return self._with(self._df.orderBy(*keys, *[F.col(f"`{o}`") for o in self.order]).limit(k))

    def bottom_k(self, k: int, by) -> Frame:
        return self.top_k(k, by, False)

    def nlargest(self, n: int, columns) -> Frame:
        return self.top_k(n, columns)

    def nsmallest(self, n: int, columns) -> Frame:
        return self.bottom_k(n, columns)

    def _numbered(self) -> DataFrame:
        return self._df.withColumn("__i", F.col(ORD)) if self.order == (ORD,) else Ordered(self._df, self._need_order()).row_index("__i")

    def slice(self, start: int, n: int | None = None) -> Frame:
        df = self._numbered()
        if start < 0:
            start += df.count()
        keep = F.col("__i") >= start
        return self._with(df.where(keep if n is None else keep & (F.col("__i") < start + n)).drop("__i"))

    def head(self, n: int = 5) -> Frame:
        return self._with(self._df.orderBy(*self._by_order()).limit(n))

    limit = head

    def tail(self, n: int = 5) -> Frame:
        return self._with(self._df.orderBy(*self._by_order(True)).limit(n))

    def first(self) -> Frame:
        return self.head(1)

    def last(self) -> Frame:
        return self.tail(1)

    def gather(self, places: Sequence[int]) -> Frame:
        wanted = self._df.sparkSession.createDataFrame([(p,) for p in places], "__i bigint")
        return self._with(self._numbered().join(wanted, "__i", "left_semi").drop("__i"))

    take = gather

    def sample(self, fraction: float, seed: int = 0) -> Frame:
        return self._with(self._df.sample(fraction, seed=seed))

    def unique(self, subset=None) -> Frame:
        """The first row, in row order, of each group of equal rows."""
        keys = self._names([subset] if isinstance(subset, (str, Expr)) else subset) if subset else self.columns
        if not self.order:
            return self._with(self._df.dropDuplicates(keys))
        firsts = self._df.groupBy(*[quoted(k) for k in keys]).agg(F.min_by(F.struct(*[quoted(c) for c in self._df.columns]), F.struct(*self._by_columns())).alias("__r"))
        return self._with(firsts.select("__r.*"))

    drop_duplicates = distinct = unique

    def _by_columns(self):
        return [F.col(f"`{o}`") for o in self._need_order()]

    def duplicated(self, subset=None, name: str = "duplicated") -> Frame:
        keys = subset or self.columns
        return self._with(self._df.withColumn(name, F.count("*").over(W.partitionBy(*[quoted(k) for k in keys])) > 1))

    # missing values

    def fill_null(self, value) -> Frame:
        """Fills the columns whose type takes the value."""
        fits = lambda t: isinstance(t, T.BooleanType) if isinstance(value, bool) else isinstance(t, T.NumericType) if isinstance(value, (int, float)) else isinstance(t, T.StringType)
        return self._select([(c, F.coalesce(quoted(c), F.lit(value).cast(self._df.schema[c].dataType)) if fits(self._df.schema[c].dataType) else quoted(c)) for c in self.columns])

    fillna = fill_null

    def fill_nan(self, value) -> Frame:
        real = (T.DoubleType, T.FloatType)
        return self._select([(c, F.nanvl(quoted(c), F.lit(value).cast("double")) if isinstance(self._df.schema[c].dataType, real) else quoted(c)) for c in self.columns])

    def drop_nulls(self, subset=None) -> Frame:
        return self._with(self._df.dropna(subset=list(subset or self.columns)))

    dropna = drop_nulls

    def drop_nans(self, subset=None) -> Frame:
        real = [c for c in subset or self.columns if isinstance(self._df.schema[c].dataType, (T.DoubleType, T.FloatType))]
        return self._with(reduce(lambda d, c: d.where(~F.coalesce(F.isnan(quoted(c)), F.lit(False))), real, self._df))

    def _filled(self, names, kind: str) -> Frame:
        names = names or [c for c in self.columns if c not in self.order]
        filled = Ordered(self._df, self._need_order()).many([(kind, quoted(c), f"__f_{c}") for c in names])
        return self._with(filled.select(*[quoted(f"__f_{c}").alias(c) if c in names else quoted(c) for c in self._df.columns]))

    def forward_fill(self, *columns) -> Frame:
        return self._filled(columns, "forward")

    def backward_fill(self, *columns) -> Frame:
        return self._filled(columns, "backward")

    ffill, bfill = forward_fill, backward_fill

    def interpolate(self, *columns) -> Frame:
        """Linear by row place between known neighbours; the ends stay null."""
        names = list(columns) or [c for c, t in self.schema if re.match(r"[iuf]\d", t)]
        placed = Ordered(self._df, self._need_order())
        df = placed.row_index("__i")
        pair = {c: F.when(quoted(c).isNotNull(), F.struct(F.col("__i").alias("i"), quoted(c).cast("double").alias("v"))) for c in names}
        df = Ordered(df, self.order, like=placed).many([(kind, pair[c], f"__{kind}_{c}") for c in names for kind in ("forward", "backward")])

        def line(c: str) -> Column:
            a, b = quoted(f"__forward_{c}"), quoted(f"__backward_{c}")
            return F.when(quoted(c).isNotNull(), quoted(c).cast("double")).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("__i") - a["i"]) / (b["i"] - a["i"]))

        return self._with(df.select(*[line(c).alias(c) if c in names else quoted(c) for c in self._df.columns]))

    def shift(self, n: int = 1) -> Frame:
        moved = Ordered(self._df, self._need_order()).shift(self.columns, n, "__moved")
        keep = [F.col(f"`{o}`") for o in self.order if o not in self.columns]
        return self._with(moved.select(*[quoted(c + "__moved").alias(c) for c in self.columns], *keep))

    def round(self, digits: int = 0) -> Frame:
        return self._select([(c, F.round(quoted(c), digits) if isinstance(self._df.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else quoted(c)) for c in self.columns])

    def abs(self) -> Frame:
        return self._select([(c, F.abs(quoted(c)) if isinstance(self._df.schema[c].dataType, T.NumericType) else quoted(c)) for c in self.columns])

    # groups

    def group_by(self, *keys, **named) -> Grouped:
        return Grouped(self, self._pairs(keys, named))

    groupby = group_by

    def agg(self, *exprs, **named) -> Frame:
        return Frame(self._df.agg(*[c.alias(n) for n, c in dict(self._pairs(exprs, named)).items()]))

    def _reduce(self, how) -> Frame:
        return Frame(self._df.agg(*[(how(quoted(c)) if isinstance(self._df.schema[c].dataType, T.NumericType) else F.lit(None).cast("double")).alias(c) for c in self.columns]))

    def sum(self):
        return self._reduce(F.sum)

    def mean(self):
        return self._reduce(F.avg)

    def median(self):
        return self._reduce(F.median)

    def std(self):
        return self._reduce(F.stddev_samp)

    def var(self):
        return self._reduce(F.var_samp)

    def product(self):
        return self._reduce(F.product)

    def quantile(self, q: float):
        return self._reduce(lambda c: F.percentile(c, q))

    def min(self):
        return Frame(self._df.agg(*[F.min(quoted(c)).alias(c) for c in self.columns]))

    def max(self):
        return Frame(self._df.agg(*[F.max(quoted(c)).alias(c) for c in self.columns]))

    def null_count(self):
        return Frame(self._df.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in self.columns]))

    def value_counts(self, *columns) -> Frame:
        names = self._names(columns)
        return Frame(self._df.groupBy(*[quoted(n) for n in names]).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *[quoted(n) for n in names]))

    def aggregate(self, exprs: str, by: str = "") -> Frame:
        """Aggregates and groups given as SQL text."""
        keys = [k.strip() for k in by.split(",") if k.strip()]
        listed = ", ".join([*keys, exprs])
        return Frame(self._df.sparkSession.sql(f"SELECT {listed} FROM {{df}}" + (f" GROUP BY {', '.join(keys)}" if keys else ""), df=self.df))

    def project(self, exprs: str) -> Frame:
        return Frame(self._df.sparkSession.sql(f"SELECT {exprs} FROM {{df}}", df=self.df))

    # pivots

    def _values(self, name: str) -> list:
        return sorted(r[0] for r in _few(self._df.select(quoted(name)).where(quoted(name).isNotNull()), name))

    def pivot(self, on: str, index, values: str, aggregate: str = "first") -> Frame:
        how = {"first": F.first, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "len": F.count, "median": F.median}[aggregate]
        keys = self._names([index] if isinstance(index, (str, Expr)) else index)
        found = sorted(self._values(on), key=str)
        return Frame(self._df.groupBy(*[quoted(k) for k in keys]).pivot(on, found).agg(how(quoted(values))))

    pivot_table = pivot

    def crosstab(self, index: str, on: str) -> Frame:
        return Frame(self._df.groupBy(quoted(index)).pivot(on, sorted(self._values(on), key=str)).agg(F.count(F.lit(1))).fillna(0))

    def to_dummies(self, *columns) -> Frame:
        names = self._names(columns)
        pairs = []
        for c in self.columns:
            pairs += [(f"{c}_{v}", F.coalesce((quoted(c) == F.lit(v)).cast("tinyint"), F.lit(0).cast("tinyint"))) for v in self._values(c)] if c in names else [(c, quoted(c))]
        return self._select(pairs)

    def partition_by(self, *columns) -> dict[tuple, Frame]:
        names = self._names(columns)
        keys = [tuple(r) for r in _few(self._df.select(*[quoted(n) for n in names]), ", ".join(names), names)]
        return {k: self._with(reduce(lambda d, nv: d.where(quoted(nv[0]).eqNullSafe(F.lit(nv[1]))), zip(names, k), self._df)) for k in keys}

    # other frames

    def join(self, other: Frame, on=None, how: str = "inner", left_on=None, right_on=None, suffix: str = "_right") -> Frame:
        listed = lambda x: [x] if isinstance(x, (str, Expr)) else list(x or [])
        how = {"outer": "full"}.get(how, how)
        shared = [k for k in listed(on) if isinstance(k, str)]
        mine = self.columns
        left, lk = self._keyed(listed(on) or listed(left_on), "__lk")
        right, rk = other._keyed(listed(on) or listed(right_on), "__rk")
        if len(lk) != len(rk):
            raise ValueError(f"{len(lk)} keys on the left, {len(rk)} on the right")
        right = right.select(*[quoted(c).alias(f"__r_{c}") for c in right.columns if c != ORD])
        test = reduce(lambda a, b: a & b, [quoted(a) == quoted(f"__r_{b}") for a, b in zip(lk, rk)]) if lk else None
        if how in ("semi", "anti"):
            return self._with(left.join(right, test, f"left_{how}").select(*[quoted(c) for c in self._df.columns]))
        both = left.crossJoin(right) if how == "cross" else left.join(right, test, how)
        merged = [(c, F.coalesce(quoted(c), quoted(f"__r_{c}")) if how in ("full", "right") and c in shared else quoted(c)) for c in mine]
        extra = [(c + suffix if c in mine else c, quoted(f"__r_{c}")) for c in other.columns if c not in shared]
        return Frame(both.select(*[c.alias(n) for n, c in [*merged, *extra]]))

    def _keyed(self, keys: list, prefix: str) -> tuple[DataFrame, list[str]]:
        """The rows with a column for each computed key, and the keys' names."""
        check_columns(self.df, [k for k in keys if isinstance(k, str)])
        ctx = self._ctx()
        made = {f"{prefix}{i}": one(k, ctx) for i, k in enumerate(keys) if isinstance(k, Expr)}
        return self._ready(ctx)._df.withColumns(made), [k if isinstance(k, str) else f"{prefix}{i}" for i, k in enumerate(keys)]

    def merge(self, other: Frame, on=None, how: str = "inner", left_on=None, right_on=None, suffixes: tuple[str, str] = ("_x", "_y")) -> Frame:
        return self.join(other, on, how, left_on, right_on, suffixes[1])

    def join_asof(self, other: Frame, on=None, left_on=None, right_on=None, by=(), by_left=(), by_right=(), suffix: str = "_right") -> Frame:
        """The last row of other at or before each row's time. Both sides go through one sort: rows of other leave their values behind."""
        listed = lambda x: [x] if isinstance(x, str) else list(x or [])
        lt, rt = on or left_on, on or right_on
        lb, rb = listed(by) or listed(by_left), listed(by) or listed(by_right)
        extra = [c for c in other.columns if not (c == rt and on) and not (by and c in rb)]
        keys = [f"__k{i}" for i in range(len(lb))]
        left = self.df.select(*[quoted(a).alias(k) for a, k in zip(lb, keys)], quoted(lt).alias("__t"), F.lit(1).alias("__side"), F.struct(*[quoted(c) for c in self.columns]).alias("__l"), F.lit(None).cast(T.StructType([other.df.schema[c] for c in extra])).alias("__r"))
        right = other.df.select(*[quoted(a).alias(k) for a, k in zip(rb, keys)], quoted(rt).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__l"].dataType).alias("__l"), F.struct(*[quoted(c) for c in extra]).alias("__r"))
        both = left.unionByName(right)
        # below a million rows keys spread the work well enough; so few rows even of one key are one task's
        cuts = Ordered(both, [*keys, "__t", "__side"], rows=1_000_000 if keys else 200_000, spread=not keys)
        if keys and not cuts.cuts:
            seen = Ordered(both, ["__t", "__side"], partition=keys).fill("__r", True, "__r")
        else:
            # ranges of key and time, so that a common key is spread too; what is carried past the end of a key does not count
            marked = both.withColumn("__r", F.when(F.col("__side") == 0, F.struct(F.struct(F.lit(0).alias("__z"), *keys).alias("k"), F.col("__r").alias("r"))))
            near = Ordered(marked, cuts.by, like=cuts).fill("__r", True, "__r")
            seen = near.withColumn("__r", F.when(F.col("__r.k") == F.struct(F.lit(0).alias("__z"), *keys), F.col("__r.r")))
        seen = seen.where("__side = 1")
        return Frame(seen.select(*[F.col("__l").getField(c).alias(c) for c in self.columns], *[F.col("__r").getField(c).alias(c + suffix if c in self.columns else c) for c in extra]))

    def vstack(self, other: Frame) -> Frame:
        return concat([self, other])

    extend = vstack

    def reindex(self, keys: Frame, on: str) -> Frame:
        """A row for each key, null where the frame has none."""
        return Frame(keys.df.select(on).join(self.df, on, "left").select(*[quoted(c) for c in self.columns]))

    # time

    def group_by_dynamic(self, index_column: str, every: str, by=()) -> Grouped:
        """Windows that begin at multiples of a span since the epoch (weeks on Mondays), closed on the left."""
        keys = [by] if isinstance(by, str) else list(by)
        if every in ("1y", "1q", "1mo", "1w"):
            start = F.date_trunc({"1y": "year", "1q": "quarter", "1mo": "month", "1w": "week"}[every], quoted(index_column))
        else:
            size = micros(every)
            at = F.unix_micros(quoted(index_column).cast("timestamp"))
            start = F.timestamp_micros(at - F.pmod(at, F.lit(size)))
        return Grouped(self, [*[(k, quoted(k)) for k in keys], (index_column, start.cast("timestamp_ntz"))])

    def rolling(self, index_column: str, period: str, by=(), **aggregates) -> Frame:
        """Aggregates over (t - period, t], one row a row; given as name=expression."""
        keys = [by] if isinstance(by, str) else list(by)
        span = micros(period)
        df = self._df.withColumn("__at", F.unix_micros(quoted(index_column).cast("timestamp")))
        # ranges of time; a row also goes to the later ranges that its period reaches into, where it only counts
        cuts = cuts_of(df, ["__at"], spread=not keys)
        df = df.withColumn("__own", block_column(df, ["__at"], cuts))
        df = df.withColumn("__end", F.col("__at") + (span - 1)).withColumn("__until", block_column(df, ["__at"], cuts, named=["__end"]))
        df = df.withColumn("__block", F.explode(F.sequence("__own", F.coalesce("__until", "__own"))))
        window = W.partitionBy(*[quoted(k) for k in keys], "__block").orderBy("__at").rangeBetween(-span + 1, 0)
        ctx = self._ctx()
        seen = df.withColumns({n: one(e, ctx).over(window) for n, e in aggregates.items()}).where("__own = __block")
        return self._with(seen.drop("__at", "__own", "__end", "__until", "__block"))

    def upsample(self, time_column: str, every: str, by=()) -> Frame:
        """A regular grid from the first to the last time, null where there is no row."""
        keys = [by] if isinstance(by, str) else list(by)
        ends = self.df.groupBy(*[quoted(k) for k in keys]).agg(F.min(quoted(time_column)).alias("a"), F.max(quoted(time_column)).alias("b"))
        step = F.make_dt_interval(secs=F.lit(micros(every) / 1e6).cast("decimal(18,6)"))
        grid = ends.select(*[quoted(k) for k in keys], F.explode(F.sequence("a", "b", step)).alias(time_column))
        return Frame(grid.join(self.df, [*keys, time_column], "left").select(*[quoted(c) for c in self.columns]))


class Grouped:
    def __init__(self, frame: Frame, keys: list[tuple[str, Column]]):
        self.frame, self.keys = frame, keys

    def agg(self, *exprs, **named) -> Frame:
        pairs = dict(self.frame._pairs(exprs, named))
        names = [n for n, _ in self.keys]
        out = self.frame._df.groupBy(*[c.alias(n) for n, c in self.keys]).agg(*[c.alias(n) for n, c in pairs.items() if n not in names])
        return Frame(out.select(*[quoted(n) for n in [*names, *[p for p in pairs if p not in names]]]))

    def len(self) -> Frame:
        return Frame(self.frame._df.groupBy(*[c.alias(n) for n, c in self.keys]).agg(F.count("*").alias("len")))


def concat(frames: Sequence[Frame]) -> Frame:
    """Rows of all frames; the first one's columns, which all must have."""
    return Frame(reduce(lambda a, b: a.unionByName(b), [f.df for f in frames]))
