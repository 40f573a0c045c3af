"""Chart-ready aggregates of whole tables.

Every chart is a small frame (series, x, y, label, n). What a plan depends on (ranges, numbers of distinct
values, whether text is all dates) is asked in one aggregation first; then one grouped plan gives the
points, and only these leave the executors.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.dtypes import family, is_calendar, number_text, of_spark
from gridlark.operators.rows import with_row_order
from gridlark.plans.order import ORD, Ordered

BARS, BINS, SCATTER, LINE, FEW, SERIES, EXACT, LABEL = 24, 30, 2000, 800, 12, 6, 200, 28
GRAINS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
AGGS = ("count", "sum", "mean", "median", "min", "max")
ISO = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SHAPE = "series string, x double, y double, label string, n bigint"


@dataclass
class ChartRequest:
    x: str
    y: str | None = None
    kind: str | None = None
    agg: str | None = None
    grain: str | None = None
    split: str | None = None
    order: list[str] | None = None  # a total order of rows; by default the files'
    untyped: bool = False  # text columns come from a source without types: mostly numbers makes a number


@dataclass
class Chart:
    kind: str
    points: DataFrame | None
    kinds: list[str] = field(default_factory=list)
    agg: str | None = None
    x_label: str = ""
    y_label: str = ""
    notes: list[str] = field(default_factory=list)
    empty: str | None = None
    domain: tuple[float, float] | None = None
    duration: bool = False  # the value axis is in microseconds of time span


def kinds_for(x: str, y: str | None = None) -> list[str]:
    """Kinds that suit two families, the default first."""
    if y is None:
        return ["bar"] if x == "category" else ["histogram", "bar"]
    return {"temporal": ["line", "scatter", "bar"], "number": ["scatter", "line", "bar"]}.get(x, ["bar"])


def split_kinds(x: str, y: str | None) -> list[str]:
    if x == "category":
        return ["bar"]
    if x == "number":
        return ["scatter", "line", "bar"] if y else ["histogram", "bar", "line"]
    return ["line", "scatter", "bar"] if y else ["line", "scatter"]


def default_axis(columns: list[tuple[str, str]]) -> str | None:
    """The first numeric column, else the first that is not nested."""
    return next((n for n, t in columns if family(t) == "number"), next((n for n, t in columns if family(t) != "nested"), None))


def ticks(low: float, high: float, n: int = 5) -> list[float]:
    return [float(f"{low + (high - low) * i / (n - 1):.4g}") for i in range(n)]


def aggregate(agg: str | None, y: Column) -> Column:
    if agg == "count":
        return F.count("*").cast("double")
    return {"sum": F.sum, "median": F.median, "min": F.min, "max": F.max}.get(agg or "mean", F.avg)(y).cast("double")


class _Charter:
    def __init__(self, df: DataFrame, request: ChartRequest):
        self.df, self.r = df, request
        self.types = {f.name: of_spark(f.dataType) for f in df.schema.fields}
        self.notes: list[str] = []
        self.nothing: str | None = None
        self.domain: tuple[float, float] | None = None

    # columns as values

    def families(self) -> None:
        """Families of the columns at hand; text that is all ISO dates becomes a date or a time."""
        texts = [c for c in dict.fromkeys((self.r.x, self.r.y)) if c and self.types.get(c) == "str"]
        if texts:
            cells = {c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in texts}
            # of the right shape, and a day that its month has
            dated = lambda c: F.bool_and(c.rlike(ISO) & F.left(c, F.lit(10)).try_cast("date").isNotNull())
            numbers = lambda c: F.count_if(c.rlike(NUMBER)) >= 0.9 * F.count(c)
            facts = self.df.agg(*[dated(cells[c]).alias(f"i{k}") for k, c in enumerate(texts)], *[F.max(F.char_length(cells[c])).alias(f"l{k}") for k, c in enumerate(texts)], *[(numbers(cells[c]) & (F.count(cells[c]) > 0)).alias(f"n{k}") for k, c in enumerate(texts)]).first()
            for k, c in enumerate(texts):
                if self.r.untyped and facts[f"n{k}"]:
                    self.types[c] = "f64"
                if facts[f"i{k}"]:
                    self.types[c] = "date" if facts[f"l{k}"] == 10 else "datetime[ms]"
                    zone = F.regexp_replace(F.col(f"`{c}`"), r"([+-]\d{2})(\d{2})?$", "$1:$2")
                    zone = F.regexp_replace(zone, r"([+-]\d{2}):$", "$1:00")
                    value = F.when(F.col(f"`{c}`").rlike(r"T.*([Z]|[+-]\d{2}(:?\d{2})?)$"), F.to_utc_timestamp(zone.try_cast("timestamp"), "UTC").cast("timestamp_ntz")).otherwise(F.col(f"`{c}`").try_cast("timestamp_ntz"))
                    self.df = self.df.withColumn(c, value)

    def number(self, name: str) -> Column:
        """A column's values as doubles; times as epoch milliseconds; null for what is not finite."""
        c, kind = F.col(f"`{name}`"), self.df.schema[name].dataType
        if isinstance(kind, T.StringType):
            v = F.when(c.rlike(NUMBER), c.try_cast("double"))
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            v = F.floor(F.unix_micros(c.cast("timestamp")) / 1000).cast("double")
        elif isinstance(kind, T.BooleanType):
            v = c.cast("int").cast("double")
        elif isinstance(kind, T.DayTimeIntervalType):
            v = F.expr(f"extract(day from `{name}`) * 86400 + extract(hour from `{name}`) * 3600 + extract(minute from `{name}`) * 60 + extract(second from `{name}`)").cast("double") * 1e6
        else:
            v = c.cast("double")
        return F.when((F.abs(v) < float("inf")) & ~F.isnan(v), v)

    def label(self, name: str) -> Column:
        """A cell's text, cut at 28 characters; missing cells are null. Groups are those of the text."""
        c, kind = F.col(f"`{name}`"), self.df.schema[name].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            text = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            text = F.date_format(c, "yyyy-MM-dd") if self.types[name] == "date" else F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS"), r"\.000$", "")
        else:
            text = F.nullif(c.cast("string"), F.lit(""))
        return F.when(F.char_length(text) > LABEL, F.concat(F.left(text, F.lit(LABEL)), F.lit("…"))).otherwise(text)

    def period(self, name: str, grain: str) -> Column:
        return F.date_trunc(grain, F.col(f"`{name}`")).cast("timestamp_ntz")

    # what a plan depends on

    def ask(self, parts: dict[str, Column], x: Column | None = None, split: Column | None = None) -> None:
        """One aggregation over the rows: those without a value in any of the parts are noted, or why there is nothing to draw.

        Also the range of x and about how many values it and the split have.
        """
        every = reduce(lambda a, b: a & b, [c.isNotNull() for c in parts.values()])
        wanted = {"rows": F.count("*"), "all": F.count_if(every)} | {f"c{i}": F.count(c) for i, c in enumerate(parts.values())}
        if x is not None:
            kept = F.when(every, x)
            wanted |= {"low": F.min(kept), "high": F.max(kept), "values": F.approx_count_distinct(kept)}
        if split is not None:
            wanted["labels"] = F.approx_count_distinct(split)
        self.found = self.df.agg(*[c.alias(n) for n, c in wanted.items()]).first().asDict()
        f = self.found
        if not f["all"]:
            empty = next((n for i, n in enumerate(parts) if not f[f"c{i}"]), None)
            self.nothing = f"{empty} has no value to draw." if empty else f"No row has a value in all of {', '.join(parts)}."
        elif f["rows"] > f["all"]:
            n = f["rows"] - f["all"]
            self.notes.append(f"{n:,} row{'' if n == 1 else 's'} skipped: no value in {' or '.join(parts)}.")
        if f.get("labels", 0) > SERIES - 1:
            labels = self.df.select(split.alias("s")).where("s is not null").distinct().count()
            if labels > SERIES:
                self.notes.append(f"{list(parts)[-1]} has {labels:,} values; the {SERIES} busiest are drawn.")

    def capped(self, name: str, labels: Column, which: str) -> None:
        """Says so if there are more bars than are drawn."""
        n = self.df.select(labels.alias("s")).where("s is not null").distinct().count() if self.found["values"] > BARS - 6 else 0
        if n > BARS:
            self.notes.append(f"{name} has {n:,} distinct values; {which}.")

    # plans

    @staticmethod
    def out(df: DataFrame, x=None, y=None, series=None, label=None, n=None) -> DataFrame:
        null = lambda c, t: (F.lit(None) if c is None else c).cast(t)
        return df.select(null(series, "string").alias("series"), null(x, "double").alias("x"), null(y, "double").alias("y"), null(label, "string").alias("label"), null(n, "bigint").alias("n"))

    def few_values(self, name: str) -> bool:
        n = self.df.select(self.number(name).alias("v")).where("v is not null").distinct().limit(FEW + 1).count()
        return 1 <= n <= FEW

    def histogram(self, name: str) -> DataFrame:
        rows = self.df.select(self.number(name).alias("v"))
        self.ask({name: self.number(name)}, self.number(name))
        if self.nothing:
            self.nothing = f"{name} has no numbers."
            return self.out(rows.where(F.lit(False)))
        low, high = self.found["low"], self.found["high"]
        self.domain = (low, high)
        if low == high:
            return self.out(rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n")), F.col("v"), F.col("n"), n=F.col("n"))
        width = (high - low) / BINS
        bin_no = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width))).cast("bigint")
        counts = rows.where("v is not null").groupBy(bin_no.alias("id")).agg(F.count("*").alias("n"))
        grid = self.df.sparkSession.range(BINS).join(counts, "id", "left")
        n = F.coalesce("n", F.lit(0))
        return self.out(grid, F.lit(low) + (F.col("id") + 0.5) * F.lit(width), n, n=n)

    def count_bars(self, name: str) -> DataFrame:
        label = self.label(name)
        self.ask({name: label}, label)
        self.capped(name, label, f"the {BARS} with the most rows are drawn")
        counts = self.df.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
        top = counts.orderBy(F.desc("n"), *by_text("label")).limit(BARS)
        return self.out(top, y=F.col("n"), label=F.col("label"), n=F.col("n"))

    def aggregate_bars(self, name: str, y: str, agg: str | None) -> DataFrame:
        label = self.label(name)
        self.ask({name: label, y: self.number(y)}, label)
        self.capped(name, label, f"the {BARS} largest are drawn")
        rows = self.df.select(label.alias("label"), self.number(y).alias("v")).where("label is not null and v is not null")
        groups = rows.groupBy("label").agg(aggregate(agg, F.col("v")).alias("y"), F.count("*").alias("n"))
        return self.out(groups.orderBy(F.desc("y"), *by_text("label")).limit(BARS), y=F.col("y"), label=F.col("label"), n=F.col("n"))

    def strided(self, rows: DataFrame, keys: list[str], most: int, among: str | None = None) -> DataFrame:
        """Every ceil(n / most)-th row of an order, the first included; rows has (x, y, series, __ord). among: what picked the rows besides the asked columns."""
        total = self.found["all"] if among is None else rows.count()
        stride = max(1, -(-total // most))
        if stride == 1:
            return rows
        self.notes.append(f"Every {stride}th of {total:,} rows is drawn.")
        return Ordered(rows, keys).row_index("__at").where(F.col("__at") % stride == 0)

    def raw_points(self, x: str, y: str, kind: str) -> DataFrame:
        self.ask({x: self.number(x), y: self.number(y)})
        rows = with_row_order(self.df, self.r.order).select(self.number(x).alias("x"), self.number(y).alias("y"), ORD).where("x is not null and y is not null")
        return self.out(self.strided(rows, [ORD] if kind == "scatter" else ["x", ORD], SCATTER if kind == "scatter" else LINE), F.col("x"), F.col("y"))

    def busiest(self, label: Column) -> DataFrame:
        """The six labels with the most rows."""
        counts = self.df.select(label.alias("series")).where("series is not null").groupBy("series").agg(F.count("*").alias("__n"))
        return counts.orderBy(F.desc("__n"), *by_text("series")).limit(SERIES).select("series")

    def lines(self, name: str, x: Column, y: str | None, agg: str | None, split: str | None) -> DataFrame:
        """One series for each of the busiest labels over exact x values, or over 30 buckets if these are too many."""
        label = self.label(split) if split else None
        self.ask({name: x} | ({y: self.number(y)} if y else {}) | ({split: label} if split else {}), x, label)
        rows = self.df.select(x.alias("x"), (self.number(y) if y else F.lit(1.0)).alias("v"), (F.lit("") if label is None else label).alias("series")).where("x is not null and v is not null and series is not null")
        # the estimate is good to a few hundredths; near the limit the values are counted
        about = self.found["values"]
        if about > 1.5 * EXACT or about > 0.6 * EXACT and rows.select("x").distinct().limit(EXACT + 1).count() > EXACT:
            low, width = self.found["low"], (self.found["high"] - self.found["low"]) / BINS
            self.notes.append(f"{name} has more than {EXACT} values, drawn in {BINS} buckets.")
            bucket = F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.lit(low)) / F.lit(width)))
            rows = rows.withColumn("x", F.lit(low) + (bucket + 0.5) * F.lit(width))
        if split is not None:
            # a semi-join with at most six labels, which the optimizer broadcasts by their size
            rows = rows.join(self.busiest(label), "series")
        groups = rows.groupBy("series", "x").agg(aggregate(agg if y else "count", F.col("v")).alias("y"), F.count("*").alias("n"))
        return self.out(groups, F.col("x"), F.col("y"), F.col("series") if split is not None else None, n=F.col("n"))

    def dodged(self, name: str, by_measure: bool, y: str | None, agg: str | None, split: str) -> DataFrame:
        slot, label = self.label(name), self.label(split)
        self.ask({name: slot} | ({y: self.number(y)} if y else {}) | {split: label}, slot, label)
        rows = self.df.select(slot.alias("label"), (F.lit(0.0) if by_measure else self.number(name)).alias("x"), (self.number(y) if y else F.lit(1.0)).alias("v"), label.alias("series")).where("label is not null and v is not null and series is not null")
        how = agg if y else "count"
        kept = rows.join(self.busiest(label), "series")
        if self.found["values"] > BARS - 6:
            slots = kept.select("label").distinct().count()
            if slots > BARS:
                self.notes.append(f"{name} has {slots:,} slots; " + (f"the {BARS} largest are drawn." if by_measure else f"the first {BARS} are drawn: group it by a period."))
        overall = rows.groupBy("label").agg(aggregate(how, F.col("v")).alias("__m"), F.min("x").alias("x"))
        order = [F.desc("__m"), *by_text("label")] if by_measure else [F.col("x"), *by_text("label")]
        slots = overall.join(kept.select("label").distinct(), "label", "left_semi").orderBy(*order).limit(BARS)
        groups = kept.groupBy("label", "series").agg(aggregate(how, F.col("v")).alias("y"), F.count("*").alias("n"))
        joined = groups.join(slots, "label")
        return self.out(joined, None if by_measure else F.col("x"), F.col("y"), F.col("series"), F.col("label"), F.col("n"))

    def split_histogram(self, name: str, split: str) -> DataFrame:
        label, v = self.label(split), self.number(name)
        self.ask({name: v, split: label}, None, label)
        top = self.busiest(label)
        rows = self.df.select(v.alias("v"), label.alias("series")).where("v is not null and series is not null").join(top, "series")
        facts = rows.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        if facts["a"] is None:
            return self.out(rows.where(F.lit(False)))
        low, width = facts["a"], (facts["b"] - facts["a"]) / BINS
        self.domain = (low, facts["b"])
        bin_no = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width or 1.0))).cast("bigint")
        counts = rows.groupBy("series", bin_no.alias("id")).agg(F.count("*").alias("n"))
        # every bin of every series, at most 30 by 6: bins come from an exploded sequence
        grid = top.select("series", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint"))).alias("id"))
        n = F.coalesce("n", F.lit(0))
        return self.out(grid.join(counts, ["series", "id"], "left"), F.lit(low) + (F.col("id") + 0.5) * F.lit(width), n, F.col("series"), n=n)

    def split_scatter(self, x: str, y: str, split: str) -> DataFrame:
        label = self.label(split)
        self.ask({x: self.number(x), y: self.number(y), split: label}, None, label)
        rows = with_row_order(self.df, self.r.order).select(self.number(x).alias("x"), self.number(y).alias("y"), label.alias("series"), ORD).where("x is not null and y is not null and series is not null")
        rows = rows.join(self.busiest(label), "series")
        return self.out(self.strided(rows, [ORD], SCATTER, split if self.found["labels"] > SERIES - 1 else None), F.col("x"), F.col("y"), F.col("series"))


def by_text(name: str) -> list[Column]:
    """Ties in the order of a dictionary (a A b B é), then of code points."""
    return [F.collate(F.col(name), "UNICODE"), F.col(name)]


def bin_edges(kind: str, low: float, high: float) -> list[str]:
    """A histogram's edges as text: of a date column whose bins are narrower than a day, with the time of day."""
    width = (high - low) / BINS
    if family(kind) != "temporal":
        return axis_text([low + i * width for i in range(BINS + 1)])
    whole = kind == "date" and width >= 86_400_000
    at = [dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=low + i * width) for i in range(BINS + 1)]
    return [t.strftime("%Y-%m-%d" if whole else "%Y-%m-%d %H:%M:%S") for t in at]


def chart(df: DataFrame, request: ChartRequest) -> Chart:
    """Settles kind, axes and aggregate of a request and plans its points."""
    c, r = _Charter(df, ChartRequest(**vars(request))), request
    if r.x not in df.columns:
        return Chart("bar", None, empty=f"There is no column {r.x}.")
    c.families()
    x, y, split = r.x, r.y if r.y in df.columns else None, r.split
    fx, fy = family(c.types[x]), family(c.types[y]) if y else None
    if fy and fx == "number" and fy != "number":
        x, y, fx, fy = y, x, fy, fx
    if "nested" in (fx, fy):
        return Chart("bar", None, empty=f"{x if fx == 'nested' else y} is nested and cannot be drawn.")
    labelled = y is not None and fy != "number"
    if labelled:
        split, y = y, None
    elif split and (split in (x, y) or split not in df.columns or family(c.types[split]) == "nested"):
        split = None
    agg = r.agg if r.agg in AGGS else None
    measure = (agg or "mean") if y else "count"
    done = lambda kind, kinds, points, xl=None: Chart(kind, points, kinds, measure, xl or x, f"{measure} of {y}" if y else "count", c.notes, c.nothing, c.domain, bool(y) and measure != "count" and c.types[y].startswith("duration"))
    if r.grain in GRAINS and is_calendar(c.types[x]):
        kinds = ["line", "bar", "scatter"]
        kind = r.kind if r.kind in kinds else "line"
        ms = F.floor(F.unix_micros(c.period(x, r.grain).cast("timestamp")) / 1000).cast("double")
        return done(kind, kinds, c.lines(x, ms, y, agg, split), f"{x} by {r.grain}")
    if split:
        kinds = split_kinds(fx, y)
        kind = r.kind if r.kind in kinds else kinds[0]
        if kind == "histogram":
            return done(kind, kinds, c.split_histogram(x, split))
        if kind == "scatter" and y:
            return done(kind, kinds, c.split_scatter(x, y, split))
        if kind == "bar":
            return done(kind, kinds, c.dodged(x, fx == "category", y, agg, split))
        return done(kind, kinds, c.lines(x, c.number(x), y, agg, split))
    if y:
        kinds = kinds_for(fx, fy)
        kind = r.kind if r.kind in kinds else kinds[0]
        if fx == "category":
            return done(kind, kinds, c.aggregate_bars(x, y, agg))
        return done(kind, kinds, c.raw_points(x, y, kind))
    kinds = kinds_for(fx)
    kind = r.kind if r.kind in kinds else ("bar" if fx == "number" and c.few_values(x) else kinds[0])
    return done(kind, kinds, c.histogram(x) if kind == "histogram" else c.count_bars(x))


def axis_text(values: list[float]) -> list[str]:
    return [number_text(float(f"{v:.4g}")) for v in values]
