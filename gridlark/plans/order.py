"""Row order that survives shuffles, and running operations that need no single task.

A DataFrame has no row order of its own. Files have one (`with_file_order`), and so has any total order of columns
(`with_order`). Running sums, fills and shifts over a whole frame are computed block by block: blocks are
ranges of the order column, each is a window partition, and what a block passes on is one row that
the blocks after it pick up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORD = "__ord"
FOLDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _source_fields(df: DataFrame) -> list[str]:
    """What the files say of each row; nothing for other sources, whose rows come in the order of their partitions."""
    node, jvm = df._jdf.queryExecution().analyzed(), df.sparkSession._jvm
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = jvm.scala.jdk.javaapi.CollectionConverters.asJava(node.children())[0]
    try:
        return df.select("_metadata").schema[0].dataType.fieldNames()
    except AnalysisException:
        if node.nodeName() in ("RelationV2", "DataSourceV2Relation", "LocalRelation", "LogicalRDD", "Generate", "Range"):
            return []
        raise ValueError("these rows are no longer in a source's order: name columns that order them") from None


def with_file_order(df: DataFrame, name: str = ORD) -> DataFrame:
    """Numbers the rows of a source from 0: files by path, rows as they stand in them.

    Parquet knows the row's place in its file. Of text files a task reads one piece after the other, so a row's
    place is that of its piece, then the order in which the task met it. Other sources have their rows partition by partition.
    """
    fields, met = _source_fields(df), F.monotonically_increasing_id()
    if "row_index" in fields:
        keys, place = {"__file": F.col("_metadata.file_path")}, F.col("_metadata.row_index")
    elif "file_block_start" in fields:
        keys, place = {"__file": F.col("_metadata.file_path"), "__piece": F.col("_metadata.file_block_start")}, met
    else:
        keys, place = {"__piece": F.shiftright(met, 33)}, met
    marked = df.select("*", place.alias("__at"), *[c.alias(n) for n, c in keys.items()])
    # one row a file or piece
    sizes = marked.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    begin = sizes.select(*keys, "__first", (F.sum("__n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__begin"))
    return marked.join(begin, list(keys)).withColumn(name, F.col("__begin") + F.col("__at") - F.col("__first")).drop("__at", "__first", "__begin", *keys)


#: Sampled rows for each block; cuts only balance the blocks, results do not depend on them.
SAMPLES = 20


def _key(by: Sequence[str], named: Sequence[str] | None = None) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(named or by, by)])


def cuts_of(df: DataFrame, by: Sequence[str], rows: int = 200_000, most: int = 4096, spread: bool = True) -> list[Row]:
    """Where blocks of about `rows` rows begin: values of all order columns together, so ties in the first one do not matter.

    spread: small frames too have blocks for the cluster's cores, down to 10,000 rows each.
    """
    n = df.count()
    least = min(df.sparkSession.sparkContext.defaultParallelism, n // 10_000) if spread else 1
    blocks = max(1, least, min(most, -(-n // rows)))
    if blocks == 1:
        return []
    sampled = df.select(_key(by).alias("k")).sample(min(1.0, SAMPLES * blocks / n), seed=7)
    places = F.transform(F.sequence(F.lit(1), F.lit(blocks - 1)), lambda i: F.get(F.col("s"), (i * F.size("s") / F.lit(blocks)).cast("int")))
    found = sampled.agg(F.array_sort(F.collect_list("k")).alias("s")).select(F.array_distinct(places).alias("c")).first()["c"]
    return [c for c in found if c is not None]


def block_column(df: DataFrame, by: Sequence[str], cuts: Sequence[Row], wide: int = 64, named: Sequence[str] | None = None) -> Column:
    """How many cuts lie at or before a row: found among every `wide`-th cut first, then among those in between.

    named: other columns that hold the place looked up.
    """
    if not cuts:
        return F.lit(0)
    literal = lambda c: F.struct(*[F.lit(c[i]).cast(df.schema[n].dataType).alias(n) for i, n in enumerate(by)])
    before = lambda edges: F.size(F.filter(edges, lambda c: c <= _key(by, named)))
    if len(cuts) <= wide:
        return before(F.array(*[literal(c) for c in cuts]))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    first = F.greatest(before(F.array(*[literal(g[0]) for g in groups])) - 1, F.lit(0))
    return first * wide + before(F.get(F.array(*[F.array(*[literal(c) for c in g]) for g in groups]), first))


class Ordered:
    """A frame with a total order of columns (`by`) and its blocks, which are ranges of that order.

    like: an Ordered over the same rows, whose cuts are taken over.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], partition: Sequence[str] = (), rows: int = 200_000, like: Ordered | None = None, spread: bool = True):
        self.partition, self.by = list(partition), list(by)
        self.columns = df.columns
        # inside user partitions, windows are spread already
        self.cuts = like.cuts if like else [] if self.partition else cuts_of(df, self.by, rows, spread=spread)
        self.df = df.withColumn("__block", block_column(df, self.by, self.cuts))

    def _window(self, backward: bool = False):
        return W.partitionBy(*self.partition, "__block").orderBy(*[F.col(f"`{c}`").desc_nulls_last() if backward else F.col(f"`{c}`").asc_nulls_first() for c in self.by])

    def _done(self, df: DataFrame, *names: str) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in self.columns if c not in names], *[F.col(f"`{n}`") for n in names])

    def many(self, asked: Sequence[tuple[str, Column, str]]) -> DataFrame:
        """The frame with a column for each (kind, value, name), all in one pass over the blocks.

        sum, count, min and max run over the values so far; forward and backward carry the last or next value that is not null.
        A window runs inside each block; what a block passes on is one row, and those of the blocks before are put together.
        """
        inside, passed, brought, final = {}, [], [], []
        for i, (kind, value, name) in enumerate(asked):
            near, far, back = f"__near{i}", f"__far{i}", kind == "backward"
            fold = FOLDS.get(kind)
            # backwards is forwards in the opposite order: a frame that begins at each row would be run through again for each
            window, blocks = self._window(back).rowsBetween(W.unboundedPreceding, 0), W.orderBy(F.col("__block").desc() if back else F.col("__block").asc()).rowsBetween(W.unboundedPreceding, -1)
            inside[near] = fold(value).over(window) if fold else F.last(value, ignorenulls=True).over(window)
            passed.append((fold(value) if fold else (F.min_by if back else F.max_by)(value, F.when(value.isNotNull(), _key(self.by)))).alias(f"__end{i}"))
            brought.append((F.sum if kind == "count" else fold or (lambda c: F.last(c, ignorenulls=True)))(F.col(f"__end{i}")).over(blocks).alias(far))
            n, f = F.col(near), F.col(far) if self.cuts else F.lit(None)
            joined = {"sum": lambda n=n, f=f: F.coalesce(n + f, n, f), "count": lambda n=n, f=f: n + F.coalesce(f, F.lit(0)), "min": lambda n=n, f=f: F.least(n, f), "max": lambda n=n, f=f: F.greatest(n, f)}.get(kind, lambda n=n, f=f: F.coalesce(n, f))
            final.append((joined() if self.cuts else n).alias(name))
        df = self.df.withColumns(inside)
        if self.cuts:
            before = self.df.groupBy("__block").agg(*passed).select("__block", *brought)
            df = df.join(before, "__block", "left")
        names = {n for _, _, n in asked}
        return df.select(*[F.col(f"`{c}`") for c in self.columns if c not in names], *final)

    def row_index(self, name: str) -> DataFrame:
        df = self.many([("count", F.lit(1), name)])
        return df.withColumn(name, F.col(f"`{name}`") - 1)

    def cumulative(self, column: str, kind: str, name: str) -> DataFrame:
        """Running sum, count, min or max; a null stays null but does not reset."""
        c = F.col(f"`{column}`")
        df = self.many([(kind, c, "__run")])
        return df.withColumn(name, F.col("__run") if kind == "count" else F.when(c.isNotNull(), F.col("__run"))).drop("__run")

    def fill(self, column: str, forward: bool, name: str, value: Column | None = None) -> DataFrame:
        """The last (or next) value of a column that is not null; value: what is carried, by default the column."""
        c = F.col(f"`{column}`")
        return self.many([("forward" if forward else "backward", F.when(c.isNotNull(), c if value is None else value), name)])

    def shift(self, columns: Sequence[str], n: int, suffix: str) -> DataFrame:
        """The values n rows before, as <column><suffix>."""
        if not self.cuts:
            names = [c + suffix for c in columns]
            return self._done(self.df.withColumns({c + suffix: F.lag(f"`{c}`", n).over(self._window()) for c in columns}), *names)
        indexed = self.row_index("__i")
        other = indexed.select((F.col("__i") + n).alias("__i"), *[F.col(f"`{c}`").alias(c + suffix) for c in columns])
        return indexed.join(other, "__i", "left").drop("__i")
