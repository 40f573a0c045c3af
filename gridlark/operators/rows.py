"""Pages of rows, sorted pages and frequency-ordered values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.dtypes import cell_text, of_spark
from gridlark.plans.order import ORD, with_file_order

DRAWN = 40
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def pick(df: DataFrame, wanted: list[str] | None) -> list[str]:
    """The wanted columns that exist, in the order asked for; by default the first ones."""
    return [c for c in wanted if c in df.columns] if wanted else [c for c in df.columns if c != ORD][:DRAWN]


def filter_names(names: list[str], fragment: str) -> list[str]:
    return [n for n in names if fragment.lower() in n.lower()]


def next_sort(now: str | None) -> str | None:
    """Clicking a header: ascending, descending, none."""
    return {None: "asc", "asc": "desc", "desc": None}[now]


def with_row_order(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds the row number: of the files, or of a total order of columns."""
    if ORD in df.columns:
        return df
    if order is None:
        return with_file_order(df)
    from gridlark.plans.order import Ordered

    return Ordered(df, order).row_index(ORD)


def page(df: DataFrame, start: int = 0, limit: int = 100, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows start to start + limit of the row order; a filter on the row number, so no global sort."""
    rows = with_row_order(df, order)
    start, limit = max(0, start), max(1, limit)
    return rows.where(F.col(ORD).between(start, start + limit - 1)).select(*[F.col(f"`{c}`") for c in pick(df, columns)], ORD)


def sort_keys(df: DataFrame, column: str, desc: bool) -> list[Column]:
    """Missing cells (null and '') last both ways; text that is all numeric by value, before other text."""
    c = F.col(f"`{column}`")
    way = (lambda x: x.desc_nulls_last()) if desc else (lambda x: x.asc_nulls_last())
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        value = F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
        return [way(value)]
    some = F.nullif(c, F.lit(""))
    number = F.when(some.rlike(NUMERIC), some.try_cast("double"))
    text = F.when(number.isNull(), some)
    keys = [F.when(number.isNotNull(), 0).when(text.isNotNull(), 1)]
    return [way(k) for k in (*keys, number, text)]


def sorted_page(df: DataFrame, column: str, desc: bool = False, start: int = 0, limit: int = 100, columns: list[str] | None = None, max_rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A page of the rows in sorted order, ties in row order; max_rows: sort the first rows only."""
    rows = with_row_order(df, order)
    if max_rows is not None:
        rows = rows.where(F.col(ORD) < max_rows)
    top = rows.orderBy(*sort_keys(df, column, desc), F.col(ORD)).limit(start + limit)  # the k best: no full sort
    placed = top.withColumn("__place", F.row_number().over(W.orderBy(*sort_keys(df, column, desc), F.col(ORD))) - 1)
    return placed.where(F.col("__place") >= start).select(*[F.col(f"`{c}`") for c in pick(df, columns)], F.col("__place").alias("place"))


def series(df: DataFrame, columns: list[str], max_rows: int | None = None, order: list[str] | None = None, most: int = 3) -> DataFrame:
    """The values of up to three columns, unformatted, with their row number; names that do not exist are left out."""
    known = [c for c in dict.fromkeys(columns) if c in df.columns][:most]
    rows = with_row_order(df, order).select(*[F.col(f"`{c}`") for c in known], ORD)
    return rows if max_rows is None else rows.where(F.col(ORD) < max_rows)


@dataclass
class RowPage:
    columns: list[str]
    dtypes: list[str]
    cells: list[list[str | None]]
    start: int
    more: bool


def read_page(df: DataFrame, start: int = 0, limit: int = 100, columns: list[str] | None = None, order: list[str] | None = None, sort: str | None = None, desc: bool = False, max_rows: int | None = None) -> RowPage:
    """A page as text cells; the one row more that is read tells whether there are any."""
    part = sorted_page(df, sort, desc, start, limit + 1, columns, max_rows, order) if sort else page(df, start, limit + 1, columns, order)
    names = part.columns[:-1]
    kinds = [of_spark(part.schema[n].dataType) for n in names]
    got = part.orderBy(part.columns[-1]).collect()
    return RowPage(names, kinds, [[cell_text(r[n], k) for n, k in zip(names, kinds)] for r in got[:limit]], start, len(got) > limit)


def frequent_values(df: DataFrame, column: str, most: int = 50, max_rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(value, n) of a text column, the most frequent first; no rows at all if there are more than `most` values."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.select(F.lit("").alias("value"), F.lit(0).cast("bigint").alias("n")).where(F.lit(False))
    rows = df if max_rows is None else with_row_order(df, order).where(F.col(ORD) < max_rows)
    counts = rows.where(F.nullif(F.col(f"`{column}`"), F.lit("")).isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))
    # one more than may be tells whether there are too many
    top = counts.orderBy(F.desc("n"), "value").limit(most + 1)
    return top.withColumn("__all", F.count("*").over(W.partitionBy(F.lit(0)))).where(F.col("__all") <= most).drop("__all")
