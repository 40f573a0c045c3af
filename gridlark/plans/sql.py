"""SQL over frames, paths and named tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridlark.plans.frame import Frame
from gridlark.sources.paths import READERS
from gridlark.sources.read import read

STRING = r"'((?:[^']|'')*)'"
QUIET = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", re.S)


def _places(query: str) -> list[tuple[int, int, str, str | None]]:
    """(start, end, path, kind) of the quoted paths and reader calls that stand where tables do, outside comments and literals."""
    quiet = [(m.start(), m.end()) for m in QUIET.finditer(query)]
    inside = lambda i: any(a < i < b for a, b in quiet)
    out = []
    for m in re.finditer(rf"\b(?:FROM|JOIN)\s+{STRING}|,\s*{STRING}(?=\s+AS\b)", query, re.I):
        k = 1 if m[1] is not None else 2
        if not inside(m.start()):
            out.append((m.start(k) - 1, m.end(k) + 1, m[k], None))
    for m in re.finditer(rf"\b({'|'.join(READERS)})\s*\(\s*{STRING}[^()]*\)", query, re.I):
        if not inside(m.start()):
            out.append((m.start(), m.end(), m[2], READERS[m[1].lower()]))
    return sorted(out)


def run_sql(spark: SparkSession, query: str, frames: dict[str, Frame | DataFrame] | None = None) -> Frame:
    """Runs a query whose tables are frames by name, quoted paths, or reader calls on paths.

    Names are given to the query as views of its own, which go when its plan is made.
    """
    views: list[str] = []
    given = {n: f.df if isinstance(f, Frame) else f for n, f in (frames or {}).items()}
    for a, b, path, kind in reversed(_places(query)):
        name = f"__path_{uuid.uuid4().hex}"
        read(spark, path, kind).createOrReplaceTempView(name)
        views.append(name)
        query = f"{query[:a]}{name}{query[b:]}"
    kept = {n: spark.table(n) for n in given if spark.catalog.tableExists(n)}
    try:
        for n, df in given.items():
            df.createOrReplaceTempView(n)
        return Frame(spark.sql(query))
    finally:
        for n in [*views, *given]:
            spark.catalog.dropTempView(n)
        for n, df in kept.items():
            df.createOrReplaceTempView(n)


def sql_on(frame: Frame, query: str) -> Frame:
    """A query FROM self."""
    return run_sql(frame._df.sparkSession, re.sub(r"\bself\b", "self", query, flags=re.I), {"self": frame})


class SQLContext:
    """Frames by name, and queries over them."""

    def __init__(self, spark: SparkSession, frames: dict | None = None, **named):
        self.spark, self.frames = spark, {**(frames or {}), **named}

    def register(self, name: str, frame) -> SQLContext:
        self.frames[name] = frame
        return self

    def register_many(self, frames: dict | None = None, **named) -> SQLContext:
        self.frames.update({**(frames or {}), **named})
        return self

    def tables(self) -> list[str]:
        return sorted(self.frames)

    def execute(self, query: str) -> Frame:
        return run_sql(self.spark, query, self.frames)

    sql = query = from_query = execute
