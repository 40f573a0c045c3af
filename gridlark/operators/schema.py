"""Schemas, statistics and name suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.errors import UnknownColumn
from gridlark.functions.dtypes import cell_text, of_arrow, of_spark, size_text

MOST_COLUMNS = 5000


@dataclass
class FileFacts:
    columns: list[tuple[str, str]]
    rows: int
    row_groups: int
    codecs: str
    size: int
    stats: dict[str, tuple[int | None, object, object]] = field(default_factory=dict)

    def line(self) -> str:
        return f"{self.rows:,} rows · {len(self.columns)} columns · {self.row_groups} row groups · {self.codecs} · {size_text(self.size)}"


def parquet_facts(path: str) -> FileFacts:
    """What a Parquet footer says, read once: no data pages are touched."""
    file = pq.ParquetFile(path)
    meta = file.metadata
    stats: dict[str, list] = {}
    codecs = set()
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            codecs.add(chunk.compression.lower())
            own = stats.setdefault(chunk.path_in_schema, [0, None, None])
            s = chunk.statistics
            if s is None:
                own[0] = None
                continue
            own[0] = None if own[0] is None or not s.has_null_count else own[0] + s.null_count
            if s.has_min_max:
                own[1] = s.min if own[1] is None else min(own[1], s.min)
                own[2] = s.max if own[2] is None else max(own[2], s.max)
    columns = [(f.name, of_arrow(f.type)) for f in file.schema_arrow][:MOST_COLUMNS]
    return FileFacts(columns, meta.num_rows, meta.num_row_groups, ", ".join(sorted(codecs)), meta.serialized_size + sum(meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)), {k: tuple(v) for k, v in stats.items()})


def column_stats(df: DataFrame) -> DataFrame:
    """(column, dtype, nulls, min, max) as text, of all rows in one aggregation."""
    ordered = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        low, high = (F.min(c).cast("string"), F.max(c).cast("string")) if f in ordered else (F.lit(None).cast("string"),) * 2
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(of_spark(f.dataType)).alias("dtype"), F.count_if(c.isNull()).alias("nulls"), low.alias("min"), high.alias("max")))
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def details(df: DataFrame) -> list[dict]:
    """The statistics as rows of text for people."""
    return [{k: cell_text(v) for k, v in r.asDict().items()} for r in column_stats(df).collect()]


def nearest_names(names: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(name, suggestion, distance, place): the known names closest to each name, both as single-column frames.

    A name that differs in case only comes first. Others may differ by max(1, n / 3 + 1) edits of the
    lower-case forms, and by 8 characters in length.
    """
    pairs = names.select(F.col(names.columns[0]).alias("name")).join(known.select(F.col(known.columns[0]).alias("suggestion")), F.expr("abs(char_length(name) - char_length(suggestion)) <= 8"))
    distance = F.levenshtein(F.lower("name"), F.lower("suggestion"))
    allowed = F.greatest(F.lit(1), F.floor(F.char_length("name") / 3).cast("int") + 1)
    near = pairs.withColumn("distance", distance).where(distance <= allowed)
    from pyspark.sql import Window as W

    return near.withColumn("place", F.row_number().over(W.partitionBy("name").orderBy("distance", "suggestion"))).where(F.col("place") <= most)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(name: str, known: list[str], most: int = 3) -> list[str]:
    """As nearest_names, for one name on the driver."""
    allowed = max(1, len(name) // 3 + 1)
    scored = [(0 if k.lower() == name.lower() else _edits(name.lower(), k.lower()), k) for k in known if abs(len(k) - len(name)) <= 8]
    return [k for d, k in sorted(scored) if d <= allowed][:most]


def check_columns(df: DataFrame, names: list[str]) -> None:
    """Raises UnknownColumn, with suggestions, for the first name that df does not have."""
    for n in names:
        if n not in df.columns:
            raise UnknownColumn(n, nearest(n, df.columns))


def struct_field(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path, or None."""
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


def all_columns(frames: list[DataFrame]) -> dict[str, str]:
    """Every column of some frames; the first type of a name wins."""
    out: dict[str, str] = {}
    for df in frames:
        for f in df.schema.fields:
            out.setdefault(f.name, of_spark(f.dataType))
    return out


def schema_frame(spark: SparkSession, columns: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(columns)], "place int, column string, dtype string")
