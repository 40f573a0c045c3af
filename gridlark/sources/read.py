"""One entrance to all readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.errors import SourceError, UnsupportedFormat
from gridlark.sources import formats, text
from gridlark.sources.paths import fetched, files_of, kind_of, options, resolve


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files; times of day and nanosecond times are read where Spark's settings allow."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return spark.read.parquet(path)


def read(spark: SparkSession, path: str, kind: str | None = None, roots: tuple[str, ...] = (), allow_http: bool = False, first_file: bool = False, **given) -> DataFrame:
    """A lazy frame of a source. All files of a folder or glob are read; first_file takes the first one only."""
    place = resolve(path, roots, allow_http)
    if place.startswith(("http://", "https://")):
        place = fetched(spark, place)
    kind = kind or kind_of(place) or next((kind_of(f) for k in ("parquet", "csv", "json", "ipc") for f in files_of(place, k)[:1]), None)
    if first_file and kind in ("parquet", "csv", "json", "ipc"):
        place = (files_of(place, kind) or [place])[0]
    given = options(given)
    if kind == "parquet":
        return read_parquet(spark, place)
    if kind == "csv":
        return text.read_csv(spark, place, **given)
    if kind == "json":
        return text.read_json(spark, place)
    if kind == "ipc":
        return formats.read_ipc(spark, place)
    if kind == "delta":
        return formats.read_delta(spark, place)
    if kind == "excel":
        return formats.read_excel(spark, place, **given)
    if kind == "iceberg":
        raise SourceError("Iceberg tables have their schema read, not their rows")
    raise UnsupportedFormat(path)
