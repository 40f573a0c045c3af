"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every token contract here: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a temporary one where none is set and everything runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all machines share")
    return _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="gridlark-"))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a reader of it.

    This cuts the lineage without local checkpoints: a lost executor costs only the tasks that
    it ran, and the files outlive it, until `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridlark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this session has materialized, and says how many; to be called when the results that read them are written."""
    paths, jvm = _WRITTEN.pop(spark.sparkContext.applicationId, []), spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Rows in runs of about `limit` bytes of text: (the other columns, the texts as bytes).

    One text longer than the limit makes a run of its own.
    """
    for batch in batches:
        names = [n for n in batch.schema.names if n != text]
        raw = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        others = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
        start, size, n = 0, 0, batch.num_rows
        lengths = pa.compute.fill_null(pa.compute.binary_length(raw), 0).to_pylist() if n else []
        for i, length in enumerate(lengths):
            if i > start and size + length > limit:
                yield {k: v.slice(start, i - start).to_pylist() for k, v in others.items()}, [x or b"" for x in raw.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += length
        if n > start:
            yield {k: v.slice(start).to_pylist() for k, v in others.items()}, [x or b"" for x in raw.slice(start).to_pylist()]


def join_key(name: str = "doc_id") -> Column:
    """A null-safe grouping form of a nullable id."""
    return F.coalesce(F.col(name).cast("string"), F.lit("\x00null"))
