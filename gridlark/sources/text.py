"""CSV and JSON. Schemas are read from a bounded head of one file; rows are read by Spark."""

from __future__ import annotations

import csv as pycsv
import io
import json as pyjson
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.dtypes import of_spark
from gridlark.sources.paths import files_of

HEAD = 262_144  # bytes
INFER_ROWS, JSON_ROWS = 50, 50
LADDER = (
    ("i64", re.compile(r"[+-]?\d+$")), ("f64", re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), ("bool", re.compile(r"(true|false)$", re.I)),
    ("date", re.compile(r"\d{4}-\d{2}-\d{2}$")), ("datetime[μs]", re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")),
)
SPARK = {"i64": "bigint", "f64": "double", "bool": "boolean", "date": "date", "datetime[μs]": "timestamp_ntz", "str": "string", "": "string"}


def head_of(spark: SparkSession, path: str) -> str:
    """The first bytes of the first file, through Spark's own file system."""
    first = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
    if first is None:
        return ""
    stream = None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(first["path"])
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return bytes(stream.readNBytes(HEAD)).decode("utf-8", "replace")
    finally:
        stream.close()


def infer(values: list[str]) -> str:
    """The narrowest type that all non-blank values fit; blank if there are none."""
    some = [v.strip() for v in values if v and v.strip()]
    if not some:
        return ""
    return next((name for name, pattern in LADDER if all(pattern.match(v) for v in some)), "str")


def records(text: str, separator: str = ",", quote_char: str | None = '"', comment_prefix: str | None = None, skip_rows: int = 0) -> list[list[str]]:
    """Records of a CSV text; blank and comment lines are left out, separators may have several characters."""
    lines = text.splitlines(keepends=True)[skip_rows:]
    if comment_prefix:
        lines = [x for x in lines if not x.startswith(comment_prefix)]
    body, mark = "".join(lines), "\x1f"
    if len(separator) > 1:
        quoted = re.compile(f'({re.escape(quote_char)}(?:[^{re.escape(quote_char)}]|{re.escape(quote_char) * 2})*{re.escape(quote_char)})') if quote_char else None
        parts = quoted.split(body) if quoted else [body]
        body, separator = "".join(p if i % 2 else p.replace(separator, mark) for i, p in enumerate(parts)), mark
    style = {"quotechar": quote_char, "doublequote": True} if quote_char else {"quoting": pycsv.QUOTE_NONE}
    return [r for r in pycsv.reader(io.StringIO(body), delimiter=separator, **style) if r]


def csv_schema(head: str, infer_types: bool = False, complete: bool = True, **options) -> list[tuple[str, str]]:
    """(name, type) of the columns, from the head of a file; blank types unless inferred."""
    style = {k: options[k] for k in ("separator", "quote_char", "comment_prefix", "skip_rows") if options.get(k) is not None}
    rows = records(head, **style)
    if not complete and len(rows) > 1:
        rows = rows[:-1]  # the last record may be cut
    if not rows:
        return []
    header = options.get("has_header", True)
    names = [c if c else f"column_{i + 1}" for i, c in enumerate(rows[0])] if header else [f"column_{i + 1}" for i in range(len(rows[0]))]
    for i, name in enumerate((options.get("new_columns") or [])[: len(names)]):
        names[i] = name
    body = rows[1:] if header else rows
    types = [infer([r[i] if i < len(r) else "" for r in body[:INFER_ROWS]]) if infer_types else "" for i in range(len(names))]
    return list(zip(names, types))


def read_csv(spark: SparkSession, path: str, infer_types: bool = False, **options) -> DataFrame:
    """All rows of CSV files. A cell that does not fit its column's inferred type is an error, or null with ignore_errors."""
    head = head_of(spark, path)
    columns = csv_schema(head, infer_types, len(head.encode()) < HEAD, **options)
    separator, comment, skip = options.get("separator", ","), options.get("comment_prefix"), options.get("skip_rows", 0)
    header, quote = options.get("has_header", True), options.get("quote_char", '"')
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    if skip or (comment and len(comment) > 1) or len(separator) > 1 and quote:
        # Spark's reader has no such options: files are parsed whole, each in one task
        style = {"separator": separator, "quote_char": quote, "comment_prefix": comment, "skip_rows": skip}
        width = len(columns)

        @F.udf(T.ArrayType(T.ArrayType(T.StringType())))
        def parsed(content: bytes):
            rows = records(content.decode("utf-8", "replace"), **style)
            return [[c if c != "" else None for c in (r + [""] * width)[:width]] for r in (rows[1:] if header else rows)]

        raw = spark.read.format("binaryFile").load(path).select(F.posexplode(parsed("content")).alias("__at", "r"))
        df = raw.select(*[F.get("r", i).alias(f"c{i}") for i in range(width)])
    else:
        reader = spark.read.schema(fields).option("sep", separator).option("quote", quote or "").option("escape", quote or "").option("header", header).option("enforceSchema", True).option("multiLine", bool(quote))
        df = (reader.option("comment", comment) if comment else reader).csv(path)
    fit = lambda c, t: c.try_cast(t) if options.get("ignore_errors") else F.coalesce(c.try_cast(t), F.when(c.isNotNull(), F.raise_error(F.concat(F.lit(f"not a {t}: "), c)).cast(t)))
    return df.select(*[fit(F.col(f"c{i}"), SPARK[t]).alias(n) if t not in ("", "str") else F.col(f"c{i}").alias(n) for i, (n, t) in enumerate(columns)])


def objects(text: str, most: int = JSON_ROWS) -> list[dict]:
    """The first objects of a JSON array, of JSON lines or of a single object; a cut last one is left out."""
    decoder, at, out = pyjson.JSONDecoder(), 0, []
    while len(out) < most:
        at = text.find("{", at)
        if at < 0:
            return out
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return out
        out.append(value)
    return out


def _json_type(values: list) -> str:
    some = [v for v in values if v is not None]
    if not some:
        return ""
    first = some[0]
    if isinstance(first, bool):
        return "bool"
    if isinstance(first, int):
        return "f64" if any(isinstance(v, float) for v in some) else "i64"
    if isinstance(first, float):
        return "f64"
    if isinstance(first, list):
        return f"list[{_json_type([x for v in some if isinstance(v, list) for x in v])}]"
    if isinstance(first, dict):
        return f"struct[{len(first)}]"
    return "str"


def json_schema(head: str) -> list[tuple[str, str]]:
    """(name, type) of the keys of the first objects, in the order in which they first appear."""
    rows = objects(head)
    names = list(dict.fromkeys(k for r in rows for k in r))
    return [(n, _json_type([r.get(n) for r in rows])) for n in names]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """All rows of JSON files, arrays or lines; columns in the order in which keys first appear."""
    head = head_of(spark, path)
    lines = not head.lstrip().startswith("[") and len(objects(head, 2)) > 1
    df = spark.read.option("multiLine", not lines).json(path)
    first = [n for n, _ in json_schema(head) if n in df.columns]
    return df.select(*[f"`{n}`" for n in first + [c for c in df.columns if c not in first]])


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, of_spark(f.dataType)) for f in df.schema.fields]


__all__ = ["csv_schema", "files_of", "infer", "json_schema", "objects", "read_csv", "read_json", "records", "schema_of"]
