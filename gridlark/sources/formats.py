"""Arrow IPC, Delta, Iceberg, Excel and literal frames."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from gridlark.errors import SourceError, UnsupportedFormat
from gridlark.functions.dtypes import of_arrow
from gridlark.sources.paths import files_of


def open_ipc(path: str):
    """A reader of an Arrow file or stream, or None for what is neither."""
    try:
        return pa.ipc.open_file(pa.memory_map(path))
    except (pa.ArrowInvalid, OSError):
        try:
            return pa.ipc.open_stream(pa.memory_map(path))
        except (pa.ArrowInvalid, OSError):
            return None


def ipc_schema(path: str) -> list[tuple[str, str]]:
    """(name, type) from a file's footer or a stream's first message; nothing for other files."""
    reader = open_ipc(path)
    return [(f.name, of_arrow(f.type)) for f in reader.schema] if reader else []


def _plain(kind: pa.DataType) -> pa.DataType:
    """The nearest type that Spark reads."""
    t = pa.types
    if t.is_dictionary(kind):
        return _plain(kind.value_type)
    if t.is_unsigned_integer(kind):
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[kind.bit_width]
    if t.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if t.is_duration(kind):
        return pa.duration("us")
    if t.is_float16(kind):
        return pa.float32()
    if t.is_time(kind) or t.is_large_string(kind):
        return pa.string()
    if t.is_date64(kind):
        return pa.timestamp("us")
    if t.is_large_binary(kind) or t.is_fixed_size_binary(kind):
        return pa.binary()
    if t.is_list(kind) or t.is_large_list(kind) or t.is_fixed_size_list(kind):
        return pa.list_(_plain(kind.value_type))
    if t.is_struct(kind):
        return pa.struct([pa.field(kind.field(i).name, _plain(kind.field(i).type)) for i in range(kind.num_fields)])
    return kind


class _Part(InputPartition):
    def __init__(self, path: str, batch: int | None):
        self.path, self.batch = path, batch


class _IpcReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: pa.Schema):
        self.paths, self.schema = paths, schema

    def partitions(self):
        """A record batch of a file each; a stream is one."""
        out = []
        for p in self.paths:
            reader = open_ipc(p)
            n = getattr(reader, "num_record_batches", None) if reader else 0
            out += [_Part(p, None)] if n is None else [_Part(p, i) for i in range(n)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        reader = open_ipc(partition.path)
        for batch in reader if partition.batch is None else [reader.get_batch(partition.batch)]:
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if batch.column(f.name).type != f.type else batch.column(f.name) for f in self.schema], schema=self.schema)


class ArrowIpc(DataSource):
    """Spark source `gridlark_ipc`: rows of Arrow files and streams, a task for each record batch."""

    @classmethod
    def name(cls) -> str:
        return "gridlark_ipc"

    def _schema(self) -> pa.Schema:
        files = files_of(self.options["path"], "ipc")
        reader = open_ipc(files[0]) if files else None
        if reader is None:
            raise UnsupportedFormat(self.options["path"])
        return pa.schema([pa.field(f.name, _plain(f.type)) for f in reader.schema])

    def schema(self) -> T.StructType:
        return from_arrow_schema(self._schema(), prefer_timestamp_ntz=True)

    def reader(self, schema) -> DataSourceReader:
        return _IpcReader(files_of(self.options["path"], "ipc"), self._schema())


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowIpc)
    return spark.read.format("gridlark_ipc").option("path", path).load()


def delta_state(spark: SparkSession, path: str) -> tuple[T.StructType, list[str], DataFrame]:
    """A Delta table's schema, partition columns and live files, by replaying its log with Spark."""
    log = f"{path}/_delta_log"
    names = [r["f"] for r in spark.read.format("binaryFile").load(log).select(F.element_at(F.split("path", "/"), -1).alias("f")).collect()]
    versions = sorted(int(n[:20]) for n in names if re.fullmatch(r"\d{20}\.json", n))
    checkpoints: dict[int, list[str]] = {}
    for n in names:
        if m := re.fullmatch(r"(\d{20})\.checkpoint(\..*)?\.parquet", n):
            checkpoints.setdefault(int(m[1]), []).append(f"{log}/{n}")
    base = max(checkpoints, default=-1)
    actions = []
    if base >= 0:
        saved = spark.read.parquet(*checkpoints[base])
        has = lambda field, name: field in saved.columns and name in saved.schema[field].dataType.fieldNames()
        none = {"schema": "string", "by": "array<string>", "mapping": "string", "path": "string", "live": "boolean", "values": "map<string,string>", "marked": "boolean"}
        action = lambda rows, **own: rows.select(F.lit(base).cast("bigint").alias("v"), *[(own[n] if n in own else F.lit(None)).cast(t).alias(n) for n, t in none.items()])
        # tests of leaves, which reach the row groups' null counts
        if "metaData" in saved.columns:
            mapping = F.col("metaData.configuration")["delta.columnMapping.mode"] if has("metaData", "configuration") else F.lit(None)
            actions.append(action(saved.where("metaData.schemaString is not null"), schema=F.col("metaData.schemaString"), by=F.col("metaData.partitionColumns"), mapping=mapping))
        if "add" in saved.columns:
            marked = F.col("add.deletionVector").isNotNull() if has("add", "deletionVector") else F.lit(False)
            actions.append(action(saved.where("add.path is not null"), path=F.col("add.path"), live=F.lit(True), values=F.col("add.partitionValues"), marked=marked))
    later = [v for v in versions if v > base]
    if later:
        kind = "metaData struct<schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>, add struct<path:string,partitionValues:map<string,string>,deletionVector:struct<storageType:string>>, remove struct<path:string>"
        lines = spark.read.schema(kind).json([f"{log}/{v:020d}.json" for v in later])
        v = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint").alias("v")
        live = F.when(F.col("add.path").isNotNull(), True).when(F.col("remove.path").isNotNull(), False)
        actions.append(lines.select(v, F.col("metaData.schemaString").alias("schema"), F.col("metaData.partitionColumns").alias("by"), F.col("metaData.configuration")["delta.columnMapping.mode"].alias("mapping"), F.coalesce("add.path", "remove.path").alias("path"), live.alias("live"), F.col("add.partitionValues").alias("values"), F.col("add.deletionVector").isNotNull().alias("marked")))
    if not actions:
        raise SourceError(f"no Delta log in {path}")
    log_rows = actions[0]
    for a in actions[1:]:
        log_rows = log_rows.unionByName(a)
    newest = log_rows.where("schema is not null").orderBy(F.desc("v")).first()
    if newest is None:
        raise SourceError(f"no schema in the log of {path}")
    if newest["mapping"] not in (None, "none"):
        raise SourceError(f"{path} maps its columns to other names in its files ({newest['mapping']}), which is not read")
    live = log_rows.where("path is not null").groupBy("path").agg(F.max_by(F.struct("live", "values", "marked"), F.struct("v", "live")).alias("s")).where("s.live").select("path", "s.values", "s.marked")
    return T.StructType.fromJson(json.loads(newest["schema"])), list(newest["by"] or []), live


def _full_path(path: Column) -> Column:
    """A file's URL as text: decoded, with one slash after the scheme."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^([a-zA-Z][a-zA-Z0-9+.-]*):/+", "$1:/")


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Delta table's newest version. The live files' names are the one thing that the driver lists, as for any Spark read.

    Paths in the log are URL-encoded. Tables whose rows need more than their files (deletion vectors, column mapping) raise.
    """
    schema, by, live = delta_state(spark, path)
    listed = live.select("path", "marked").collect()
    if not listed:
        return spark.createDataFrame([], schema)
    if any(r["marked"] for r in listed):
        raise SourceError(f"{path} has deletion vectors, which are not read: some rows of its files are deleted")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    absolute = r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?/"
    place = lambda f: f if re.match(absolute, f) else f"{path}/{f}"
    body = T.StructType([f for f in schema.fields if f.name not in by])
    df = spark.read.schema(body).parquet(*[place(unquote(r["path"])) for r in listed])
    if by:
        scheme = root.split(":")[0]
        full = F.when(F.col("path").rlike(r"^/"), F.concat(F.lit(f"{scheme}:"), "path")).when(F.col("path").rlike(absolute), F.col("path"))
        whole = F.coalesce(_full_path(full), F.concat(F.lit(re.sub(r":/+", ":/", root, count=1) + "/"), _full_path(F.col("path"))))
        parts = live.select(whole.alias("__file"), *[F.col("values")[b].alias(b) for b in by])
        df = df.withColumn("__file", _full_path(F.col("_metadata.file_path"))).join(parts, "__file").drop("__file")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


ICEBERG = {"boolean": "bool", "int": "i32", "long": "i64", "float": "f32", "double": "f64", "string": "str", "uuid": "str", "binary": "binary", "date": "date", "time": "time", "timestamp": "datetime[μs]", "timestamptz": "datetime[μs, UTC]", "timestamp_ns": "datetime[ns]", "timestamptz_ns": "datetime[ns, UTC]"}


def iceberg_type(kind) -> str:
    if isinstance(kind, dict):
        if kind["type"] == "list":
            return f"list[{iceberg_type(kind['element'])}]"
        if kind["type"] == "map":
            return f"struct[{iceberg_type(kind['key'])}, {iceberg_type(kind['value'])}]"
        return f"struct[{len(kind['fields'])}]"
    if m := re.match(r"decimal\((\d+),\s*(\d+)\)", kind):
        return f"decimal[{m[1]},{m[2]}]"
    return "binary" if kind.startswith("fixed") else ICEBERG.get(kind, "")


def iceberg_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata that the version hint names, or the newest."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.metadata.json").load(f"{path}/metadata").select("path").collect()
    version = lambda p: int(m[1]) if (m := re.search(r"/v?(\d+)[^/]*\.metadata\.json$", p)) else -1
    places = sorted((r["path"] for r in rows), key=version)
    try:
        hint = spark.read.text(f"{path}/metadata/version-hint.text").first()
    except Exception:  # noqa: BLE001  no hint is no error
        hint = None
    named = [p for p in places if hint and version(p) == int(hint["value"])]
    if not places:
        raise SourceError(f"no metadata in {path}")
    return json.loads("\n".join(r["value"] for r in spark.read.text((named or places)[-1]).collect()))


def iceberg_schema(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, type) of the current schema."""
    data = iceberg_metadata(spark, path)
    current = next((s for s in data.get("schemas", []) if s.get("schema-id") == data.get("current-schema-id")), None) or data.get("schema") or {"fields": []}
    return [(f["name"], iceberg_type(f["type"])) for f in current["fields"]]


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(path: str, sheet_name: str | int | None = None, sheet_id: int | None = None) -> list[list]:
    """Cells of a sheet: by name, by place (from 0, or as sheet_id from 1), else the first tab."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        tabs = [(s.get("name"), s.get(RELATION)) for s in book.iter(f"{SHEET}sheet")]
        place = sheet_name if isinstance(sheet_name, int) else sheet_id - 1 if sheet_id else None
        chosen = [r for i, (n, r) in enumerate(tabs) if (n == sheet_name if isinstance(sheet_name, str) else i == (place or 0))]
        if not chosen:
            return []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[chosen[0]]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        strings = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for row in ElementTree.fromstring(z.read(part)).iter(f"{SHEET}row"):
            cells: list = []
            for c in row.iter(f"{SHEET}c"):
                letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [None] * (at - 1 - len(cells))
                value, kind = c.find(f"{SHEET}v"), c.get("t")
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{SHEET}t")))
                elif value is None:
                    cells.append(None)
                else:
                    cells.append(strings[int(value.text)] if kind == "s" else value.text)
            out.append(cells)
        return out


def excel_schema(path: str, **options) -> list[str]:
    rows = sheet_rows(path, **options)
    return [c if c else f"column_{i + 1}" for i, c in enumerate(rows[0])] if rows else []


def read_excel(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of a sheet as text; a workbook is one file of bounded size (a sheet has at most 2^20 rows)."""
    names = excel_schema(path, **options)
    rows = [tuple((r + [None] * len(names))[: len(names)]) for r in sheet_rows(path, **options)[1:]]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def literal_type(values: list) -> T.DataType:
    some = [v for v in values if v is not None]
    if not some:
        return T.NullType()
    if all(isinstance(v, bool) for v in some):
        return T.BooleanType()
    if all(isinstance(v, int) for v in some):
        return T.LongType()
    if all(isinstance(v, (int, float)) for v in some):
        return T.DoubleType()
    if all(isinstance(v, str) for v in some):
        return T.StringType()
    return T._infer_type(some[0])


def literal_frame(spark: SparkSession, data: dict[str, list] | list[dict]) -> DataFrame:
    """A frame from columns, or from rows whose keys are united in the order in which they appear."""
    if isinstance(data, list):
        names = list(dict.fromkeys(k for r in data for k in r))
        data = {n: [r.get(n) for r in data] for n in names}
    kinds = {n: literal_type(v) for n, v in data.items()}
    made = [[float(x) if isinstance(kinds[n], T.DoubleType) and x is not None else x for x in v] for n, v in data.items()]
    return spark.createDataFrame(list(zip(*made)), T.StructType([T.StructField(n, k) for n, k in kinds.items()]))


def from_dict(spark: SparkSession, data: dict[str, list]) -> DataFrame:
    """Columns by name, all equally long."""
    if len({len(v) for v in data.values()}) > 1:
        raise SourceError("columns of different lengths: " + ", ".join(f"{n} {len(v)}" for n, v in data.items()))
    return literal_frame(spark, data)


def from_dicts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return literal_frame(spark, rows)


#: The constructors' public names; the lazy one is the same here.
CONSTRUCTORS = {"DataFrame": literal_frame, "LazyFrame": literal_frame, "from_dict": from_dict, "from_dicts": from_dicts}
