"""Registered queries over sources, schemas, and the verbs and expressions that `catalog` has no query for.

Files to read are written from the tables first, into the folder that all machines share.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.catalog import frame, query, tab
from gridlark.functions import dtypes
from gridlark.functions import expr as e
from gridlark.functions import selectors as cs
from gridlark.operators import chart as charts
from gridlark.operators import rows as pages
from gridlark.operators import schema as schemas
from gridlark.plans.frame import Frame, concat
from gridlark.plans.order import ORD
from gridlark.plans.sql import run_sql
from gridlark.sources import formats, paths, text
from gridlark.sources.read import read

c = e.col


def folder(spark: SparkSession) -> str:
    """A new local path inside the shared folder, or a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    place = os.path.join(unquote(urlparse(shared).path) if shared else tempfile.gettempdir(), "gridlark", f"source-{uuid.uuid4().hex}")
    os.makedirs(os.path.dirname(place), exist_ok=True)
    return place


def facts(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def values(rows: list[tuple], *columns: str) -> str:
    """SQL for some rows."""
    shown = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


def told(name: str, make, rows: list[tuple], columns: str) -> None:
    """A query whose rows the driver works out, such as a schema."""
    query(name, values(rows, *[x.split()[0] for x in columns.split(", ")]))(lambda s, d: facts(s, make(s, d), columns))


# sources


def _csv(s: SparkSession, d: str, **options) -> str:
    place = folder(s)
    tab(s, d, "customer").write.options(header=True, **options).csv(place)
    return place


query("source_csv_typed", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")(lambda s, d: read(s, _csv(s, d), "csv", infer_types=True))
query("source_csv_text", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")(lambda s, d: read(s, _csv(s, d, sep="|"), "csv", delimiter="|").drop("c_acctbal"))
query("source_csv_aggregate", "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS keys FROM customer GROUP BY 1")(
    lambda s, d: Frame(read(s, _csv(s, d), "csv", infer_types=True)).group_by("c_mktsegment").agg(n=e.len_(), keys=c("c_nationkey").sum()).df
)


def _two_characters(s: SparkSession, d: str) -> DataFrame:
    place = folder(s) + ".csv"
    rows = tab(s, d, "nation").orderBy("n_nationkey").collect()
    with open(place, "w") as out:
        out.write("// a comment\nn_nationkey::n_name::n_regionkey\n" + "".join(f'{r.n_nationkey}::"{r.n_name}"::{r.n_regionkey}\n' for r in rows))
    return read(s, place, sep="::", comment="//", infer_types=True)


query("source_csv_separator", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")(_two_characters)
told("source_csv_schema", lambda s, d: text.csv_schema('a,,"b, c",d,e\n1,x,2.5,true,2024-01-02\n2,,3,false,2024-01-03\n', True), [("a", "i64"), ("column_2", "str"), ("b, c", "f64"), ("d", "bool"), ("e", "date")], "name string, kind string")
told("source_csv_inference", lambda s, d: [(k, text.infer(v)) for k, v in (("whole", ["1", "-2"]), ("real", ["1", "2.5"]), ("truth", ["true", "false"]), ("day", ["2024-01-01"]), ("time", ["2024-01-01 10:00:00"]), ("text", ["1", "x"]), ("blank", ["", ""]))],
     [("whole", "i64"), ("real", "f64"), ("truth", "bool"), ("day", "date"), ("time", "datetime[μs]"), ("text", "str"), ("blank", "")], "name string, kind string")
told("source_csv_prefix", lambda s, d: [(n, k) for n, k in text.csv_schema("a,b\n1,2\n3,xx", True, complete=False)], [("a", "i64"), ("b", "i64")], "name string, kind string")


def _json(s: SparkSession, d: str) -> str:
    place = folder(s)
    tab(s, d, "nation").write.json(place)
    return place


query("source_json", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")(lambda s, d: read(s, _json(s, d), "json"))
told("source_json_schema", lambda s, d: text.json_schema('{"a": 1, "b": null}\n{"a": 2.5, "c": [1], "b": "x"}\n{"d": true'), [("a", "f64"), ("b", "str"), ("c", "list[i64]")], "name string, kind string")


def _ipc(s: SparkSession, d: str) -> str:
    place, rows = folder(s) + ".arrow", tab(s, d, "supplier").toArrow()
    with pa.ipc.new_file(place, rows.schema) as out:
        for batch in rows.to_batches(max_chunksize=64):
            out.write_batch(batch)
    return place


query("source_ipc", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(lambda s, d: read(s, _ipc(s, d)))
query("source_ipc_page", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 40 OFFSET 50")(lambda s, d: pages.page(read(s, _ipc(s, d)), 50, 40, ["s_suppkey", "s_name"]).drop(ORD))
told("source_ipc_schema", lambda s, d: formats.ipc_schema(_ipc(s, d)), [("s_suppkey", "i64"), ("s_name", "str"), ("s_nationkey", "i32"), ("s_acctbal", "f64")], "name string, kind string")


def _delta(s: SparkSession, d: str, checkpoint: bool = False) -> str:
    """Orders by status; the log adds all files, then one of them again as removed."""
    place = folder(s)
    orders = tab(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").parquet(place)
    files = sorted(os.path.relpath(os.path.join(at, f), place) for at, _, names in os.walk(place) for f in names if f.endswith(".parquet"))
    schema = json.dumps({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("o_orderkey", "long"), ("o_totalprice", "double"), ("o_orderstatus", "string"))]})
    meta = {"metaData": {"schemaString": schema, "partitionColumns": ["o_orderstatus"]}}
    adds = [{"add": {"path": f, "partitionValues": {"o_orderstatus": f.split("/")[0].split("=")[1]}}} for f in files]
    gone = [{"remove": {"path": a["add"]["path"]}} for a in adds if "=P/" in a["add"]["path"]]
    os.makedirs(f"{place}/_delta_log")
    lines = lambda v, rows: open(f"{place}/_delta_log/{v:020d}.json", "w").write("\n".join(map(json.dumps, rows)))  # noqa: E731, SIM115
    if checkpoint:
        kind = "metaData struct<schemaString:string,partitionColumns:array<string>>, add struct<path:string,partitionValues:map<string,string>>"
        rows = [(tuple(meta["metaData"].values()), None), *[(None, tuple(a["add"].values())) for a in adds]]
        s.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{place}-checkpoint")
        (part,) = [f for f in os.listdir(f"{place}-checkpoint") if f.endswith(".parquet")]
        os.rename(f"{place}-checkpoint/{part}", f"{place}/_delta_log/{0:020d}.checkpoint.parquet")
    else:
        lines(0, [meta, *adds])
    lines(1, gone)
    return place


_DELTA = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'"
query("source_delta", _DELTA)(lambda s, d: read(s, _delta(s, d)))
query("source_delta_checkpoint", _DELTA)(lambda s, d: read(s, _delta(s, d, True)))
told("source_delta_schema", lambda s, d: text.schema_of(read(s, _delta(s, d))), [("o_orderkey", "i64"), ("o_totalprice", "f64"), ("o_orderstatus", "str")], "name string, kind string")


def _iceberg(s: SparkSession, d: str) -> list[tuple[str, str]]:
    place = folder(s)
    os.makedirs(f"{place}/metadata")
    fields = [{"id": i, "name": n, "type": t} for i, (n, t) in enumerate((("region", "string"), ("price", "decimal(18, 2)"), ("at", "timestamptz"), ("tags", {"type": "list", "element": "string"})))]
    with open(f"{place}/metadata/v2.metadata.json", "w") as out:
        json.dump({"current-schema-id": 1, "schemas": [{"schema-id": 0, "fields": fields[:1]}, {"schema-id": 1, "fields": fields}]}, out)
    with open(f"{place}/metadata/version-hint.text", "w") as out:
        out.write("2")
    return formats.iceberg_schema(s, place)


told("source_iceberg_schema", _iceberg, [("region", "str"), ("price", "decimal[18,2]"), ("at", "datetime[μs, UTC]"), ("tags", "list[str]")], "name string, kind string")


def _workbook(s: SparkSession, d: str) -> str:
    place = folder(s) + ".xlsx"
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [("r_regionkey", "r_name"), *[tuple(r) for r in tab(s, d, "region").orderBy("r_regionkey").collect()]]
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(place, "w") as out:
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Regions" sheetId="1" r:id="rId1"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        out.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    return place


query("source_excel", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")(lambda s, d: read(s, _workbook(s, d), sheet_name="Regions"))
query("source_literal", values([(1, "a", 1.0), (2, None, 2.5)], "i", "t", "x"))(lambda s, d: formats.CONSTRUCTORS["DataFrame"](s, {"i": [1, 2], "t": ["a", None], "x": [1, 2.5]}))
query("source_literal_rows", values([(1, "a"), (2, None), (None, "b")], "i", "t"))(lambda s, d: formats.from_dicts(s, [{"i": 1, "t": "a"}, {"i": 2}, {"t": "b"}]))
query("values_literal", values([("a", 3), ("b", 2)], "value", "n"))(lambda s, d: pages.frequent_values(formats.literal_frame(s, {"t": ["b", "a", "a", "", None, "b", "a"]}), "t"))
query("values_of_numbers", values([("", 0)], "value", "n") + " WHERE false")(lambda s, d: pages.frequent_values(tab(s, d, "orders"), "o_custkey"))


def _hive(s: SparkSession, d: str) -> str:
    place = folder(s)
    tab(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(place)
    return place


query("source_hive", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")(lambda s, d: read(s, _hive(s, d)))
query("values_hive", "SELECT DISTINCT o_orderstatus AS value FROM orders")(lambda s, d: facts(s, [(v,) for v in paths.hive_values(_hive(s, d), "o_orderstatus")], "value string"))
query("source_glob", "SELECT n_name FROM nation")(lambda s, d: read(s, _json(s, d) + "/part-*.json").select("n_name"))
told("source_kinds", lambda s, d: [(n, paths.kind_of(n)) for n in ("a.pq", "b.TSV", "c.feather", "d.jsonl", "e.xlsm", "f.bin")], [("a.pq", "parquet"), ("b.TSV", "csv"), ("c.feather", "ipc"), ("d.jsonl", "json"), ("e.xlsm", "excel"), ("f.bin", None)], "name string, kind string")
told("source_readers", lambda s, d: sorted(paths.READERS.items()), sorted([(f"{p}_parquet", "parquet") for p in ("read", "scan")] + [("parquet_scan", "parquet"), ("read_csv", "csv"), ("scan_csv", "csv"), ("read_csv_auto", "csv"), ("read_csv_batched", "csv"), ("read_table", "csv"), ("read_json", "json"), ("read_json_auto", "json"), ("read_ndjson", "json"), ("scan_ndjson", "json"), ("read_ipc", "ipc"), ("scan_ipc", "ipc"), ("read_feather", "ipc"), ("read_ipc_stream", "ipc"), ("read_delta", "delta"), ("scan_delta", "delta"), ("delta_scan", "delta"), ("scan_iceberg", "iceberg"), ("iceberg_scan", "iceberg"), ("read_excel", "excel")]), "name string, kind string")
told("source_options", lambda s, d: sorted((k, str(v)) for k, v in paths.options({"sep": ";", "skiprows": 2, "comment": "#", "header": None}).items()), [("comment_prefix", "#"), ("has_header", "False"), ("separator", ";"), ("skip_rows", "2")], "name string, given string")


def _refused(s: SparkSession, d: str) -> list[tuple[str, str]]:
    out = []
    for place in ("s3://bucket/a.parquet", "gs://bucket/a.csv", "https://host/a.csv", "nowhere.parquet"):
        try:
            paths.resolve(place)
        except Exception as x:  # noqa: BLE001
            out.append((place, type(x).__name__))
    return out


told("source_refused", _refused, [("s3://bucket/a.parquet", "UnsupportedScheme"), ("gs://bucket/a.csv", "UnsupportedScheme"), ("https://host/a.csv", "UnsupportedScheme"), ("nowhere.parquet", "FileMissing")], "place string, error string")


def _roots(s: SparkSession, d: str) -> list[tuple[str, str]]:
    one, two = folder(s), folder(s)
    for at, files in ((one, ("a.csv",)), (two, ("a.csv", "b.csv"))):
        os.makedirs(at)
        for f in files:
            open(f"{at}/{f}", "w").close()
    named = {one: "first", two: "second"}
    return [(f, named[os.path.dirname(paths.resolve(f, (one, two)))]) for f in ("a.csv", "b.csv")] + [("list", ",".join(os.path.basename(p) for p in paths.list_data_paths(two)))]


told("source_roots", _roots, [("a.csv", "first"), ("b.csv", "second"), ("list", "a.csv,b.csv")], "name string, found string")


def _codecs(s: SparkSession, d: str) -> DataFrame:
    parts = []
    for codec in ("snappy", "uncompressed", "zstd", "gzip"):
        place = folder(s)
        tab(s, d, "region").write.option("compression", codec).parquet(place)
        parts.append(read(s, place, "parquet").select(F.lit(codec).alias("codec"), "r_name"))
    return concat([Frame(p) for p in parts]).df


query("source_codecs", "SELECT codec, r_name FROM region, (VALUES ('snappy'), ('uncompressed'), ('zstd'), ('gzip')) AS t(codec)")(_codecs)

# schemas and facts

_LINE = [("l_orderkey", "i64"), ("l_partkey", "i64"), ("l_suppkey", "i64"), ("l_linenumber", "i32"), ("l_quantity", "f64"), ("l_extendedprice", "f64"), ("l_discount", "f64"), ("l_tax", "f64"), ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "datetime[μs]")]
told("schema_parquet", lambda s, d: frame(s, d, "lineitem").schema, _LINE, "name string, kind string")
told("schema_shortened", lambda s, d: [(r.place, r["column"]) for r in schemas.schema_frame(s, frame(s, d, "lineitem").schema[:3]).collect()], [(0, "l_orderkey"), (1, "l_partkey"), (2, "l_suppkey")], "place long, name string")


def _footer(s: SparkSession, d: str) -> DataFrame:
    place = folder(s)
    tab(s, d, "orders").coalesce(1).write.parquet(place)
    (file,) = [f for f in os.listdir(place) if f.endswith(".parquet")]
    f = schemas.parquet_facts(f"{place}/{file}")
    return facts(s, [(f.rows, len(f.columns), f.codecs, f.stats["o_orderkey"][0], f.stats["o_orderkey"][1], f.stats["o_orderkey"][2])], "n long, width long, codecs string, nulls long, low long, high long")


query("schema_footer", "SELECT count(*) AS n, CAST(6 AS BIGINT) AS width, 'snappy' AS codecs, count(*) FILTER (o_orderkey IS NULL) AS nulls, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")(_footer)
query("schema_details", "SELECT 'c_custkey' AS name, CAST(min(c_custkey) AS VARCHAR) AS low, CAST(max(c_custkey) AS VARCHAR) AS high FROM customer")(lambda s, d: facts(s, [(r["column"], r["min"], r["max"]) for r in schemas.details(tab(s, d, "customer").select("c_custkey"))], "name string, low string, high string"))
told("schema_struct_field", lambda s, d: [(p, str(schemas.struct_field(s.createDataFrame([], "a struct<b struct<c int>, d string>").schema, p))) for p in ("a.b.c", "a.d", "a.x", "a.d.e")], [("a.b.c", "IntegerType()"), ("a.d", "StringType()"), ("a.x", "None"), ("a.d.e", "None")], "path string, kind string")
told("schema_union", lambda s, d: list(schemas.all_columns([tab(s, d, "region"), tab(s, d, "nation").withColumn("r_name", F.lit(1))]).items()), [("r_regionkey", "i32"), ("r_name", "str"), ("n_nationkey", "i32"), ("n_name", "str"), ("n_regionkey", "i32")], "name string, kind string")


def _unknown(s: SparkSession, d: str) -> list[tuple[str, str]]:
    try:
        schemas.check_columns(tab(s, d, "customer"), ["c_custkey", "c_acctbl"])
    except Exception as x:  # noqa: BLE001
        return [(type(x).__name__, ",".join(x.suggestions))]
    return []


told("schema_unknown_column", _unknown, [("UnknownColumn", "c_acctbal")], "error string, near string")

# pages and cells

query("rows_csv_page", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer ORDER BY customer.c_custkey LIMIT 30 OFFSET 100")(lambda s, d: pages.page(read(s, _csv(s, d), "csv"), 100, 30, ["c_custkey", "c_name"]).drop(ORD))
query("rows_csv_sorted", "SELECT c_name, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer ORDER BY customer.c_custkey DESC LIMIT 25")(lambda s, d: pages.sorted_page(read(s, _csv(s, d), "csv"), "c_custkey", True, 0, 25, ["c_name", "c_custkey"]).drop("place"))
query("rows_json_page", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3")(lambda s, d: pages.page(read(s, _json(s, d), "json"), 3, 5, ["n_name"]).drop(ORD))
query("rows_series", "SELECT o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 700")(lambda s, d: pages.series(tab(s, d, "orders"), ["o_totalprice", "missing", "o_orderstatus"], 700).drop(ORD))
query("rows_columns", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 10")(lambda s, d: pages.page(tab(s, d, "customer"), -5, 10, pages.filter_names(tab(s, d, "customer").columns, "C_")[:1] + ["c_acctbal"]).drop(ORD))
query("rows_cells", "SELECT c_name AS name, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END AS bal FROM customer ORDER BY c_custkey LIMIT 50")(lambda s, d: facts(s, [tuple(r) for r in pages.read_page(tab(s, d, "customer"), 0, 50, ["c_name", "c_acctbal"]).cells], "name string, bal string"))
told("rows_more", lambda s, d: [(n, pages.read_page(tab(s, d, "region"), a, n).more) for a, n in ((0, 3), (2, 4))], [(3, True), (4, False)], "size long, more boolean")
told("rows_sort_cycle", lambda s, d: [(x or "none", pages.next_sort(x) or "none") for x in (None, "asc", "desc")], [("none", "asc"), ("asc", "desc"), ("desc", "none")], "now string, next string")
told("cells_text", lambda s, d: [(k, dtypes.cell_text(v, t)) for k, v, t in (("real", 5.0, "f64"), ("small", 1e-7, "f64"), ("null", None, "str"), ("bytes", b"x", "binary"), ("truth", True, "bool"), ("long", "y" * 70, "str"), ("list", [1, None], "list[i64]"))],
     [("real", "5"), ("small", "1e-7"), ("null", None), ("bytes", "…"), ("truth", "true"), ("long", "y" * 60 + "…"), ("list", "[1, null]")], "name string, shown string")
told("cells_duration", lambda s, d: [(n, dtypes.duration_text(n)) for n in (0, 1500, 90_000_000, -93_600_000_000, 86_461_000_000)], [(0, "0s"), (1500, "1ms 500μs"), (90_000_000, "1m 30s"), (-93_600_000_000, "-1d 2h"), (86_461_000_000, "1d 1m")], "micros long, shown string")
told("cells_size", lambda s, d: [(n, dtypes.size_text(n)) for n in (512, 1536, 5 << 20, 3 << 40)], [(512, "512 B"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 40, "3.0 TB")], "size long, shown string")

# charts

told("chart_kinds", lambda s, d: [(x, y or "", ",".join(charts.kinds_for(x, y))) for x, y in (("number", None), ("category", None), ("temporal", "number"), ("number", "number"), ("category", "number"))], [("number", "", "histogram,bar"), ("category", "", "bar"), ("temporal", "number", "line,scatter,bar"), ("number", "number", "scatter,line,bar"), ("category", "number", "bar")], "x string, y string, kinds string")
told("chart_default_axis", lambda s, d: [(t, charts.default_axis(frame(s, d, t).schema)) for t in ("customer", "region", "documents")], [("customer", "c_custkey"), ("region", "r_regionkey"), ("documents", "doc_id")], "source string, axis string")
told("chart_ticks", lambda s, d: [(i, v) for i, v in enumerate(charts.ticks(0, 12345.678))], [(0, 0.0), (1, 3086.0), (2, 6173.0), (3, 9259.0), (4, 12350.0)], "place long, tick double")
told("chart_bin_edges", lambda s, d: [(i, charts.bin_edges("date", 0, 15 * 86_400_000.0)[i]) for i in (0, 1, 30)], [(0, "1970-01-01 00:00:00"), (1, "1970-01-01 12:00:00"), (30, "1970-01-16 00:00:00")], "place long, edge string")
query("chart_untyped_numbers", "SELECT n, count(*) AS bins FROM (SELECT least(29, CAST(floor((v - a) / w) AS BIGINT)) AS b, count(*) AS n FROM (SELECT c_acctbal AS v, min(c_acctbal) OVER () AS a, (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) / 30 AS w FROM customer) GROUP BY 1) GROUP BY 1")(
    lambda s, d: charts.chart(read(s, _csv(s, d), "csv"), charts.ChartRequest(x="c_acctbal", untyped=True)).points.where("n > 0").groupBy("n").agg(F.count("*").alias("bins"))
)
query("chart_split_ignored", "SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: charts.chart(tab(s, d, "orders"), charts.ChartRequest(x="o_orderstatus", split="o_orderstatus")).points.select("label", "n"))
told("chart_notes", lambda s, d: [(n,) for n in charts.chart(tab(s, d, "orders").selectExpr("CAST(o_orderkey % 40 AS STRING) AS k"), charts.ChartRequest(x="k")).notes], [("k has 40 distinct values; the 24 with the most rows are drawn.",)], "note string")
told("chart_reasons", lambda s, d: [(x, charts.chart(tab(s, d, "embeddings"), charts.ChartRequest(x=x)).empty) for x in ("nope", "embedding")], [("nope", "There is no column nope."), ("embedding", "embedding is nested and cannot be drawn.")], "x string, reason string")
told("chart_durations", lambda s, d: [(str(a), charts.chart(tab(s, d, "region").selectExpr("r_name", "make_dt_interval(0, 0, r_regionkey) AS span"), charts.ChartRequest(x="r_name", y="span", agg=a)).duration) for a in ("sum", "count")], [("sum", True), ("count", False)], "agg string, duration boolean")

# frames

query("assign_columns", "SELECT r_regionkey, r_name, r_regionkey * 2 AS twice FROM region")(lambda s, d: frame(s, d, "region").assign(twice=c("r_regionkey") * 2).df)
query("get_column", "SELECT n_name FROM nation")(lambda s, d: frame(s, d, "nation").drop_in_place("n_name")[0].get_column("n_name").df)
query("drop_in_place", "SELECT n_nationkey, n_regionkey FROM nation")(lambda s, d: frame(s, d, "nation").drop_in_place("n_name")[1].df)
query("identity_verbs", "SELECT r_regionkey, r_name FROM region")(lambda s, d: frame(s, d, "region").lazy().collect().clone().rechunk().copy().set_sorted().to_df().cache().transform(lambda f: f).df)
query("set_index_stack", "SELECT p_partkey, variable, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR variable IN (p_size, p_retailprice))")(
    lambda s, d: frame(s, d, "part").select("p_partkey", "p_retailprice", c("p_size").cast("f64")).set_index("p_partkey").stack().reset_index().df
)
query("unstack_index", "SELECT l_returnflag, max(CASE WHEN l_linestatus = 'F' THEN n END) AS \"F\", max(CASE WHEN l_linestatus = 'O' THEN n END) AS \"O\" FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: frame(s, d, "lineitem").group_by("l_returnflag", "l_linestatus").agg(n=e.len_()).set_index(["l_returnflag", "l_linestatus"]).unstack().reset_index().df
)
query("fill_nan_vals", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE value END::DOUBLE AS value FROM events")(lambda s, d: Frame(tab(s, d, "events").selectExpr("event_id", "CASE WHEN event_id % 4 = 0 THEN double('NaN') ELSE value END AS value")).fill_nan(0.5).df)
query("drop_nans_rows", "SELECT event_id FROM events WHERE event_id % 4 <> 0")(lambda s, d: Frame(tab(s, d, "events").selectExpr("event_id", "CASE WHEN event_id % 4 = 0 THEN double('NaN') ELSE value END AS value")).drop_nans(["value"]).select("event_id").df)
query("vstack_rows", "SELECT r_name FROM region UNION ALL SELECT r_name FROM region")(lambda s, d: frame(s, d, "region").vstack(frame(s, d, "region")).select("r_name").df)
query("sample_all", "SELECT o_orderkey FROM orders")(lambda s, d: frame(s, d, "orders").sample(1.0).select("o_orderkey").df)
query("head_tail", "(SELECT p_partkey FROM part ORDER BY 1 LIMIT 7) UNION ALL (SELECT p_partkey FROM part ORDER BY 1 DESC LIMIT 3)")(lambda s, d: concat([frame(s, d, "part", "p_partkey").head(7).select("p_partkey"), frame(s, d, "part", "p_partkey").tail(3).select("p_partkey")]).df)
query("join_computed_keys", "SELECT a.r_name AS r_name, b.r_name AS r_name_right FROM region a JOIN region b ON a.r_regionkey + 1 = b.r_regionkey")(lambda s, d: frame(s, d, "region").join(frame(s, d, "region"), left_on=c("r_regionkey") + 1, right_on="r_regionkey").select("r_name", "r_name_right").df)
query("join_other_names", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda s, d: frame(s, d, "nation").merge(frame(s, d, "region"), left_on="n_regionkey", right_on="r_regionkey").select("n_name", "r_name").df)
for _how, _f in (("sum", "sum({})"), ("mean", "avg({})"), ("min", "min({})"), ("max", "max({})"), ("std", "stddev_samp({})"), ("var", "var_samp({})")):
    query(f"reduce_{_how}", "SELECT " + ", ".join(f"round(CAST({_f.format(x)} AS DOUBLE), 3) AS {x}" for x in ("l_quantity", "l_extendedprice")) + " FROM lineitem")(
        lambda s, d, how=_how: Frame(getattr(frame(s, d, "lineitem").select("l_quantity", "l_extendedprice"), how)().df.select(*[F.round(F.col(x).cast("double"), 3).alias(x) for x in ("l_quantity", "l_extendedprice")])).df
    )
query("reduce_product", "SELECT CAST(round(product(n_nationkey + 1.0)) AS DOUBLE) AS k FROM nation WHERE n_nationkey < 9")(lambda s, d: frame(s, d, "nation").filter(c("n_nationkey") < 9).select(k=c("n_nationkey") + 1.0).product().round().df)
query("reduce_quantile", "SELECT quantile_cont(l_extendedprice, 0.9) AS l_extendedprice FROM lineitem")(lambda s, d: frame(s, d, "lineitem").select("l_extendedprice").quantile(0.9).df)

# windows without partitions, and the other expressions

_ORDER = "OVER (ORDER BY event_id{})"
_SPARSE = "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events"


def _sparse(s: SparkSession, d: str) -> Frame:
    return Frame(tab(s, d, "events").selectExpr("event_id", "user_id", "CASE WHEN event_id % 3 = 0 THEN value END AS v"), ("event_id",))


query("window_backward_fill", f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM ({_SPARSE})")(lambda s, d: _sparse(s, d).select("event_id", f=c("v").backward_fill().over("user_id")).df)
query("whole_fills", f"SELECT event_id, last_value(v IGNORE NULLS) {_ORDER.format('')} AS up, first_value(v IGNORE NULLS) {_ORDER.format(' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS down FROM ({_SPARSE})")(lambda s, d: _sparse(s, d).select("event_id", up=c("v").forward_fill(), down=c("v").backward_fill()).df)
query("whole_running", f"SELECT event_id, count(v) {_ORDER.format(' ROWS UNBOUNDED PRECEDING')} AS n, CASE WHEN v IS NOT NULL THEN min(v) {_ORDER.format(' ROWS UNBOUNDED PRECEDING')} END AS low, CASE WHEN v IS NOT NULL THEN max(v) {_ORDER.format(' ROWS UNBOUNDED PRECEDING')} END AS high FROM ({_SPARSE})")(
    lambda s, d: _sparse(s, d).select("event_id", n=c("v").cum_count(), low=c("v").cum_min(), high=c("v").cum_max()).df
)
query("whole_shift", f"SELECT event_id, lag(value, 3) {_ORDER.format('')} AS was, round(value - lag(value) {_ORDER.format('')}, 6) AS diff FROM events")(lambda s, d: frame(s, d, "events", "event_id").select("event_id", was=c("value").shift(3), diff=c("value").diff().round(6)).df)
query("whole_rank", "SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM events")(lambda s, d: frame(s, d, "events", "event_id").select("event_id", r=c("value").rank()).df)
query("asof_whole", "SELECT a.o_orderkey, b.event_id FROM orders a ASOF LEFT JOIN (SELECT ts, max(event_id) AS event_id FROM events GROUP BY 1) b ON a.o_orderdate >= b.ts")(
    lambda s, d: frame(s, d, "orders").select("o_orderkey", "o_orderdate").join_asof(Frame(tab(s, d, "events").groupBy("ts").agg(F.max("event_id").alias("event_id"))), left_on="o_orderdate", right_on="ts").select("o_orderkey", "event_id").df
)
query("rolling_whole", "SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events")(lambda s, d: frame(s, d, "events").rolling("ts", "1h", n=F.count("*")).select("event_id", "n").df)
query("expr_fills", f"SELECT event_id, coalesce(v, -1.0::DOUBLE) AS v FROM ({_SPARSE})")(lambda s, d: _sparse(s, d).select("event_id", c("v").fill_null(-1.0)).df)
query("expr_heads", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:2], ',') AS first_two, array_to_string(list(o_orderkey ORDER BY o_orderkey)[-2:], ',') AS last_two FROM orders GROUP BY 1")(
    lambda s, d: frame(s, d, "orders", "o_orderkey").group_by("o_custkey").agg(first_two=c("o_orderkey").head(2), last_two=c("o_orderkey").tail(2)).df.select("o_custkey", F.array_join("first_two", ",").alias("first_two"), F.array_join("last_two", ",").alias("last_two"))
)
query("expr_unique", "SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines FROM lineitem GROUP BY 1")(lambda s, d: frame(s, d, "lineitem").group_by("l_returnflag").agg(lines=c("l_linenumber").unique()).df.select("l_returnflag", F.array_join("lines", ",").alias("lines")))
query("expr_drop_nulls", f"SELECT user_id, count(v) AS n FROM ({_SPARSE}) GROUP BY 1")(lambda s, d: _sparse(s, d).group_by("user_id").agg(n=c("v").drop_nulls()).df.select("user_id", F.size("n").cast("bigint").alias("n")))
query("expr_sorted", "SELECT o_orderstatus, array_to_string(list(o_orderkey ORDER BY o_totalprice, o_orderkey), ',') AS keys FROM orders GROUP BY 1")(lambda s, d: frame(s, d, "orders").group_by("o_orderstatus").agg(keys=c("o_orderkey").sort_by("o_totalprice")).df.select("o_orderstatus", F.array_join("keys", ",").alias("keys")))
query("expr_patterns", "SELECT p_partkey, regexp_matches(p_name, 'a.e') AS near, contains(p_name, 'a.e') AS exactly, regexp_matches(p_name, 'red|blue') AS any_of FROM part")(lambda s, d: frame(s, d, "part").select("p_partkey", near=c("p_name").str.contains("a.e"), exactly=c("p_name").str.contains("a.e", literal=True), any_of=c("p_name").str.contains_any(["red", "blue"])).df)
query("selectors_affixes", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")(lambda s, d: frame(s, d, "orders").select(cs.starts_with("x", "o_orderp") | cs.ends_with("key")).df)
query("selectors_parts", "SELECT o_orderstatus, o_totalprice, o_orderdate FROM orders")(lambda s, d: frame(s, d, "orders").select(cs.matches("^o_(tot|orderd)") | cs.contains("stat")).df)
query("selectors_all", "SELECT r_regionkey, r_name FROM region")(lambda s, d: frame(s, d, "region").select(cs.all_()).df)
query("selectors_types", "SELECT o_orderstatus, o_orderdate, o_orderpriority FROM orders")(lambda s, d: frame(s, d, "orders").select(cs.by_dtype("str", "datetime[μs]")).df)
query("sql_sets", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")(
    lambda s, d: run_sql(s, "SELECT c_nationkey AS k FROM cust UNION SELECT s_nationkey FROM supp EXCEPT SELECT n_nationkey FROM nat WHERE n_regionkey = 1", {"cust": tab(s, d, "customer"), "supp": tab(s, d, "supplier"), "nat": tab(s, d, "nation")}).df
)
query("sql_quiet_text", "SELECT r_name, 'FROM ''x.csv''' AS note FROM region")(lambda s, d: run_sql(s, "SELECT r_name, 'FROM \\'x.csv\\'' AS note /* JOIN 'y.csv' */ FROM reg -- FROM 'z.csv'", {"reg": tab(s, d, "region")}).df)
