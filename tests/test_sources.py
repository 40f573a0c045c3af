"""Readers over files written here."""

import functools
import http.server
import json
import threading
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridlark.errors import FileMissing, SourceError, UnsupportedFormat, UnsupportedScheme
from gridlark.functions.dtypes import cell_text, duration_text, family, number_text, of_arrow, size_text
from gridlark.operators.rows import frequent_values, page, read_page, series, sorted_page
from gridlark.operators.schema import all_columns, check_columns, nearest, parquet_facts, struct_field
from gridlark.plans.order import ORD
from gridlark.sources import formats, text
from gridlark.sources.paths import files_of, hive_values, kind_of, options, resolve
from gridlark.sources.read import read


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('region,,"name, long"\nEU,1,"a ""q"""\n\nUS,2,"two\nlines"\n')
    df = read(spark, str(f))
    assert df.columns == ["region", "column_2", "name, long"]
    assert [tuple(r) for r in df.orderBy("region").collect()] == [("EU", "1", 'a "q"'), ("US", "2", "two\nlines")]
    g = tmp_path / "b.csv"
    g.write_text("## x\n## y\na||b\n1||2.5\n3||\n")
    df = read(spark, str(g), sep="||", comment="##", infer_types=True)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double"} and df.count() == 2
    h = tmp_path / "c.csv"
    h.write_text("1;x\n2;y\n")
    assert read(spark, str(h), delimiter=";", header=None, names=["n"]).columns == ["n", "column_2"]


def test_inference():
    assert [text.infer(v) for v in (["1", "2"], ["1", "2.5"], ["true", "False"], ["2026-01-01"], ["2026-01-01T10:00"], ["x", "1"], ["", " "])] == ["i64", "f64", "bool", "date", "datetime[μs]", "str", ""]


def test_json(spark, tmp_path):
    rows = [{"z": 1, "a": None, "m": 1}, {"z": 2, "a": None, "m": 1.5, "late": 3}]
    lines, array = tmp_path / "a.ndjson", tmp_path / "b.json"
    lines.write_text("\n".join(map(json.dumps, rows)))
    array.write_text(json.dumps(rows))
    for f in (lines, array):
        assert text.json_schema(f.read_text()) == [("z", "i64"), ("a", ""), ("m", "f64"), ("late", "i64")]
        df = read(spark, str(f))
        assert df.columns[0] == "z" and df.columns.index("m") < df.columns.index("late") and df.count() == 2
    assert text.objects('[{"a": 1}, {"a": ') == [{"a": 1}]


def test_ipc(spark, tmp_path):
    t = pa.table({"u": pa.array([1, 2], pa.uint32()), "d": pa.array(["x", "y"]).dictionary_encode(), "l": [[1], []]})
    for name, make in (("f.arrow", pa.ipc.new_file), ("s.arrow", pa.ipc.new_stream)):
        with make(str(tmp_path / name), t.schema) as w:
            w.write_table(t)
        assert formats.ipc_schema(str(tmp_path / name)) == [("u", "u32"), ("d", "cat"), ("l", "list[i64]")]
        assert sorted(tuple(r) for r in read(spark, str(tmp_path / name)).select("u", "d").collect()) == [(1, "x"), (2, "y")]
    (tmp_path / "bad.arrow").write_bytes(b"nothing")
    assert formats.ipc_schema(str(tmp_path / "bad.arrow")) == []


def test_delta(spark, tmp_path):
    table = tmp_path / "t"
    (table / "_delta_log").mkdir(parents=True)
    for name, vals in (("a", [1, 2]), ("b", [3])):
        pq.write_table(pa.table({"v": vals}), table / f"{name}.parquet")
    schema = json.dumps({"type": "struct", "fields": [{"name": "v", "type": "long", "nullable": True, "metadata": {}}]})
    log = lambda n, *acts: (table / "_delta_log" / f"{n:020d}.json").write_text("\n".join(map(json.dumps, acts)))
    log(0, {"metaData": {"schemaString": schema, "partitionColumns": []}}, {"add": {"path": "a.parquet", "partitionValues": {}}})
    log(1, {"add": {"path": "b.parquet", "partitionValues": {}}}, {"remove": {"path": "a.parquet"}})
    assert kind_of(str(table)) == "delta" and [r.v for r in read(spark, str(table)).collect()] == [3]


def test_iceberg(spark, tmp_path):
    meta = tmp_path / "ice" / "metadata"
    meta.mkdir(parents=True)
    schema = {"schema-id": 1, "fields": [{"name": "p", "type": "decimal(18, 2)"}, {"name": "l", "type": {"type": "list", "element": "string"}}, {"name": "t", "type": "timestamptz"}]}
    (meta / "v1.metadata.json").write_text(json.dumps({"current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": []}]}))
    (meta / "v2.metadata.json").write_text(json.dumps({"current-schema-id": 1, "schemas": [{"schema-id": 0, "fields": []}, schema]}))
    want = [("p", "decimal[18,2]"), ("l", "list[str]"), ("t", "datetime[μs, UTC]")]
    assert formats.iceberg_schema(spark, str(tmp_path / "ice")) == want
    (meta / "version-hint.text").write_text("1")
    assert formats.iceberg_schema(spark, str(tmp_path / "ice")) == []


def test_excel(spark, tmp_path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    f = tmp_path / "b.xlsx"
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r2"/><sheet name="T" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Q1 &amp; Q2</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="inlineStr"><is><t>other</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>z</t></is></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>')
    assert formats.excel_schema(str(f)) == ["Q1 & Q2", "column_2", "z"] and formats.excel_schema(str(f), sheet_name="T") == ["other"] and formats.excel_schema(str(f), sheet_id=2) == ["other"] and formats.excel_schema(str(f), sheet_name="no") == []
    assert read(spark, str(f)).first()[0] == "5"


def test_literal(spark):
    df = formats.literal_frame(spark, [{"a": 1, "b": 2}, {"a": 2.5, "c": None}])
    assert [t for _, t in text.schema_of(df)] == ["f64", "i64", "null"]


def test_paths(spark, tmp_path):
    for r in ("US", "EU", "__HIVE_DEFAULT_PARTITION__"):
        (tmp_path / "h" / f"region={r}").mkdir(parents=True)
        pq.write_table(pa.table({"v": [1]}), tmp_path / "h" / f"region={r}" / "p.parquet")
    assert hive_values(str(tmp_path / "h"), "region") == ["EU", "US"] and hive_values(str(tmp_path / "h"), "region", 1) == []
    assert len(files_of(str(tmp_path / "h"), "parquet")) == 3 and dict(read(spark, str(tmp_path / "h")).dtypes)["region"] == "string"
    assert read(spark, str(tmp_path / "h"), first_file=True).count() == 1
    with pytest.raises(FileMissing):
        resolve("no/such.csv", [str(tmp_path)])
    with pytest.raises(UnsupportedScheme):
        resolve("s3://b/x.parquet")
    (tmp_path / "x.bin").write_bytes(b"")
    with pytest.raises(UnsupportedFormat):
        read(spark, str(tmp_path / "x.bin"))
    assert options({"sep": ";", "header": None}) == {"separator": ";", "has_header": False}


def test_facts_and_pages(spark, tmp_path):
    f = str(tmp_path / "v.parquet")
    pq.write_table(pa.table({"k": [f"o{i:03d}" for i in range(200)], "r": ["a"] * 120 + ["b"] * 79 + [""], "v": [None, *map(float, range(199))]}), f, row_group_size=64)
    facts = parquet_facts(f)
    assert facts.rows == 200 and facts.row_groups == 4 and facts.codecs == "snappy" and facts.stats["v"] == (1, 0.0, 198.0)
    df = spark.read.parquet(f)
    p = read_page(df, 100, 3, ["k", "zz", "v"])
    assert p.columns == ["k", "v"] and p.cells[0] == ["o100", "99"] and p.more
    assert read_page(df, 0, 2, ["v"], sort="v", desc=True).cells == [["198"], ["197"]]
    assert [tuple(r) for r in frequent_values(df, "r").collect()] == [("a", 120), ("b", 79)] and frequent_values(df, "k").count() == 0 and frequent_values(df, "v").count() == 0


def test_text_forms():
    assert [number_text(x) for x in (5.0, 2.5, float("nan"), 10**20)] == ["5", "2.5", "NaN", str(10**20)]
    assert duration_text(90_061_000_000) == "1d 1h" and duration_text(0) == "0s" and size_text(1536) == "1.5 KB"
    assert cell_text(None) is None and cell_text(b"x") == "…" and cell_text("a" * 61) == "a" * 60 + "…" and cell_text([1, "é"]) == '[1, "é"]'
    assert of_arrow(pa.timestamp("us", "UTC")) == "datetime[μs, UTC]" and of_arrow(pa.list_(pa.float64(), 2)) == "array[f64, 2]" and family("u8") == "number" and family("bool") == "category"


def test_names(spark):
    assert nearest("REGION", ["region", "regional", "x"]) == ["region", "regional"] and nearest("zzzz", ["region"]) == []
    df = spark.createDataFrame([(1, (2, "x"))], "a int, s struct<b:int,c:string>")
    assert struct_field(df.schema, "s.c").simpleString() == "string" and struct_field(df.schema, "s.z") is None and all_columns([df])["s"] == "struct[2]"
    check_columns(df, ["a"])


def test_pages_of_text_sources(spark, tmp_path):
    rows = [(i, f"n{i}") for i in range(300)]
    (tmp_path / "csv").mkdir()
    for k in range(3):
        (tmp_path / f"csv/{k}.csv").write_text("a,b\n" + "".join(f"{i},{b}\n" for i, b in rows[k * 100 : k * 100 + 100]))
    (tmp_path / "one.ndjson").write_text("".join(json.dumps({"a": i, "b": b}) + "\n" for i, b in rows))
    with pa.ipc.new_file(tmp_path / "one.arrow", pa.schema([("a", pa.int64()), ("b", pa.string())])) as out:
        for k in range(0, 300, 50):
            out.write_batch(pa.RecordBatch.from_pydict({"a": [i for i, _ in rows[k : k + 50]], "b": [b for _, b in rows[k : k + 50]]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")  # several pieces a file
    try:
        for path in ("csv", "one.ndjson", "one.arrow"):
            df = read(spark, str(tmp_path / path))
            assert sorted(r.b for r in page(df, 95, 10).collect()) == sorted(b for _, b in rows[95:105])
            p = read_page(df, 298, 10)
            assert [c[-1] for c in p.cells] == ["n298", "n299"] and not p.more
            assert [r.b for r in sorted_page(df, "a", True, 0, 2).collect()] == ["n299", "n298"]
            assert series(df, ["b", "no", "a"], 3).orderBy(ORD).drop(ORD).collect() == [(b, str(i) if path == "csv" else i) for i, b in rows[:3]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        page(df.groupBy("a").count())


def delta_table(tmp_path, adds, name="t", mapping=None):
    root = tmp_path / name
    (root / "_delta_log").mkdir(parents=True)
    schema = json.dumps({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("v", "long"), ("p", "string"))]})
    lines = [{"metaData": {"schemaString": schema, "partitionColumns": ["p"], "configuration": {"delta.columnMapping.mode": mapping} if mapping else {}}}]
    for folder, written, value, p, extra in adds:
        (root / folder).mkdir(exist_ok=True)
        pq.write_table(pa.table({"v": [value]}), root / folder / "part-0.parquet")
        lines.append({"add": {"path": f"{written}/part-0.parquet", "partitionValues": {"p": p}, **extra}})
    (root / "_delta_log" / f"{0:020d}.json").write_text("\n".join(map(json.dumps, lines)))
    return str(root)


def test_delta_partitions_with_equal_file_names(spark, tmp_path):
    path = delta_table(tmp_path, [("p=a", "p=a", 1, "a", {}), ("p=b c+d", "p=b%20c+d", 2, "b c+d", {})], "some table")
    assert sorted(map(tuple, read(spark, path).collect())) == [(1, "a"), (2, "b c+d")]


def test_delta_rows_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(SourceError, match="deletion vectors"):
        read(spark, delta_table(tmp_path, [("p=a", "p=a", 1, "a", {"deletionVector": {"storageType": "u"}})]))
    with pytest.raises(SourceError, match="maps its columns"):
        read(spark, delta_table(tmp_path, [("p=a", "p=a", 1, "a", {})], "m", "name"))


def test_cells_that_do_not_fit(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n" + "1\n" * 60 + "oops\n")
    with pytest.raises(Exception, match="oops"):
        read(spark, str(tmp_path / "x.csv"), infer_types=True).collect()
    assert read(spark, str(tmp_path / "x.csv"), infer_types=True, ignore_errors=True).where("a is null").count() == 1


def test_web_files_go_to_the_shared_folder(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/x.csv").write_text("a\n1\n2\n")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "web")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x.csv"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    try:
        if shared:
            assert read(spark, url, allow_http=True).count() == 2
        else:
            with pytest.raises(SourceError, match="spark.checkpoint.dir"):
                read(spark, url, allow_http=True)
        with pytest.raises(UnsupportedScheme):
            read(spark, url)
    finally:
        server.shutdown()


def test_constructors(spark):
    rows = [(1, "a"), (2, None)]
    assert [tuple(r) for r in formats.CONSTRUCTORS["from_dict"](spark, {"x": [1, 2], "y": ["a", None]}).collect()] == rows
    assert [tuple(r) for r in formats.CONSTRUCTORS["from_dicts"](spark, [{"x": 1, "y": "a"}, {"x": 2}]).collect()] == rows
    with pytest.raises(SourceError):
        formats.from_dict(spark, {"x": [1], "y": []})
