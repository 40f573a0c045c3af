"""Where sources lie and what they are."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable
from glob import has_magic
from glob import glob as expand
from pathlib import Path

from gridlark.errors import FileMissing, SourceError, UnsupportedScheme

EXTENSIONS = {
    "parquet": (".parquet", ".pq"), "csv": (".csv", ".tsv", ".txt"), "ipc": (".arrow", ".ipc", ".feather"), "json": (".json", ".ndjson", ".jsonl"), "excel": (".xlsx", ".xlsm"),
}
#: Names of reader functions and the kind that each reads.
READERS = {
    "read_parquet": "parquet", "scan_parquet": "parquet", "parquet_scan": "parquet", "read_csv": "csv", "scan_csv": "csv", "read_csv_auto": "csv", "read_csv_batched": "csv", "read_table": "csv",
    "read_json": "json", "read_json_auto": "json", "read_ndjson": "json", "scan_ndjson": "json", "read_ipc": "ipc", "scan_ipc": "ipc", "read_feather": "ipc", "read_ipc_stream": "ipc",
    "read_delta": "delta", "scan_delta": "delta", "delta_scan": "delta", "scan_iceberg": "iceberg", "iceberg_scan": "iceberg", "read_excel": "excel",
}
ALIASES = {"sep": "separator", "delim": "separator", "delimiter": "separator", "skiprows": "skip_rows", "comment": "comment_prefix", "quotechar": "quote_char", "names": "new_columns"}


def options(given: dict) -> dict:
    """Reader options under one set of names."""
    out = {ALIASES.get(k, k): v for k, v in given.items()}
    if "header" in out and out.pop("header") is None:
        out["has_header"] = False
    return out


def kind_of(path: str) -> str | None:
    """The kind of a file by its extension, or of a table folder by its log."""
    folder = Path(path)
    if (folder / "_delta_log").is_dir():
        return "delta"
    if (folder / "metadata").is_dir():
        return "iceberg"
    return next((k for k, ends in EXTENSIONS.items() if str(path).lower().endswith(ends)), None)


def resolve(path: str, roots: Iterable[str] = (), allow_http: bool = False) -> str:
    """The place of a path: as it is if absolute or a URL, else under the first root that has it."""
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]+)://", path)
    if scheme:
        if scheme[1] in ("http", "https") and allow_http:
            return path
        if scheme[1] in ("file", "hdfs", "viewfs"):
            return path
        raise UnsupportedScheme(path)
    path = os.path.expanduser(path)
    if os.path.isabs(path):
        places = [path]
    else:
        places = [os.path.join(r, path) for r in (*roots, os.getcwd())]
    for place in places:
        if expand(place, recursive=True) if has_magic(place) else os.path.exists(place):
            return place
    raise FileMissing(path)


def fetched(spark, url: str) -> str:
    """A copy of a web file in the folder that all machines share (spark.checkpoint.dir), where tasks can read it in ranges."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise SourceError("spark.checkpoint.dir is not set: a web file is copied to the folder that all machines share")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(f"{shared}/gridlark/web-{uuid.uuid4().hex}/{os.path.basename(url.split('?')[0]) or 'download'}")
    source = jvm.java.net.URI(url).toURL().openStream()
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, to.getFileSystem(conf).create(to), conf, True)
    return to.toString()


def files_of(path: str, kind: str, depth: int = 5) -> list[str]:
    """Files of a kind under a path or glob, in order, files of a folder before those of its subfolders."""
    if has_magic(path):
        return [f for p in sorted(expand(path, recursive=True)) for f in files_of(p, kind, depth)]
    if os.path.isfile(path):
        return [path]
    if depth < 0 or not os.path.isdir(path):
        return []
    names = sorted(n for n in os.listdir(path) if not n.startswith((".", "_")))
    here = [os.path.join(path, n) for n in names if n.lower().endswith(EXTENSIONS.get(kind, ())) and os.path.isfile(os.path.join(path, n))]
    return here + [f for n in names if os.path.isdir(os.path.join(path, n)) for f in files_of(os.path.join(path, n), kind, depth - 1)]


def hive_values(path: str, column: str, most: int = 50, depth: int = 5) -> list[str]:
    """Values of a partition column, from folder names alone; none if there are more than `most`."""
    found: set[str] = set()

    def walk(folder: str, left: int) -> None:
        for name in os.listdir(folder) if left >= 0 else ():
            place = os.path.join(folder, name)
            if os.path.isdir(place):
                key, eq, value = name.partition("=")
                if eq and key == column:
                    found.add(value)
                else:
                    walk(place, left - 1)

    walk(path, depth)
    found.discard("__HIVE_DEFAULT_PARTITION__")
    return sorted(found) if len(found) <= most else []


def list_data_paths(folder: str, prefix: str = "") -> list[str]:
    """Names under a folder that a reader could take: folders, and files of known kinds."""
    names = sorted(n for n in os.listdir(folder) if n.startswith(prefix) and not n.startswith("."))
    return [n + "/" if os.path.isdir(os.path.join(folder, n)) else n for n in names if os.path.isdir(os.path.join(folder, n)) or kind_of(n)]
