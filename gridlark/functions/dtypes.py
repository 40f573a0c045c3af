"""Type names, their families, and text forms of cells."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import types as T

_PLAIN = {
    T.BooleanType: "bool", T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64",
    T.StringType: "str", T.BinaryType: "binary", T.DateType: "date", T.TimestampNTZType: "datetime[μs]", T.TimestampType: "datetime[μs, UTC]", T.DayTimeIntervalType: "duration[μs]", T.NullType: "null",
}


def of_spark(kind: T.DataType) -> str:
    """The name of a Spark type; blank where there is none."""
    if isinstance(kind, T.DecimalType):
        return f"decimal[{kind.precision},{kind.scale}]"
    if isinstance(kind, T.ArrayType):
        return f"list[{of_spark(kind.elementType)}]"
    if isinstance(kind, T.MapType):
        return f"struct[{of_spark(kind.keyType)}, {of_spark(kind.valueType)}]"
    if isinstance(kind, T.StructType):
        return f"struct[{len(kind.fields)}]"
    if type(kind).__name__ == "TimeType":
        return "time"
    return next((name for cls, name in _PLAIN.items() if isinstance(kind, cls)), "")


def of_arrow(kind: pa.DataType) -> str:
    """The name of an Arrow type, which still knows signs, units and categories."""
    t = pa.types
    if t.is_dictionary(kind):
        return "cat" if t.is_string(kind.value_type) or t.is_large_string(kind.value_type) else of_arrow(kind.value_type)
    if t.is_boolean(kind):
        return "bool"
    if t.is_integer(kind):
        return ("i" if t.is_signed_integer(kind) else "u") + str(kind.bit_width)
    if t.is_floating(kind):
        return "f64" if kind.bit_width == 64 else "f32"
    if t.is_decimal(kind):
        return f"decimal[{kind.precision},{kind.scale}]"
    if t.is_string(kind) or t.is_large_string(kind) or str(kind) == "string_view":
        return "str"
    if t.is_binary(kind) or t.is_large_binary(kind) or t.is_fixed_size_binary(kind) or str(kind) == "binary_view":
        return "binary"
    if t.is_date32(kind):
        return "date"
    if t.is_date64(kind):
        return "datetime[ms]"
    if t.is_time(kind):
        return "time"
    if t.is_timestamp(kind):
        unit = kind.unit.replace("us", "μs")
        return f"datetime[{unit}, {kind.tz}]" if kind.tz else f"datetime[{unit}]"
    if t.is_duration(kind):
        return f"duration[{kind.unit.replace('us', 'μs')}]"
    if t.is_fixed_size_list(kind):
        return f"array[{of_arrow(kind.value_type)}, {kind.list_size}]"
    if t.is_list(kind) or t.is_large_list(kind):
        return f"list[{of_arrow(kind.value_type)}]"
    if t.is_struct(kind):
        return f"struct[{kind.num_fields}]"
    if t.is_map(kind):
        return f"struct[{of_arrow(kind.key_type)}, {of_arrow(kind.item_type)}]"
    if t.is_null(kind):
        return "null"
    if t.is_run_end_encoded(kind):
        return of_arrow(kind.value_type)
    return ""


def family(dtype: str) -> str:
    """What a chart makes of a type: number, temporal, category, nested, or blank for an unknown one."""
    if not dtype:
        return ""
    if re.match(r"(list|array|struct|binary|object)", dtype):
        return "nested"
    if re.match(r"(i|u)\d+$|f(32|64)$|decimal|duration", dtype):
        return "number"
    if re.match(r"(date|datetime|timestamp|time)", dtype):
        return "temporal"
    return "category"


def is_calendar(dtype: str) -> bool:
    return bool(re.match(r"(date|datetime|timestamp)", dtype))


def number_text(x: float | int | Decimal) -> str:
    """Shortest form: 5, not 5.0."""
    if isinstance(x, float):
        if math.isnan(x) or math.isinf(x):
            return "NaN" if math.isnan(x) else ("Infinity" if x > 0 else "-Infinity")
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        return re.sub(r"e([+-])0*(\d)", r"e\1\2", repr(x))
    return str(x)


UNITS = (("d", 86_400_000_000), ("h", 3_600_000_000), ("m", 60_000_000), ("s", 1_000_000), ("ms", 1000), ("μs", 1))


def duration_text(micros: int) -> str:
    """The two largest units that are not zero."""
    if not micros:
        return "0s"
    rest, parts = abs(micros), []
    for name, size in UNITS:
        n, rest = divmod(rest, size)
        if n:
            parts.append(f"{n}{name}")
    return ("-" if micros < 0 else "") + " ".join(parts[:2])


def time_text(value: dt.datetime) -> str:
    text = value.strftime("%Y-%m-%d %H:%M:%S")
    return text + (f".{value.microsecond // 1000:03d}" if value.microsecond // 1000 else "")


def cell_text(value, dtype: str = "", most: int | None = 60) -> str | None:
    """The text of a cell, cut at `most` characters; null stays null and bytes show as an ellipsis."""
    if value is None:
        return None
    if isinstance(value, bool):
        text = "true" if value else "false"
    elif isinstance(value, (bytes, bytearray)):
        return "…"
    elif isinstance(value, dt.timedelta):
        text = duration_text(value // dt.timedelta(microseconds=1))
    elif dtype.startswith("duration") and isinstance(value, int):
        scale = {"s": 1_000_000, "ms": 1000, "μs": 1, "ns": 0.001}[dtype[9:-1]]
        text = duration_text(int(value * scale))
    elif isinstance(value, dt.datetime):
        text = time_text(value)
    elif isinstance(value, (dt.date, dt.time)):
        text = value.isoformat()
    elif isinstance(value, (int, float, Decimal)):
        text = number_text(value)
    elif isinstance(value, str):
        text = value
    else:
        text = json.dumps(value, default=lambda x: x.asDict(recursive=True) if isinstance(x, T.Row) else str(x), ensure_ascii=False)
    return text if most is None or len(text) <= most else text[:most] + "…"


def size_text(n: int) -> str:
    """Bytes in powers of 1024, with one decimal."""
    value, units = float(n), ["B", "KB", "MB", "GB", "TB", "PB"]
    while value >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{n} B" if units[0] == "B" else f"{value:.1f} {units[0]}"
