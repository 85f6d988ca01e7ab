"""Size literals, number text, row sizes, and how reports show values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.predicate import column

UNITS = {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}


def parse_size(text: str) -> int:
    """Bytes of a literal such as ``5mb``; a bare number is bytes."""
    if not (m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*(b|kb|mb|gb)?", text, re.IGNORECASE)):
        raise ValueError(f"bad size {text!r}: a number and b, kb, mb or gb is wanted")
    return int(float(m[1]) * UNITS[(m[2] or "b").lower()])


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def shorten(value: object, most: int = 30) -> str:
    text = str(value)
    return text if len(text) <= most else text[: most - 3] + "..."


def value_text(c: Column, kind: T.DataType) -> Column:
    """The text of a value, as index keys and sizes use it: numbers without zeros after the point that say nothing."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, T.DecimalType) and kind.scale > 0:
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return c.cast("string")


def python_text(value: object) -> str:
    """What ``value_text`` gives for a Python value that is no number."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def row_json(df: DataFrame) -> Column:
    """A row's JSON with nulls, in column order."""
    return F.to_json(F.struct(*[column(c) for c in df.columns]), {"ignoreNullFields": "false"})


def row_size(df: DataFrame) -> Column:
    """Length of a row's JSON in UTF-16 units, whole numbers written without ``.0``."""
    size = utf16_length(row_json(df))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = column(f.name)
            size = size + F.coalesce(F.length(value_text(c, f.dataType)) - F.length(c.cast("string")), F.lit(0))
    return size


def streaming_row_size(df: DataFrame) -> Column:
    """A quick estimate: 2, and for each present field its name, 3, and its value's length (nested values: 20)."""
    size = F.lit(2)
    for f in df.schema.fields:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        quotes = 0 if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else 2
        value = F.lit(20) if nested else F.coalesce(utf16_length(value_text(column(f.name), f.dataType)) + quotes, F.lit(4))
        size = size + F.lit(len(f.name) + 3) + value
    return size.cast("bigint")
