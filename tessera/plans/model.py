"""Logical types and the records that describe a dataset: fields, chunks, manifest, build settings."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

NUMBER, STRING, BOOLEAN, DATE, NULL, NESTED = "number", "string", "boolean", "date", "null", "nested"

#: Fixed value: a string field is a date if all its values look like this and are valid.
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:?\d{2})?)?$"

EQUALITY = ("eq", "neq", "in")
RANGES = ("gt", "gte", "lt", "lte")
TEXT = ("contains", "startsWith", "endsWith")

#: Operators that make sense for each logical type, for generated types and messages.
OPERATORS = {NUMBER: (*EQUALITY, *RANGES), STRING: (*EQUALITY, *TEXT), DATE: (*EQUALITY, *TEXT), BOOLEAN: ("eq",), NULL: ("eq",), NESTED: ()}

SORTABLE = (NUMBER, STRING, DATE)


def physical_kind(kind: T.DataType) -> str:
    """The logical type that a column's Spark type allows; strings may turn out to be dates."""
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if isinstance(kind, T.NullType):
        return NULL
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    return NESTED


def merge_types(a: str, b: str) -> str:
    """Null gives way to anything; unequal types become string."""
    return b if a == NULL else a if b in (NULL, a) else STRING


@dataclass
class FieldStats:
    cardinality: int = 0
    null_count: int = 0
    min: Any = None
    max: Any = None
    samples: list = field(default_factory=list)


@dataclass
class Field:
    name: str
    type: str
    nullable: bool = False
    indexed: bool = False
    stats: FieldStats = field(default_factory=FieldStats)


@dataclass
class Schema:
    fields: list[Field]
    primary: str | None = None

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"no field {name!r}; there are {', '.join(f.name for f in self.fields)}")

    @property
    def indexed(self) -> list[str]:
        return [f.name for f in self.fields if f.indexed]


@dataclass
class Chunk:
    id: int
    count: int
    byte_size: int
    ranges: dict[str, tuple[Any, Any]] = field(default_factory=dict)
    file: str = ""  # the file that holds the chunk, below the store's folder


@dataclass
class BuildConfig:
    chunk_size: int = 5 << 20
    chunk_by: str | None = None
    indexed: list[str] = field(default_factory=list)
    cut: str = "before"  # "after" cuts a chunk once it has reached the target, as incremental builds do


class Index(dict):
    """field -> text of a value -> chunks in order."""

    def __init__(self, *args):
        super().__init__(*args)
        self._numbers: dict[str, dict[float, list[int | None]]] = {}

    def numbers(self, name: str) -> dict[float, list[int | None]]:
        """The chunks by number, for a numeric field: numbers have several texts, and are looked up as doubles.

        Values that are equal for any numeric types are equal as doubles, so a lookup finds all their chunks, and
        may find more where whole numbers lie beyond 2^53.
        """
        if name not in self._numbers:
            out: dict[float, set[int | None]] = {}
            for text, ids in self[name].items():
                try:
                    out.setdefault(number_key(float(text)), set()).update(ids)
                except ValueError:
                    pass  # the field holds strings
            self._numbers[name] = {k: in_order(ids) for k, ids in out.items()}
        return self._numbers[name]


def in_order(ids: Iterable[int | None]) -> list[int | None]:
    """Chunks in order, the null one last."""
    return sorted(ids, key=lambda c: (c is None, c or 0))


def number_key(value: Any) -> Any:
    """The number as a double that equals itself: NaN is one value, as it is for Spark."""
    try:
        value = float(value)
    except OverflowError:  # beyond any double
        return float("inf") if value > 0 else float("-inf")
    return "NaN" if value != value else value


@dataclass
class Manifest:
    """What a store holds. Chunks that aren't listed here don't belong to it, whatever files there are.

    Few chunks and their index are listed in the manifest itself; many are listed in tables under ``lists/``, of
    which the manifest has only the names.
    """

    schema: Schema
    chunks: list[Chunk]
    index: dict[str, dict[str, list[int]]]
    total: int
    config: BuildConfig
    physical: str = ""  # the Spark schema of the chunk files, as JSON
    epochs: dict[str, int] = field(default_factory=dict)  # the last batch of each stream that is in
    lists: list[str] = field(default_factory=list)
    listed: int = 0  # chunks in the lists
    version: int = 2

    def to_json(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"), default=_tagged)

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text, object_hook=_untagged)
        fields = [Field(**(f | {"stats": FieldStats(**f["stats"])})) for f in raw["schema"]["fields"]]
        chunks = [Chunk(**(c | {"ranges": {k: tuple(v) for k, v in c["ranges"].items()}})) for c in raw["chunks"]]
        same = {k: raw[k] for k in ("total", "physical", "epochs", "lists", "listed", "version")}
        return Manifest(schema=Schema(fields, raw["schema"]["primary"]), chunks=chunks, index=Index(raw["index"]), config=BuildConfig(**raw["config"]), **same)

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.physical))

    @property
    def n_chunks(self) -> int:
        return self.listed or len(self.chunks)


def _tagged(value: Any) -> dict[str, str]:
    """What JSON has no type for, with its type's name."""
    for kind, name in ((Decimal, "$decimal"), (dt.datetime, "$timestamp"), (dt.date, "$date")):
        if isinstance(value, kind):
            return {name: str(value) if kind is Decimal else value.isoformat()}
    raise TypeError(f"a manifest can't hold {type(value).__name__}")


def _untagged(raw: dict[str, Any]) -> Any:
    if len(raw) == 1:
        (name, text), = raw.items()
        read = {"$decimal": Decimal, "$timestamp": dt.datetime.fromisoformat, "$date": dt.date.fromisoformat}.get(name)
        if read and isinstance(text, str):
            return read(text)
    return raw
