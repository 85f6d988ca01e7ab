"""Field conditions compiled to Columns.

A condition is a value (equality) or a mapping of operators to operands; all of them must hold. Values
are compared without coercion: the operand's Python type is checked against the column's type here, so
that Spark never casts one to the other. Nulls and missing keys are the same.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from decimal import Decimal
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.model import BOOLEAN, DATE, EQUALITY, NESTED, NUMBER, RANGES, STRING, TEXT, physical_kind

ALL = (*EQUALITY, *RANGES, *TEXT)


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float, Decimal)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, (dt.date, dt.datetime)):
        return DATE
    raise TypeError(f"a condition can't hold {type(value).__name__}")


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compile_where(where: Mapping[str, Any] | None, schema: T.StructType, typed_ranges: bool = False) -> Column | None:
    """The conjunction of all conditions; None where there is nothing to filter."""
    parts = [p for name, condition in (where or {}).items() for p in _field(name, condition, schema, typed_ranges)]
    return reduce(and_, parts) if parts else None


def _field(name: str, condition: Any, schema: T.StructType, typed_ranges: bool) -> list[Column]:
    if name not in schema.names:
        raise ValueError(f"no field {name!r}")
    kind, c = physical_kind(schema[name].dataType), column(name)
    if kind == NESTED:
        raise TypeError(f"{name!r} is nested; conditions need plain values")
    if not isinstance(condition, Mapping):
        return [_equal(c, kind, condition)]
    return [_operator(c, kind, op, operand, typed_ranges) for op, operand in condition.items()]


def _equal(c: Column, kind: str, value: Any) -> Column:
    if value is None:
        return c.isNull()
    if isinstance(value, (list, tuple, set)):
        raise TypeError("a list is no condition; use {'in': [...]}")
    return c == F.lit(value) if kind_of(value) == kind else F.lit(False)


def _operator(c: Column, kind: str, op: str, operand: Any, typed_ranges: bool) -> Column:
    if op == "eq":
        return _equal(c, kind, operand)
    if op == "neq":
        if operand is None:
            return c.isNotNull()
        return ~c.eqNullSafe(F.lit(operand)) if kind_of(operand) == kind else F.lit(True)
    if op == "in":
        if isinstance(operand, (str, Mapping)) or not hasattr(operand, "__iter__"):
            raise TypeError("'in' takes a list")
        values = list(operand)
        fitting = [v for v in values if v is not None and kind_of(v) == kind]
        hits = ([c.isin(fitting)] if fitting else []) + ([c.isNull()] if None in values else [])
        return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
    if op in RANGES:
        if operand is None or kind_of(operand) not in ((NUMBER, STRING, DATE) if typed_ranges else (NUMBER,)):
            raise TypeError(f"{op!r} takes a number, not {operand!r}")
        if kind != kind_of(operand):
            return F.lit(False)  # ranges match only values of the operand's type
        value = F.lit(operand)
        return {"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]
    if op in TEXT:
        if not isinstance(operand, str):
            raise TypeError(f"{op!r} takes a string, not {operand!r}")
        if kind != STRING:
            return F.lit(False)
        return {"contains": c.contains, "startsWith": c.startswith, "endsWith": c.endswith}[op](operand)
    raise ValueError(f"no operator {op!r}; there are {', '.join(ALL)}")
