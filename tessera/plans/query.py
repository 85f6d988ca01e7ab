"""The fluent query: conditions, one sort field, offset and limit, compiled to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions.predicate import column, compile_where


class Query:
    """``source(where)`` gives the rows to filter, already pruned where that is possible.

    ``order`` names columns that give rows their natural, total order; those that aren't in ``shown``
    stay internal. Nulls come last in either sort direction.
    """

    def __init__(self, source: Callable[[Mapping[str, Any]], DataFrame], shown: list[str], order: list[str], total: Callable[[], int] | None = None, typed_ranges: bool = False):
        self._source, self._shown, self._order, self._total, self._typed = source, shown, order, total, typed_ranges
        self._where: dict[str, Any] = {}
        self._sort: tuple[str, bool] | None = None
        self._limit: int | None = None
        self._offset = 0

    def where(self, conditions: Mapping[str, Any]) -> Query:
        """Adds conditions; a second one on the same field replaces the first."""
        self._where |= conditions
        return self

    def order_by(self, sort: str | Mapping[str, str], direction: str = "asc") -> Query:
        field, direction = (sort, direction) if isinstance(sort, str) else (sort["field"], sort.get("direction", "asc"))
        if field not in self._shown:
            raise ValueError(f"no field {field!r}")
        if direction not in ("asc", "desc"):
            raise ValueError(f"direction is asc or desc, not {direction!r}")
        self._sort = field, direction == "desc"
        return self

    def limit(self, n: int) -> Query:
        self._limit = _whole(n, "limit")
        return self

    def offset(self, n: int) -> Query:
        self._offset = _whole(n, "offset")
        return self

    def _filtered(self) -> DataFrame:
        df = self._source(self._where)
        condition = compile_where(self._where, df.select(*[column(c) for c in self._shown]).schema, self._typed)
        return df if condition is None else df.where(condition)

    def execute(self) -> DataFrame:
        """The result, lazily. Sorting with a limit is Spark's top-k; an offset without a limit sorts everything."""
        df = self._filtered()
        paged = self._limit is not None or self._offset
        if self._sort:
            c = column(self._sort[0])
            df = df.orderBy(c.desc_nulls_last() if self._sort[1] else c.asc_nulls_last(), *[column(o) for o in self._order])
        elif paged and self._order:
            df = df.orderBy(*[column(o).asc_nulls_last() for o in self._order])
        if self._offset:
            df = df.offset(self._offset)
        if self._limit is not None:
            df = df.limit(self._limit)
        return df.select(*[column(c) for c in self._shown])

    def first(self) -> Row | None:
        """The first row of the result, after the offset; a limit is ignored."""
        before, self._limit = self._limit, 1
        try:
            return next(iter(self.execute().take(1)), None)
        finally:
            self._limit = before

    def first_df(self) -> DataFrame:
        """The same as a DataFrame of at most one row."""
        before, self._limit = self._limit, 1
        try:
            return self.execute()
        finally:
            self._limit = before

    def count(self) -> int:
        """Rows that meet the conditions; sort, offset and limit don't count."""
        if not self._where and self._total:
            return self._total()
        return self._filtered().count()

    def count_df(self, name: str = "n") -> DataFrame:
        return self._filtered().agg(F.count("*").alias(name))

    def apply(self, options: Mapping[str, Any] | None) -> Query:
        """Settings given as a mapping: where, orderBy, limit, offset."""
        for key, value in (options or {}).items():
            if value is None:
                continue
            step = {"where": self.where, "orderBy": self.order_by, "order_by": self.order_by, "limit": self.limit, "offset": self.offset}.get(key)
            if step is None:
                raise ValueError(f"no query option {key!r}")
            step(value)
        return self


def _whole(n: int, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{what} is a whole number of 0 or more, not {n!r}")
    return n


class Dataset:
    """Queries over a plain DataFrame, with the same calls as a store."""

    def __init__(self, df: DataFrame, primary: str | None = None, order: list[str] | None = None, typed_ranges: bool = False):
        self.df, self.primary, self.order, self.typed = df, primary, order or [], typed_ranges

    def query(self, options: Mapping[str, Any] | None = None) -> Query:
        return Query(lambda _: self.df, self.df.columns, self.order, typed_ranges=self.typed).apply(options)

    def get(self, key: Any) -> Row | None:
        if self.primary is None:
            raise ValueError("there is no primary field")
        return self.query({"where": {self.primary: key}}).first()

    def count(self, where: Mapping[str, Any] | None = None) -> int:
        return self.query({"where": where}).count()
