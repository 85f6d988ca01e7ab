"""Typed Python for a schema: item, conditions, field names, and Spark's DDL."""

from __future__ import annotations

import keyword

from tessera.plans.model import BOOLEAN, NULL, NUMBER, OPERATORS, SORTABLE, Field, Schema

PYTHON = {NUMBER: "float", BOOLEAN: "bool", NULL: "None"}
DDL = {NUMBER: "DOUBLE", BOOLEAN: "BOOLEAN"}


def _literal(names: list[str]) -> str:
    return f"Literal[{', '.join(map(repr, names))}]" if names else "str"


def _item_type(f: Field) -> str:
    kind = PYTHON.get(f.type, "str")
    return f"{kind} | None" if f.nullable and kind != "None" else kind


def _condition_type(f: Field) -> str:
    kind = PYTHON.get(f.type, "str")
    return kind if f.type in (BOOLEAN, NULL) else f"{kind} | dict[{_literal(list(OPERATORS[f.type]))}, Any]"


def generate(schema: Schema, item: str = "Item") -> str:
    """A module with ``Item``, ``Where``, ``FieldName`` and ``SortableField``, and a ``Client`` of a store with these types."""
    if not item.isidentifier() or keyword.iskeyword(item):
        raise ValueError(f"{item!r} is no class name")
    rows = lambda kind: "".join(f"    {f.name!r}: {kind(f)!r},\n" for f in schema.fields)
    return (
        '"""Types and client of a dataset; generated."""\n\nfrom __future__ import annotations\n\nfrom typing import Any, Literal, TypedDict\n\nfrom pyspark.sql import DataFrame, SparkSession\n\nfrom tessera.plans.query import Query\nfrom tessera.sources.store import Store\n\n'
        f"{item} = TypedDict({item!r}, {{\n{rows(_item_type)}}})\n\n"
        f"Where = TypedDict('Where', {{\n{rows(_condition_type)}}}, total=False)\n\n"
        f"FieldName = {_literal([f.name for f in schema.fields])}\n"
        f"SortableField = {_literal([f.name for f in schema.fields if f.type in SORTABLE])}\n"
        f"PRIMARY = {schema.primary!r}\nDDL = {ddl(schema)!r}\n\n\n{_client(item)}"
    )


def _client(item: str) -> str:
    return f'''class Client:
    """Queries over the store at ``path``, with the fields' names and types."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def query(self, where: Where | None = None) -> Query:
        return self.store.query({{"where": where}})

    def find(
        self, where: Where | None = None, order_by: SortableField | None = None, direction: Literal["asc", "desc"] = "asc", limit: int | None = None, offset: int | None = None
    ) -> DataFrame:
        sort = {{"field": order_by, "direction": direction}} if order_by else None
        return self.store.query({{"where": where, "orderBy": sort, "limit": limit, "offset": offset}}).execute()

    def first(self, where: Where | None = None) -> {item} | None:
        return self._item(self.query(where).first())

    def get(self, key: Any) -> {item} | None:
        return self._item(self.store.get(key))

    def count(self, where: Where | None = None) -> int:
        return self.store.count(where)

    @staticmethod
    def _item(row: Any) -> Any:
        return row.asDict() if row is not None else None
'''


def ddl(schema: Schema) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {DDL.get(f.type, 'STRING')}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
