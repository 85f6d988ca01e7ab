"""A Python data source over a store's exported JSON chunks: one partition per chunk, pruned by pushed filters.

Register with ``register(spark)``, read with
``spark.read.format("chunked_json").schema(...).option("manifest", ...).load(folder)``. Paths must be readable by the
executors' Python, so this is for shared file systems.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessera.operators.index import prune
from tessera.plans.model import Manifest, physical_kind
from tessera.runtime import ship

_OPS = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


class ChunkedJsonReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.folder = schema, options["path"]
        with open(options["manifest"], encoding="utf-8") as f:
            self.manifest = Manifest.from_json(f.read())
        self.ids = list(range(self.manifest.n_chunks))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {f.name: physical_kind(f.dataType) for f in self.schema.fields}
        for f in filters:
            if type(f) in _OPS and len(f.attribute) == 1 and not self.manifest.lists:
                keep = prune(self.manifest, {f.attribute[0]: {_OPS[type(f)]: list(f.value) if isinstance(f, In) else f.value}}, kinds)
                self.ids = [i for i in self.ids if i in set(keep)]
            yield f  # Spark filters the rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in self.ids] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        folder = os.path.join(self.folder, f"chunk_id={partition.value}")
        names = self.schema.names
        for name in sorted(os.listdir(folder)):
            if name.startswith("part-"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    for record in json.load(f):
                        yield tuple(record.get(n) for n in names)


class ChunkedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunked_json"

    def reader(self, schema) -> DataSourceReader:
        return ChunkedJsonReader(schema, self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedJson)
