"""Stores: Parquet files of many chunks each under ``data/``, and a ``manifest.json``, the commit point.

Every build and every append writes a folder of its own and then replaces the manifest at once. The manifest
names the file of each chunk and the files' schema, so a query opens the files it needs without listing or
probing any others, and files that a failed attempt has left behind are never read. Where there are more than
``INLINE`` chunks, their entries and the index are Parquet tables under ``lists/``, one pair for each build or
append, which the manifest names; they are pruned as tables, so the driver never holds an entry for every chunk.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Mapping
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predicate import column
from tessera.functions.text import parse_size
from tessera.operators import index as ix
from tessera.operators import layout, profile
from tessera.plans.model import NESTED, NUMBER, BuildConfig, Field, FieldStats, Manifest, Schema, physical_kind
from tessera.plans.query import Query
from tessera.sources import loader
from tessera.sources.loader import ORDINAL

POS = "__pos"

#: Up to this many stretches of successive chunks are named in the scan's filter; more are joined, so that plans stay small.
STRETCHES = 200
FILE_BYTES = 256 << 20  # of rows as JSON, about; fewer where that would keep cores idle
INLINE = 10_000  # chunks that a manifest lists itself; more are listed in tables
MEMO = 64  # chunks that a store keeps after reading them one by one


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file with this text, which takes the place of an older one at once."""
    store, at = loader._files(spark, path)
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = store.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), hadoop)
    context.rename(store.makeQualified(part), store.makeQualified(at), options)


def read_text(spark: SparkSession, path: str) -> str:
    if not loader.exists(spark, path):
        raise FileNotFoundError(f"no manifest at {path}")
    return spark.read.text(path, wholetext=True).collect()[0]["value"]


def stripped(schema: Schema) -> Schema:
    """The schema as a manifest keeps it: bounds, but no counts and samples."""
    return Schema([Field(f.name, f.type, f.nullable, f.indexed, FieldStats(0, 0, f.stats.min, f.stats.max)) for f in schema.fields], schema.primary)


def build(
    df: DataFrame, out: str, chunk_size: int | str = "5mb", chunk_by: str | None = None, indexed: list[str] | None = None, order: list[str] | None = None,
    rule: str = "before", cap: int | None = profile.CARDINALITY_CAP, primary: str | None = None, epochs: Mapping[str, int] | None = None,
) -> Manifest:
    """Write ``df`` as a store. Chunk field and index fields are recommended where they aren't given."""
    spark = df.sparkSession
    target = parse_size(chunk_size) if isinstance(chunk_size, str) else chunk_size
    rows = loader.with_ordinal(df)
    total, schema = profile.infer_schema(rows, ORDINAL, order or df.columns, cap, primary, whole=True)
    if not total:
        raise ValueError("the input has no records")
    if chunk_by:
        schema.field(chunk_by)
    chunk_by = chunk_by or profile.suggest_chunk_field(schema, total)
    wanted = indexed if indexed is not None else profile.recommended_indexes(schema)
    for f in schema.fields:
        f.indexed = f.name in wanted
    manifest = Manifest(stripped(schema), [], ix.Index(), 0, BuildConfig(target, chunk_by, schema.indexed, rule), epochs=dict(epochs or {}))
    add_chunks(manifest, rows, out)
    write_text(spark, f"{out}/manifest.json", manifest.to_json())
    return manifest


def add_chunks(manifest: Manifest, rows: DataFrame, out: str) -> DataFrame:
    """Writes numbered rows as further chunks, in a new folder, and enters them in the manifest; the rows as written.

    A file holds successive chunks, its rows in build order. Up to ``INLINE`` chunks the manifest lists them itself,
    beyond that, without gathering them here, in tables.
    """
    spark, folder, config, first = rows.sparkSession, f"data/{uuid.uuid4().hex}", manifest.config, manifest.n_chunks
    placed, n = layout.pack_chunks(rows, config.chunk_size, config.chunk_by, rule=config.cut)
    files = max(-(-n * config.chunk_size // FILE_BYTES), min(n, spark.sparkContext.defaultParallelism), 1)
    by_file = placed.repartitionById(files, F.floor(F.col(layout.CHUNK) * F.lit(files).cast("bigint") / F.lit(max(n, 1))).cast("int"))
    numbered = by_file.withColumn(layout.CHUNK, (F.col(layout.CHUNK) + first).cast("int")).drop(ORDINAL)
    numbered.sortWithinPartitions(layout.CHUNK, POS).write.parquet(f"{out}/{folder}")
    written = spark.read.schema(numbered.schema).parquet(f"{out}/{folder}")
    manifest.physical = manifest.physical or written.schema.json()
    manifest.total += written.count()
    indexed = [f for f in config.indexed if physical_kind(written.schema[f].dataType) != NESTED]
    if not manifest.lists and first + n <= INLINE:
        manifest.chunks += layout.chunk_metadata(written, manifest.schema, F.col(layout.SIZE), config.cut, folder)
        for field, values in _new_index(manifest, written, indexed).items():
            known = manifest.index.setdefault(field, {})
            for value, ids in values.items():
                known[value] = known.get(value, []) + ids
            if len(known) > ix.INDEX_CAP:
                del manifest.index[field]
                _drop_index(manifest, field)
        return written
    numeric = _numeric(manifest)
    if manifest.chunks:
        chunks, index = ix.as_tables(spark, manifest, numeric)
        _write_list(manifest, out, chunks, index)
        manifest.chunks, manifest.index = [], ix.Index()
    fields = layout.range_fields(manifest.schema, written)
    stats = layout.chunk_stats(written, fields, F.col(layout.SIZE), layout.ADDED[config.cut], F.col("_metadata.file_name"))
    index = ix.index_rows(written, indexed, None) if indexed else spark.createDataFrame([], "field string, value string, chunk_ids array<int>")
    _write_list(manifest, out, ix.chunk_table(stats, fields, numeric, folder), ix.index_table(index, numeric))
    manifest.listed = first + n
    listed = Store.tables(spark, out, manifest)[1]
    for r in listed.groupBy("field").agg(F.count_distinct("value").alias("n")).where(F.col("n") > ix.INDEX_CAP).collect():
        _drop_index(manifest, r["field"])
    return written


def _new_index(manifest: Manifest, rows: DataFrame, indexed: list[str]) -> ix.Index:
    """The index of the added rows, without fields that have too many values."""
    found = ix.build_index(rows, manifest.schema, indexed, ix.INDEX_CAP) if indexed else ix.Index()
    if missing := [f for f in indexed if f not in found]:
        present = rows.agg(*[F.count(column(f)).alias(f"n{i}") for i, f in enumerate(missing)]).collect()[0]
        for i, field in enumerate(missing):
            if present[f"n{i}"]:
                manifest.index.pop(field, None)
                _drop_index(manifest, field)
    return found


def _drop_index(manifest: Manifest, field: str) -> None:
    """A field with too many values has no index any more: an index of some chunks would hide the others."""
    manifest.config.indexed = [f for f in manifest.config.indexed if f != field]


def _numeric(manifest: Manifest) -> list[str]:
    return [f.name for f in manifest.spark_schema.fields if physical_kind(f.dataType) == NUMBER and not f.name.startswith("__") and f.name != layout.CHUNK]


def _write_list(manifest: Manifest, out: str, chunks: DataFrame, index: DataFrame) -> None:
    name = uuid.uuid4().hex
    chunks.write.parquet(f"{out}/lists/{name}/chunks")
    index.write.parquet(f"{out}/lists/{name}/index")
    manifest.lists.append(name)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes what the manifest doesn't name: folders of older builds and of failed attempts. Returns their names."""
    store, gone = Store(spark, path), []
    named = {"data": {f.split("/")[1] for f in store.files()}, "lists": set(store.manifest.lists)}
    for kind, names in named.items():
        files, at = loader._files(spark, f"{path}/{kind}")
        found = [f.getPath() for f in files.listStatus(at)] if files.exists(at) else []
        for p in found:
            if p.getName() not in names:
                files.delete(p, True)
                gone.append(p.getName())
    return sorted(gone)


class Store:
    """Queries over a written store; chunks that can't hold matches are not read."""

    def __init__(self, spark: SparkSession, path: str, pruning: bool = True):
        self.spark, self.path, self.pruning = spark, path, pruning
        self._manifest: Manifest | None = None
        self._cached: DataFrame | None = None
        self._memo: OrderedDict[int, DataFrame] = OrderedDict()

    @property
    def manifest(self) -> Manifest:
        if self._manifest is None:
            self._manifest = Manifest.from_json(read_text(self.spark, f"{self.path}/manifest.json"))
        return self._manifest

    @staticmethod
    def tables(spark: SparkSession, path: str, manifest: Manifest) -> tuple[DataFrame, DataFrame]:
        """The chunk table and the index table of a manifest with lists."""
        read = lambda what: spark.read.parquet(*[f"{path}/lists/{name}/{what}" for name in manifest.lists])
        return read("chunks"), read("index")

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: physical_kind(f.dataType) for f in self.manifest.spark_schema.fields}

    @property
    def rows(self) -> DataFrame:
        return self._cached if self._cached is not None else self._read(self.files())

    def files(self) -> list[str]:
        """The files of all chunks."""
        if self.manifest.lists:
            return sorted(r["file"] for r in self._table({}).select("file").distinct().collect())
        return list(dict.fromkeys(c.file for c in self.manifest.chunks))

    def _read(self, files: list[str]) -> DataFrame:
        """These files, with all chunks that they hold."""
        if not files:
            return self.spark.createDataFrame([], self.manifest.spark_schema)
        return self.spark.read.schema(self.manifest.spark_schema).parquet(*[f"{self.path}/{f}" for f in files])

    def chunk(self, chunk_id: int) -> DataFrame:
        """One chunk's records in order. The last ``MEMO`` chunks that were asked for are kept until ``clear_cache``."""
        if chunk_id in self._memo:
            self._memo.move_to_end(chunk_id)
            return self._memo[chunk_id]
        if not 0 <= chunk_id < self.manifest.n_chunks:
            raise KeyError(f"no chunk {chunk_id}")
        if self.manifest.lists:
            rows = self._among(self._table({}).where(F.col("id") == chunk_id))
        else:
            rows = self._only([chunk_id])
        one = rows.orderBy(POS).select(*[column(c) for c in self.columns]).persist()
        self._memo[chunk_id] = one
        if len(self._memo) > MEMO:
            self._memo.popitem(last=False)[1].unpersist()
        return one

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.manifest.schema.fields]

    def candidates(self, where: Mapping[str, Any]) -> list[int]:
        """The chunks to read for these conditions."""
        if self.manifest.lists:
            return sorted(r["id"] for r in self._table(where if self.pruning else {}).select("id").collect())
        return ix.prune(self.manifest, where, self.kinds) if self.pruning else [c.id for c in self.manifest.chunks]

    def _table(self, where: Mapping[str, Any]) -> DataFrame:
        """The entries of the chunks to read, from the lists."""
        return ix.prune_table(*self.tables(self.spark, self.path, self.manifest), where, self.kinds, self.manifest.config.indexed)

    def _scan(self, where: Mapping[str, Any]) -> DataFrame:
        if not self.manifest.lists:
            return self._only(self.candidates(where))
        return self._among(self._table(where)) if self.pruning and where else self.rows

    def _among(self, entries: DataFrame) -> DataFrame:
        """The rows of the chunks with these entries; the driver sees the files' names only."""
        rows = self._cached if self._cached is not None else self._read(sorted(r["file"] for r in entries.select("file").distinct().collect()))
        return rows.join(entries.select(F.col("id").alias(layout.CHUNK)), layout.CHUNK, "left_semi")

    def _only(self, ids: list[int]) -> DataFrame:
        """The rows of these chunks, which the manifest itself lists."""
        wanted = set(ids)
        files = dict.fromkeys(c.file for c in self.manifest.chunks if c.id in wanted)
        rows = self._cached if self._cached is not None else self._read(list(files))
        there = [c.id for c in self.manifest.chunks if self._cached is not None or c.file in files]
        if len(there) == len(wanted):
            return rows
        stretches: list[list[int]] = []
        for i in sorted(wanted):
            if stretches and stretches[-1][1] == i - 1:
                stretches[-1][1] = i
            else:
                stretches.append([i, i])
        if not stretches:
            return rows.where(F.lit(False))
        if len(stretches) <= STRETCHES:
            return rows.where(reduce(or_, [F.col(layout.CHUNK).between(a, b) for a, b in stretches]))
        listed = self.spark.createDataFrame([(i,) for i in ids], f"{layout.CHUNK} int")
        return rows.join(listed, layout.CHUNK, "left_semi")

    def query(self, options: Mapping[str, Any] | None = None, typed_ranges: bool = False) -> Query:
        return Query(self._scan, self.columns, [layout.CHUNK, POS], lambda: self.manifest.total, typed_ranges).apply(options)

    def get(self, key: Any) -> Row | None:
        """The record whose primary field is ``key``."""
        if self.manifest.schema.primary is None:
            raise ValueError("the store has no primary field")
        return self.query({"where": {self.manifest.schema.primary: key}}).first()

    def count(self, where: Mapping[str, Any] | None = None) -> int:
        return self.query({"where": where}).count()

    def get_schema(self) -> Schema:
        return self.manifest.schema

    def cache(self) -> None:
        """Keep all chunks in memory and on disk of the executors until ``clear_cache``."""
        self._cached = self._read(self.files()).persist()

    def clear_cache(self) -> None:
        """Forget cached rows and chunks, and read the manifest anew when it is next needed."""
        self._manifest = None
        while self._memo:
            self._memo.popitem()[1].unpersist()
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None


def export_json(store: Store, out: str) -> None:
    """Each chunk as one JSON array under ``chunk_id=N``. A chunk's size is bounded, so gathering it is."""
    record = F.to_json(F.struct(*[column(c) for c in store.columns]), {"ignoreNullFields": "false"})
    arrays = store.rows.groupBy(layout.CHUNK).agg(F.array_sort(F.collect_list(F.struct(F.col(POS).alias("p"), record.alias("r")))).alias("rs"))
    text = F.concat(F.lit("["), F.array_join(F.transform("rs", lambda x: x["r"]), ","), F.lit("]"))
    arrays.select(layout.CHUNK, text.alias("value")).write.mode("overwrite").partitionBy(layout.CHUNK).text(out)
