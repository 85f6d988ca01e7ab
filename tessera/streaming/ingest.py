"""Incremental builds: new input files are appended to a store as further chunks.

A file stream with the availableNow trigger hands each batch to ``append`` with its number; the stream's
checkpoint remembers which files are done, and the manifest which batch of which stream is in. A batch that is
run again, after a failure at whatever point, is in the store once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions.predicate import column
from tessera.operators import profile
from tessera.plans.model import FieldStats, Manifest, merge_types
from tessera.sources import loader
from tessera.sources.store import Store, add_chunks, build, write_text


def append(store_path: str, batch: DataFrame, stream: str = "", epoch: int | None = None) -> Manifest:
    """Add the batch's records to an existing store, by its own settings.

    ``epoch`` numbers the batches of a ``stream``: one that is not above the last one that the manifest names
    changes nothing. Values are cast to the store's types.
    """
    spark = batch.sparkSession
    manifest = Store(spark, store_path).manifest
    if epoch is not None and manifest.epochs.get(stream, -1) >= epoch:
        return manifest
    types = {f.name: f.dataType for f in manifest.spark_schema.fields}
    rows = loader.with_ordinal(batch.select(*[column(f.name).cast(types[f.name]).alias(f.name) for f in manifest.schema.fields]))
    _widen(manifest, add_chunks(manifest, rows, store_path))
    if epoch is not None:
        manifest.epochs[stream] = epoch
    write_text(spark, f"{store_path}/manifest.json", manifest.to_json())
    return manifest


def _widen(manifest: Manifest, added: DataFrame) -> None:
    """Types, nullability and bounds of the fields with those of the added rows."""
    rows, stats = profile.field_stats(added.select(*[column(f.name) for f in manifest.schema.fields]), samples=False)
    if not rows:
        return
    for f in manifest.schema.fields:
        kind, more = stats[f.name]
        f.type, f.nullable = merge_types(f.type, kind), f.nullable or more.null_count > 0
        f.stats.min, f.stats.max = _bounds(f.stats, more)


def _bounds(one: FieldStats, two: FieldStats) -> tuple:
    order = lambda v: v.encode("utf-8") if isinstance(v, str) else (v != v, v)
    least, most = ([v for v in pair if v is not None] for pair in ((one.min, two.min), (one.max, two.max)))
    return min(least, key=order, default=None), max(most, key=order, default=None)


def ingest(spark: SparkSession, source: str, fmt: str, schema: T.StructType, store_path: str, checkpoint: str, **settings) -> None:
    """Bring a store up to date with the files under ``source``; the first batch builds it."""

    def batch(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        if loader.exists(spark, f"{store_path}/manifest.json"):
            append(store_path, df, checkpoint, epoch)
        else:
            build(df, store_path, epochs={checkpoint: epoch}, **settings)

    files = spark.readStream.format("json" if fmt == "ndjson" else fmt).schema(schema)
    query = files.load(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
