"""Layout: build order, greedy packing into size-bounded chunks, zone maps.

Packing is a fold over row sizes, but it doesn't need one task. Rows are range-partitioned in build order
and checkpointed. Each partition then tabulates, for every size that the chunk left open by the partitions
before it can have, how large its own last chunk will be and how many chunks it starts: a step function
with few steps, since chains of chunks from different starts soon meet. The driver composes these tables
in order, which gives every partition its true start, and a second pass writes chunk numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.predicate import column
from tessera.functions.text import row_size, streaming_row_size
from tessera.plans.model import DATE, NUMBER, STRING, Chunk, Schema, physical_kind
from tessera.runtime import cut, ship
from tessera.sources.loader import ORDINAL

CHUNK, SIZE = "chunk_id", "__size"
ADDED = {"before": 2, "after": 0}  # bytes of a chunk beside its rows
ROWS_PER_RANGE = 2_000_000  # more ranges than shuffle partitions where they'd hold more rows


def build_key(name: str, kind: T.DataType) -> Column:
    """What the build sorts by, nulls first: numbers as they are, all else by Unicode collation of its text."""
    c = column(name)
    return c if physical_kind(kind) in (NUMBER, DATE) else F.collate(c.cast("string"), "UNICODE")


def build_order(df: DataFrame, chunk_by: str | None, ordinal: str = ORDINAL) -> list[Column]:
    keys = [build_key(chunk_by, df.schema[chunk_by].dataType).asc_nulls_first()] if chunk_by else []
    return [*keys, column(ordinal).asc()]


def with_size(df: DataFrame, ordinal: str = ORDINAL, rule: str = "before") -> DataFrame:
    """``df`` with what a row counts against the target: its JSON and a comma, or the quick estimate."""
    rows = df.select(*[column(c) for c in df.columns if c != ordinal])
    return df.withColumn(SIZE, row_size(rows) + 1 if rule == "before" else streaming_row_size(rows))


class Fold:
    """Greedy packing of one partition's rows, for any size of the chunk that is open before it."""

    def __init__(self, sizes: np.ndarray, target: int, rule: str):
        self.upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.n, self.target, self.rule = len(sizes), target, rule
        at = np.arange(self.n)
        full = self.upto[:-1] + target
        # The row that starts the next chunk after one that starts at each row.
        self.next = np.maximum(at + 1, np.searchsorted(self.upto, full, "right") - 1) if rule == "before" else np.searchsorted(self.upto, full, "left")

    def first(self, open_size: int) -> int:
        """The first row that starts a chunk, or beyond n if none does. At n the open chunk ends with the partition."""
        if not open_size:
            return 0
        side = self.target - open_size  # below 0 after a row larger than the target
        return max(0, int(np.searchsorted(self.upto, side, "right")) - 1) if self.rule == "before" else int(np.searchsorted(self.upto, side, "left"))

    def starts(self, open_size: int) -> list[int]:
        out, i = [], self.first(open_size)
        while i < self.n:
            out.append(i)
            i = int(self.next[i])
        return out

    def left_open(self, open_size: int, starts: list[int]) -> int:
        size = int(self.upto[-1] - self.upto[starts[-1]]) if starts else open_size + int(self.upto[-1])
        return 0 if self.rule == "after" and size >= self.target else size

    def table(self) -> Iterator[tuple[int, int, int, int]]:
        """(least open size, size left open, chunks started, whether the open size adds to it) by rising open size."""
        if not self.n:
            yield 0, 0, 0, 1
            return
        counts, rest = [0] * (self.n + 1), [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            j = int(self.next[i])
            if j < self.n:
                counts[i], rest[i] = counts[j] + 1, rest[j]
            else:
                size = int(self.upto[-1] - self.upto[i])
                counts[i], rest[i] = 1, 0 if self.rule == "after" and size >= self.target else size
        yield 0, rest[0], counts[0], 0
        # An open size moves the first start only where it crosses target - upto[j].
        edges = sorted({1, *(int(self.target - u) + e for u in self.upto[self.upto < self.target] for e in (0, 1) if self.target - u + e >= 1)})
        last = None
        for a in edges:
            i = self.first(a)
            if i < self.n:
                row = rest[i], counts[i], 0
            elif self.rule == "after" and a + self.upto[-1] >= self.target:
                row = 0, 0, 0
            else:
                row = int(self.upto[-1]), 0, 1
            if row != last:
                yield a, *row
                last = row


def assign_chunks(df: DataFrame, target: int, chunk_by: str | None = None, ordinal: str = ORDINAL, rule: str = "before") -> DataFrame:
    """``df`` with ``chunk_id`` and its place in build order, ``__pos``; see ``pack_chunks``."""
    return pack_chunks(df, target, chunk_by, ordinal, rule)[0]


def pack_chunks(df: DataFrame, target: int, chunk_by: str | None = None, ordinal: str = ORDINAL, rule: str = "before") -> tuple[DataFrame, int]:
    """(``df`` with ``chunk_id`` and its place in build order, ``__pos``; how many chunks there are).

    ``before`` closes a chunk before the row that would exceed the target (a larger row has a chunk of its
    own); ``after`` closes it once it has reached the target. Sizes are those of ``with_size``, unless ``df`` has
    them already. Only ordinals and sizes are folded.
    """
    if target < 1 or rule not in ("before", "after"):
        raise ValueError("the target is at least 1 byte, the rule 'before' or 'after'")
    ship(df.sparkSession)
    df = stable(df)
    key = [build_key(chunk_by, df.schema[chunk_by].dataType).alias("__key")] if chunk_by else []
    order = [c.asc_nulls_first() for c in ([F.col("__key")] if chunk_by else []) + [F.col("__at")]]
    sized = df if SIZE in df.columns else with_size(df, ordinal, rule)
    # Sizes are those of rows as JSON: they are taken once, before the ranges are sampled and dealt out.
    slim = cut(sized.select(*key, column(ordinal).alias("__at"), F.col(SIZE)))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // ROWS_PER_RANGE))
    slim = cut(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)).select(F.spark_partition_id().alias("part"), "__at", SIZE)

    def sizes_of(batches: Iterator[pd.DataFrame]) -> tuple[int, np.ndarray, np.ndarray]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return 0, np.array([], np.int64), np.array([], np.int64)
        return int(frames[0]["part"].iloc[0]), np.concatenate([f["__at"].to_numpy() for f in frames]), np.concatenate([f[SIZE].to_numpy() for f in frames])

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, _, sizes = sizes_of(batches)
        if len(sizes):
            yield pd.DataFrame([(part, *row) for row in Fold(sizes, target, rule).table()], columns=["part", "least", "rest", "started", "adds"])

    tables: dict[int, list] = {}
    for r in slim.mapInPandas(tabulate, "part int, least bigint, rest bigint, started bigint, adds int").collect():
        tables.setdefault(r["part"], []).append(r)
    entry, open_size, chunks = {}, 0, 0
    for part in sorted(tables):
        entry[part] = open_size, chunks
        step = max((r for r in tables[part] if r["least"] <= open_size), key=lambda r: r["least"])
        open_size, chunks = step["rest"] + step["adds"] * open_size, chunks + step["started"]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, sizes = sizes_of(batches)
        if not len(sizes):
            return
        started = np.zeros(len(sizes), np.int64)
        started[Fold(sizes, target, rule).starts(entry[part][0])] = 1
        ids = entry[part][1] - 1 + np.cumsum(started)
        for i in range(0, len(at), 10_000):
            some = slice(i, i + 10_000)
            yield pd.DataFrame({"__at": at[some], SIZE: sizes[some], CHUNK: ids[some].astype(np.int32), "__pos": (part << 33) + np.arange(i, i + len(at[some]))})

    placed = slim.mapInPandas(number, f"__at bigint, {SIZE} bigint, {CHUNK} int, __pos bigint")
    return df.drop(SIZE).join(placed, column(ordinal) == F.col("__at")).drop("__at"), chunks


def stable(df: DataFrame) -> DataFrame:
    """``df``, checkpointed unless it only reads files and checkpoints row by row, so that a second reading numbers its rows alike."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    steady = ("Project", "Filter", "FileScan", "Scan", "ColumnarToRow", "BatchScan", "WholeStageCodegen", "AdaptiveSparkPlan", "LocalTableScan", "Range")
    nodes = [re.sub(r"^[\s:+*()\d-]*", "", line) for line in plan.split("\n")]
    return df if all(not n or n.startswith(steady) for n in nodes) else cut(df)


def range_fields(schema: Schema, rows: DataFrame) -> list[str]:
    """The fields whose bounds a chunk's entry has."""
    kinds = (NUMBER, DATE, STRING)
    return [f.name for f in schema.fields if f.type in kinds and physical_kind(rows.schema[f.name].dataType) in kinds]


def chunk_stats(chunked: DataFrame, fields: list[str], size: Column, added: int = 2, file: Column | None = None) -> DataFrame:
    """A row for each chunk: rows, bytes, the least and greatest value of each field in build order, and its file."""
    aggs = [F.count("*").alias("count"), (F.sum(size) + added).alias("byte_size")]
    for i, name in enumerate(fields):
        c, key = column(name), build_key(name, chunked.schema[name].dataType)
        plain = physical_kind(chunked.schema[name].dataType) in (NUMBER, DATE)
        aggs += [F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")] if plain else [F.min_by(c, key).alias(f"min{i}"), F.max_by(c, key).alias(f"max{i}")]
    return chunked.groupBy(CHUNK).agg(*aggs, *([F.min(file).alias("file"), F.max(file).alias("last_file")] if file is not None else []))


def chunk_metadata(chunked: DataFrame, schema: Schema, size: Column, rule: str = "before", folder: str | None = None) -> list[Chunk]:
    """The chunks in order, for the manifest. Fields that are null throughout a chunk have no range there.

    With a ``folder``, ``chunked`` reads files of that name, and each chunk gets the name of its file.
    """
    fields, out = range_fields(schema, chunked), []
    file = F.col("_metadata.file_name") if folder else None
    for r in chunk_stats(chunked, fields, size, ADDED[rule], file).orderBy(CHUNK).collect():
        ranges = {n: (r[f"min{i}"], r[f"max{i}"]) for i, n in enumerate(fields) if r[f"min{i}"] is not None}
        if folder and r["file"] != r["last_file"]:
            raise ValueError(f"chunk {r[CHUNK]} lies in several files")
        out.append(Chunk(r[CHUNK], r["count"], r["byte_size"], ranges, f"{folder}/{r['file']}" if folder else ""))
    return out


def estimate_chunks(size: int, target: int, records: int) -> int:
    return max(1, min(-(-size // target), records))
