"""Exact dedup against a persistent digest index.

The index is a Spark table, bucketed and sorted by the SHA-256 of the normalised text (the text
without any space character). A batch is first reduced to one winner per digest with partial
aggregation, so a text with a third of all rows leaves each map task as a single row. The winners
then meet the index in a sort-merge anti-join, and those that are new are appended to it.

Defined cases: a null text counts as empty, so null, empty and blank texts are one group. Among
equal texts the row with the most code points wins, then the smallest doc_id (null last), then the
smallest hash of the whole row; rows that are equal in every column are interchangeable and one of
them stays. Texts of any length are digested whole. An empty batch leaves the index as it is. Columns of the batch keep their names and
types; working columns get names that clash with none of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES, cut, documents, fresh, quoted, text_or_empty

#: Buckets of a new index. A cluster with a large index sets more; appends keep the table's count.
BUCKETS = 32

#: A digest counts as hot from this share of the rows on, so at most this many digests are hot.
HOT_DIGESTS = 1000

INDEX_SCHEMA = "digest binary, keep_id bigint, group_size bigint, batch string"


def normalised(text: Column) -> Column:
    """The text without its space characters."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A table ``(digest, keep_id, group_size, batch)``, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS):
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            self._write(spark.createDataFrame([], INDEX_SCHEMA))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def absent(self, df: DataFrame, digest: str) -> DataFrame:
        """The rows of ``df`` whose digest the index doesn't hold, by sort-merge anti-join."""
        name = fresh(df, "known")[0]
        known = self.read().select(F.col("digest").alias(name))
        return df.join(known.hint("merge"), quoted(digest) == F.col(name), "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add ``(digest, keep_id, group_size)`` rows, at most one per digest and all of them new."""
        self._write(
            groups.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")  # a file per bucket, not one per task and bucket
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _order(length: Column, doc_id: Column, row: Column) -> Column:
    """Smallest first: more code points, then smaller doc_id with nulls last, then the row's hash."""
    return F.struct((-length).alias("a"), doc_id.isNull().alias("b"), doc_id.alias("c"), row.alias("d"))


def _row_hash(df: DataFrame) -> Column:
    """A hash of the whole row. Types that can't be hashed, maps above all, count by their JSON."""
    plain = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return F.xxhash64(*[quoted(f.name) if isinstance(f.dataType, plain) else F.to_json(F.struct(quoted(f.name))) for f in df.schema.fields])


def deduplicate(df: DataFrame, index: DigestIndex, text: str = "text", key: str = "doc_id", batch: str | None = None) -> DataFrame:
    """The rows of ``df`` that stay: one per text that the index didn't hold. The index gains them.

    Texts cross the network once, as at most one row per digest and map task.
    """
    best = fresh(df, "best")[0]
    row = _row_hash(df)
    whole = F.struct(*[quoted(c) for c in df.columns])
    value = text_or_empty(text)
    winners = (
        df.select(digest_of(value).alias("digest"), _order(F.length(value), quoted(key), row).alias("o"), whole.alias("row"))
        .groupBy("digest")
        .agg(F.min_by("row", "o").alias(best), F.count("*").alias("group_size"))
    )
    new = cut(index.absent(winners, "digest"))  # read twice: for the index and for the result
    index.append(new.select("digest", F.col(f"{best}.`{key}`").cast("bigint").alias("keep_id"), "group_size"), batch or uuid.uuid4().hex)
    return new.select(*[F.col(best)[c].alias(c) for c in df.columns])


def memberships(df: DataFrame, index: DigestIndex, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``df``: its group's digest, the row that stays, and the group's size.

    The batch goes into the index first. Rows equal in doc_id and text stay once. The lookups of the
    rows go two ways: digests that hold at least one in HOT_DIGESTS of the rows, of which there can be
    no more than HOT_DIGESTS, by broadcast; all others, with bounded groups, by sort-merge join.
    """
    value = text_or_empty(text)
    slim = cut(
        df.select(
            quoted(key).cast("bigint").alias("doc_id"),
            digest_of(value).alias("digest"),
            F.length(value).alias("n"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = cut(
        slim.groupBy("digest")
        .agg(F.min(_order(F.col("n"), F.col("doc_id"), F.col("row"))).alias("o"), F.count("*").alias("group_size"))
        .select("digest", F.col("o.c").alias("keep_id"), F.col("o.d").alias("keep_row"), "group_size")
    )
    batch = uuid.uuid4().hex
    index.append(index.absent(groups, "digest"), batch)
    least = max(2, -(-(slim.count()) // HOT_DIGESTS))
    # A group that an earlier batch brought in keeps that batch's row: no row of this one stays.
    entries = index.read().select("digest", F.col("keep_id").alias("index_id"), "batch")
    known = groups.join(entries.hint("merge"), "digest").select(
        "digest", F.col("index_id").alias("keep_id"), "group_size", F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row")
    )
    hot = F.broadcast(known.where(F.col("group_size") >= least).withColumn("hot", F.lit(True)))
    looked = slim.join(hot, "digest", "left")
    some = looked.where("hot").drop("hot")
    rest = looked.where("hot is null").select(*slim.columns).join(known.where(F.col("group_size") < least).hint("merge"), "digest")
    return some.unionByName(rest.select(*some.columns)).withColumn("kept", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return memberships(documents(spark, sf_dir), index).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
