"""Loading JSON arrays, newline-delimited JSON, CSV and Parquet."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship

FORMATS = ("json", "ndjson", "csv", "parquet")
ORDINAL = "__ordinal"
PEEK = 1024
_SPACE, _GAP = re.compile(r"\s*"), re.compile(r"[,\s]*")


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of the path, and the path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _files(spark, path)
    return store.exists(at)


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    store, at = _files(spark, path)
    return store.getContentSummary(at).getLength()


def _head(spark: SparkSession, path: str, n: int = PEEK) -> str:
    """The beginning of a file, or of the first file of a folder that isn't empty."""
    store, at = _files(spark, path)
    found = [at] if store.getFileStatus(at).isFile() else sorted((f.getPath() for f in store.listStatus(at) if f.isFile()), key=lambda p: p.getName())
    for one in found:
        if one.getName().startswith(("_", ".")):
            continue
        stream = store.open(one)
        try:
            text = bytes(stream.readNBytes(n)).decode("utf-8", "ignore").lstrip("\ufeff").strip()
        finally:
            stream.close()
        if text:
            return text
    return ""


def detect_format(spark: SparkSession, path: str) -> str:
    """By extension; ``.json`` is an array or one object a line by its first character; anything else is json."""
    name = path.lower().rstrip("/")
    for ending, fmt in ((".ndjson", "ndjson"), (".jsonl", "ndjson"), (".csv", "csv"), (".parquet", "parquet")):
        if name.endswith(ending):
            return fmt
    if name.endswith(".json"):
        return "ndjson" if _head(spark, path).startswith("{") else "json"
    return "json"


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The records of a file or folder. Broken input raises, at the latest when it is read."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no input at {path}")
    fmt = fmt or detect_format(spark, path)
    if fmt == "json":
        if not _head(spark, path).startswith("["):
            raise ValueError(f"{path} doesn't hold a JSON array")
        return spark.read.json(path, multiLine=True, mode="FAILFAST")
    if fmt == "ndjson":
        try:
            return spark.read.json(path, mode="FAILFAST")
        except Exception as error:
            if (bad := first_bad_line(spark, path)) is None:
                raise
            raise ValueError(f"{path}: line {bad[0]} is no JSON object: {bad[1][:80]}") from error
    if fmt == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST")
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}; there are {', '.join(FORMATS)}")


def first_bad_line(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(number, text) of the first line that is neither blank nor a JSON object; lines are counted from 1 over all files."""
    lines = with_ordinal(spark.read.text(path).select("value"))
    bad = lines.where((F.trim("value") != "") & ~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    first = bad.orderBy(ORDINAL).limit(1).collect()
    return (lines.where(F.col(ORDINAL) <= first[0][ORDINAL]).count(), first[0]["value"]) if first else None


def convert_json_array(spark: SparkSession, path: str, out: str, per_file: int = 1_000_000) -> None:
    """JSON arrays rewritten once as lines, ``per_file`` to a file, so that many tasks can read what one file holds.

    Reading an array is one task for each file, but it holds only a piece and one record at a time. Paths must be
    readable by the executors' Python.
    """
    ship(spark)
    store, at = _files(spark, path)
    found = [at] if store.getFileStatus(at).isFile() else [f.getPath() for f in store.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    paths = spark.createDataFrame([(p.toString(),) for p in found], "path string").repartition(max(1, len(found)))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                some: list[str] = []
                for record in array_records(one):
                    some.append(record)
                    if len(some) == 1000:
                        yield pa.RecordBatch.from_pydict({"value": some})
                        some = []
                if some:
                    yield pa.RecordBatch.from_pydict({"value": some})

    paths.mapInArrow(cut_up, "value string").write.mode("overwrite").option("maxRecordsPerFile", per_file).text(out)


def array_records(path: str, piece: int = 1 << 20) -> Iterator[str]:
    """The records of a JSON array, each as a line of JSON, with a piece of the file and one record in memory."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        raw = open(unquote(parts.path) if parts.scheme else path, "rb")  # noqa: SIM115
    else:
        from pyarrow import fs

        files, inner = fs.FileSystem.from_uri(path)
        raw = files.open_input_stream(inner)
    decoder, lines = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")()
    text, at, opened, more, size = "", 0, False, True, piece
    with raw:
        while True:
            at = _GAP.match(text, at).end()
            if not opened and at < len(text):
                if text[at] != "[":
                    raise ValueError(f"{path} doesn't hold a JSON array")
                opened, at = True, at + 1
                continue
            if at < len(text):
                if text[at] == "]":
                    return
                try:
                    record, end = decoder.raw_decode(text, at)
                    at_next = _SPACE.match(text, end).end()
                    after = text[at_next : at_next + 1]
                except ValueError:
                    after = ""
                if after and after in ",]":  # else the record may go on in the next piece
                    yield json.dumps(record, ensure_ascii=False)
                    at, size = end, piece
                    continue
                if not more:
                    raise ValueError(f"{path}: broken JSON at {text[at : at + 80]!r}")
            if not more:
                raise ValueError(f"{path}: the array has no end")
            got = raw.read(size)
            size, more = size * 2, bool(got)  # a long record is tried again after twice as much
            text, at = text[at:] + lines.decode(got, final=not got), 0


def with_ordinal(df: DataFrame, name: str = ORDINAL) -> DataFrame:
    """``df`` with numbers that rise in reading order."""
    return df.withColumn(name, F.monotonically_increasing_id())


def spread(df: DataFrame, least: int = 100_000) -> DataFrame:
    """``df``, dealt out anew where one task would have over twice its share, and over ``least`` rows: a file is read by one task for each of its row groups."""
    n, sizes = df.sparkSession.sparkContext.defaultParallelism, [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return df.repartition(n) if max(sizes, default=0) > max(least, 2 * sum(sizes) / n) else df


def head(df: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` records in reading order."""
    return df.limit(n)


def estimate_rows(spark: SparkSession, path: str, sample: DataFrame, row_bytes) -> int:
    """File size over the mean size of the sampled rows."""
    mean = sample.agg(F.avg(row_bytes)).collect()[0][0]
    return int(file_size(spark, path) / mean) if mean else 0


def field_order(spark: SparkSession, path: str, fmt: str) -> list[str] | None:
    """Names in the order of a JSON input's first record, which Spark's JSON reader sorts away."""
    if fmt not in ("json", "ndjson"):
        return None
    try:
        text = _head(spark, path, 1 << 20)
        return list(json.JSONDecoder().raw_decode(text, text.index("{"))[0])
    except ValueError:
        return None


def write(df: DataFrame, path: str, fmt: str) -> None:
    """One file set of the given format; nulls are written."""
    if fmt == "json":
        raise ValueError("JSON arrays are written by the store's export")
    writer = df.write.mode("overwrite")
    {"ndjson": lambda: writer.json(path, ignoreNullFields=False), "csv": lambda: writer.csv(path, header=True), "parquet": lambda: writer.parquet(path)}[fmt]()
