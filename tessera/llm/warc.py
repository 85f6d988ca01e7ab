"""WARC archives packaged in ZIP files: a writer, and a reader that never extracts.

Writing: each task packages its records into ZIP files of bounded size, with stored members:
``archive/data.warc.gz``, with a gzip member per record, and ``indexes/index.cdxj``, a JSON line per record
with the offset and length of its gzip member. Files get their final name when complete, and a row naming the file counts
only if its task succeeded, so a task that is run again leaves no half-written or doubled archive behind.

Reading: the tail of each file gives the end-of-central-directory record and, where sizes or offsets
don't fit 32 bits, the ZIP64 locator and directory. Central entries (with their ZIP64 fields) and local
headers locate the stored index and archive members; records are then read by byte range. Index entries are
dealt out by package and stretch of ``STRETCH`` archive bytes before their records are read, so one large
package doesn't mean one large task; an index itself is read by one task, piece by piece.

Of pages with equal payloads the one with the smallest page_id is stored as a response; the others become
revisit records that refer to it, without the payload but with its digest and length. Payloads smaller
than ``least`` bytes are always responses.

Folders may be local or shared paths, ``file:`` URIs, or any store that pyarrow's filesystems open.

Defined cases: a null html is an empty payload. Null page_ids sort last, so they are responses only among
themselves. Rows that repeat the response's page_id and payload are responses too. A null url is written
as an empty target; blanks and control characters of a url are percent-encoded, since a header can't hold
them. A payload of any length is one record, held whole by the task that writes or reads it. Other columns
than the three that are named are ignored, whatever their names. An empty table writes no archive and reads as an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, quoted, shared_dir, ship, text_or_empty

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_PAYLOAD = 0
#: Bytes of an archive whose records one task reads together, and of an index read at once.
STRETCH, INDEX_PIECE = 1 << 22, 1 << 20
#: Most records of a package, and the archive bytes at which the next one begins.
PACKAGE_RECORDS, PACKAGE_BYTES = 1 << 16, 1 << 28
#: A digest counts as hot from this share of the pages on, so at most this many digests are hot.
HOT_DIGESTS = 1000
ENTRY_SCHEMA = "path string, base bigint, start bigint, length bigint"
RECORD_SCHEMA = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


# -- files -------------------------------------------------------------------------------------------


def _local(path: str) -> str | None:
    """The plain path, if the store is the file system."""
    parts = urlsplit(path)
    return path if not parts.scheme else unquote(parts.path) if parts.scheme == "file" else None


class RangeFile:
    """Reads byte ranges of one file."""

    def __init__(self, path: str):
        if (local := _local(path)) is not None:
            self.file = open(local, "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            self.file = store.open_input_file(inner)
        self.size = self.file.seek(0, os.SEEK_END)

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError(f"the file ends at {self.size}, before {start + length}")
        return out

    def close(self) -> None:
        self.file.close()


def _write(folder: str, name: str, fill) -> str:
    """A new file of the folder, filled by ``fill(file)``, under its name once complete."""
    if (local := _local(folder)) is not None:
        os.makedirs(local, exist_ok=True)
        whole, part = os.path.join(local, name), os.path.join(local, f".{name}.part")
        with open(part, "wb") as f:
            fill(f)
        os.replace(part, whole)
        return whole
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner)
    with store.open_output_stream(f"{inner}/.{name}.part") as f:
        fill(f)
    store.move(f"{inner}/.{name}.part", f"{inner}/{name}")
    return f"{folder.rstrip('/')}/{name}"


# -- ZIP -----------------------------------------------------------------------------------------------

_END, _END64_AT, _END64, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"


def central_directory(file: RangeFile) -> tuple[int, int, int]:
    """(offset, size, entries) of the central directory."""
    tail_at = max(0, file.size - 22 - 65535)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)  # the signature can also stand inside the comment
    if at < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if end_at >= 20 and (locator := file.read(end_at - 20, 20))[:4] == _END64_AT:
        big = file.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if big[:4] != _END64:
            raise ValueError("not a ZIP file: the ZIP64 locator points elsewhere")
        entries, size, offset = struct.unpack_from("<QQQ", big, 32)
    return offset, size, entries


def members(file: RangeFile) -> dict[str, tuple[int, int]]:
    """(offset of the data, size) of each stored member by name."""
    offset, size, entries = central_directory(file)
    directory, at, out = file.read(offset, size), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("not a ZIP file: broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that don't fit, in this order
                wide, k = extra[4 : 4 + n], 0
                for field in ("plain", "packed", "header"):
                    if {"plain": plain, "packed": packed, "header": header}[field] == 0xFFFFFFFF:
                        value = struct.unpack_from("<Q", wide, k)[0]
                        k += 8
                        plain, packed, header = (value if field == f else old for f, old in (("plain", plain), ("packed", packed), ("header", header)))
            extra = extra[4 + n :]
        at += 46 + name_n + extra_n + comment_n
        if method == 0 and not name.endswith("/"):
            local = file.read(header, 30)
            if local[:4] != _LOCAL:
                raise ValueError(f"not a ZIP file: no local header of {name}")
            out[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return out


# -- WARC ------------------------------------------------------------------------------------------------


_BLANK = re.compile(r"[\s\x00-\x1f\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else ""
    return int(value) if value else None


def record(page_id: int | None, url: str, sha1: bytes, size: int, payload: bytes | None, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; ``sha1`` and ``size`` are those of the full payload, which revisits don't hold."""
    headers = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _BLANK.sub(lambda m: quote(m[0]), url), "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(sha1).decode()}", "WARC-Payload-Length": str(size),
    }
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to)}
    else:
        block += payload
    headers["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of RECORD_SCHEMA. A response's digest and length are taken from its payload, and checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    kind, said, payload = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest(payload) != said:
            raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
    return {
        "page_id": _page(headers["warc-record-id"]), "url": headers["warc-target-uri"], "record_type": kind, "payload_digest": said,
        "payload_bytes": int(headers["warc-payload-length"]) if payload is None else len(payload), "refers_to": _page(headers.get("warc-refers-to")), "payload": payload,
    }


# -- DataFrames ------------------------------------------------------------------------------------------


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """``page_id, url, sha1, payload_bytes, payload, first_id, revisit``: which record each page becomes; revisits have no payload.

    First pages are found with partial aggregation on the payload's digest, and only digests of several pages
    are looked up. Those that hold at least one in HOT_DIGESTS of the pages, of which there can be no more than
    HOT_DIGESTS, come by broadcast: their revisits lose the payload before anything is shuffled, and are dealt
    out by row number. All others, with bounded groups, meet in a sort-merge join.
    """
    rows = pages.select(
        quoted(key).cast("bigint").alias("page_id"), F.coalesce(quoted(url).cast("string"), F.lit("")).alias("url"), text_or_empty(html).cast("binary").alias("payload")
    ).withColumns({"sha1": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("bigint")})
    several = cut(rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    enough = max(2, -(-pages.count() // HOT_DIGESTS))
    hot = several.where(F.col("n") >= enough).select("sha1", F.col("first_id").alias("hot_id"), F.lit(True).alias("hot"))
    looked = rows.join(F.broadcast(hot), "sha1", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    long_enough = F.col("payload_bytes") >= least
    known = F.col("hot") & long_enough & ~F.col("page_id").eqNullSafe(F.col("hot_id"))
    looked = looked.withColumns({
        "payload": F.when(~known, F.col("payload")),
        "at": F.when(F.col("hot"), F.encode(F.lpad(F.monotonically_increasing_id().cast("string"), 24, "0"), "utf-8")).otherwise(F.col("sha1")),  # no digest has 24 bytes
    })
    rest = several.where(F.col("n") < enough).select(F.col("sha1").alias("at"), "first_id", F.lit(True).alias("found"))
    joined = looked.join(rest.hint("merge"), "at", "left")
    revisit = F.when(F.col("hot"), known).otherwise(F.col("found").isNotNull() & long_enough & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    return joined.select(
        "page_id", "url", "sha1", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"), F.coalesce("hot_id", "first_id").alias("first_id"), revisit.alias("revisit")
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows one by one, as Python values."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Archives in ``folder``; their paths and record counts, ``(path, records)``, checkpointed.

    A task writes one package after another, each of at most ``PACKAGE_RECORDS`` records and a little over
    ``PACKAGE_BYTES`` bytes, so that its index stays small.
    """
    ship(planned.sparkSession)

    def package(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches)
        row = next(rows, None)
        while row is not None:
            index, n, at = io.BytesIO(), 0, 0

            def fill(file) -> None:
                nonlocal row, n, at
                with zipfile.ZipFile(file, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                    with z.open(ARCHIVE, "w", force_zip64=True) as member:
                        while row is not None and n < PACKAGE_RECORDS and at < PACKAGE_BYTES:
                            packed = gzip.compress(record(*row), 5, mtime=0)
                            member.write(packed)
                            index.write(json.dumps({"page_id": row[0], "offset": at, "length": len(packed)}).encode() + b"\n")
                            n, at, row = n + 1, at + len(packed), next(rows, None)
                    with z.open(INDEX, "w", force_zip64=True) as member:
                        member.write(index.getbuffer())

            path = _write(folder, f"{uuid.uuid4().hex}.zip", fill)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return cut(planned.select("page_id", "url", "sha1", "payload_bytes", "payload", "first_id", "revisit").mapInArrow(package, "path string, records bigint"))


def entries(archives: DataFrame) -> DataFrame:
    """The index entries of the packages whose ``path`` the rows name: ENTRY_SCHEMA."""
    ship(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path,) in _rows(batches):
            file = RangeFile(path)
            found = members(file)
            base = found[ARCHIVE][0]
            at, left = found[INDEX]
            rest = b""
            while left:
                piece = file.read(at, min(left, INDEX_PIECE))
                at, left = at + len(piece), left - len(piece)
                *lines, rest = (rest + piece).split(b"\n")
                some = [json.loads(line) for line in ([*lines, rest] if not left else lines) if line.strip()]
                if some:
                    starts, lengths = (pa.array([x[k] for x in some], pa.int64()) for k in ("offset", "length"))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([base] * len(some), pa.int64()), starts, lengths], names=["path", "base", "start", "length"])
            file.close()

    return archives.select("path").mapInArrow(read, ENTRY_SCHEMA)


def records(found: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at these index entries, by range reads: RECORD_SCHEMA."""
    ship(found.sparkSession)
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, out, size = None, None, [], 0
        for p, base, start, length in _rows(batches):
            if p != path:
                if file:
                    file.close()
                path, file = p, RangeFile(p)
            one = parse(gzip.decompress(file.read(base + start, length)))
            size += 200 + len(one["payload"] if payloads and one["payload"] else b"")
            out.append(one if payloads else one | {"payload": None})
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, types)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, types)
        if file:
            file.close()

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, F.col("path"), F.floor(F.col("start") / STRETCH)).sortWithinPartitions("path", "start")
    return dealt.select("path", "base", "start", "length").mapInArrow(read, RECORD_SCHEMA)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write(plan(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return records(entries(archives), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
d AS (SELECT *, array_to_string(list_transform(string_split(sha1(payload), ''), lambda h: lpad(bin(('0x' || h)::INT), 4, '0')), '') AS bits FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 160, 5), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         list_sum(list_transform(range(1, 6), lambda j: substr(bits, (k + j)::BIGINT, 1)::INT * (1 << (5 - j))))::BIGINT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
