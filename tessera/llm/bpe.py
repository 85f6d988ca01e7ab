"""Byte-level BPE encoding and decoding with a public tokenizer file.

Text is cut at the file's added tokens, then into words by the file's pattern; each distinct word is
merged once per worker and kept in a bounded cache. A short word is held as a contiguous array of the parts
between its boundaries, by id, with the rank of each adjacent pair: the array is scanned for the smallest rank,
the boundary there is deleted, and the two neighbouring ranks are refreshed, until no pair has a rank. Scanning is quadratic,
so words of more than ``SHORT`` bytes use a heap of ranks over a linked list instead, with the same
result: lowest rank first, leftmost among equals.

The tokenizer file is a parameter. Its path must be readable where the driver runs; the file's bytes are
broadcast, their size does not depend on the data.

Defined cases: a null text counts as empty and has no tokens. Decoding null ids gives an empty text; ids
that the file doesn't know raise an error. Invalid UTF-8 in a decoded sequence becomes U+FFFD. Rows, other
columns, repeated rows and row order within a partition pass through; ``ids`` replaces a column of that
name.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import documents, fresh, quoted, ship, text_or_empty

SHORT = 128  # bytes
CACHE_WORDS = 250_000  # distinct words in each of the two generations that a worker remembers
BATCH_SIZE = 1 << 20  # bytes or ids that are converted at once

ID_BITS = 20
ID_MASK, NO_RANK = (1 << ID_BITS) - 1, 1 << 60

#: Fixed value: the word pattern of byte-level pre-tokenization.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(plain))
    return {c: b for b, c in shown.items()}


class Cache(dict):
    """Ids by word, as packed 32-bit integers, merged when first asked for. Two generations, so that frequent words outlive a full cache."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.old = merge, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("i", self.merge(word.encode("utf-8"))).tobytes()
            if len(word) > SHORT:
                return ids
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Tokenizer:
    """Encoder and decoder for the contents of a byte-level BPE file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        self.id_of = {raw(token): i for token, i in model["vocab"].items()}
        self.bytes_of = {i: token for token, i in self.id_of.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # A pair's rank in the high bits and the id of what it becomes in the low ones, by the ids of its parts.
        self.rank_of: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.rank_of.setdefault(self.id_of[a] << ID_BITS | self.id_of[b], rank << ID_BITS | self.id_of[a + b])
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take neighbouring space are not supported")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.cache = Cache(self.merge)

    def merge(self, word: bytes) -> list[int]:
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        parts = [self.byte_ids[b] for b in word]
        rank_of = self.rank_of.get
        ranks = [rank_of(a << ID_BITS | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            became = parts[i] = best & ID_MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << ID_BITS | became, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(became << ID_BITS | parts[i + 1], NO_RANK)
        return parts

    def _heap(self, word: bytes) -> list[int]:
        n, parts = len(word), [self.byte_ids[b] for b in word]
        left, right, rank_of = list(range(-1, n - 1)), list(range(1, n + 1)), self.rank_of.get
        heap: list[tuple[int, int, int]] = []

        def push(i: int, j: int) -> None:
            pair = parts[i] << ID_BITS | parts[j]
            if (rank := rank_of(pair)) is not None:
                heapq.heappush(heap, (rank, i, pair))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = right[i]
            if parts[i] < 0 or j >= n or parts[i] << ID_BITS | parts[j] != pair:
                continue  # one of the two has been merged since
            parts[i], parts[j], right[i] = rank & ID_MASK, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return [p for p in parts if p >= 0]

    def encode_packed(self, text: str) -> bytes:
        """The ids as packed 32-bit integers."""
        out = []
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.special:
                out.append(array("i", [self.special[piece]]).tobytes())
            else:
                out += map(self.cache.__getitem__, self.words.findall(piece))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[int, tuple[str, Tokenizer]] = {}


def tokenizer(source: str) -> Tokenizer:
    """The tokenizer for a file's contents, one per worker process."""
    if (key := hash(source)) not in _loaded or _loaded[key][0] != source:
        _loaded.clear()
        _loaded[key] = (source, Tokenizer(source))
    return _loaded[key][1]


def _source(spark: SparkSession, path: str):
    ship(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _with_column(df: DataFrame, name: str, kind: T.DataType, convert) -> DataFrame:
    """``df`` with ``name`` added or replaced by ``convert`` of its last column, an array at a time; that column goes."""
    given = df.schema.fields[:-1]
    places = [i for i, f in enumerate(given) if f.name != name]
    # Columns go through under plain names: Python functions can't take those with dots or backticks.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*(plain.schema[i] for i in places), T.StructField("made", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(given))
            sizes = pc.fill_null(pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values), 0)
            upto, begin = np.cumsum(sizes.to_numpy(zero_copy_only=False)), 0
            while begin < len(values):
                done = int(upto[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, done + BATCH_SIZE, "right")))
                some = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*(some.column(p) for p in places), convert(some.column(len(given)))], names=schema.names)
                begin = end

    return plain.mapInArrow(run, schema).toDF(*(given[i].name for i in places), name)


def _with_texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns], text_or_empty(text).alias(fresh(df, "text")[0]))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of its texts, an array of ints."""
    source = _source(df.sparkSession, path)

    def convert(texts: pa.Array) -> pa.Array:
        encoder = tokenizer(source.value)
        packed = [encoder.encode_packed(x) for x in texts.to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    return _with_column(_with_texts(df, text), ids, T.ArrayType(T.IntegerType()), convert)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts of its token ids."""
    source = _source(df.sparkSession, path)

    def convert(lists: pa.Array) -> pa.Array:
        decoder = tokenizer(source.value)
        return pa.array([decoder.decode([] if x.values is None else x.values.to_numpy().tolist()) for x in lists], pa.string())

    return _with_column(df.select(*[quoted(c) for c in df.columns], quoted(ids).alias(fresh(df, "ids")[0])), text, T.StringType(), convert)


def count_tokens(df: DataFrame, path: str, text: str = "text", tokens: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of its texts."""
    source = _source(df.sparkSession, path)

    def convert(texts: pa.Array) -> pa.Array:
        encoder = tokenizer(source.value)
        return pa.array([len(encoder.encode_packed(x)) // 4 for x in texts.to_pylist()], pa.int64())

    return _with_column(_with_texts(df, text), tokens, T.LongType(), convert)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or default_path()
    encoded = encode(documents(spark, sf_dir).select("doc_id", "text"), path).select("doc_id", "ids")
    # Arrow carries the decoded texts back with the ids; the digests are taken by Spark.
    return decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
