"""Packing by optimal length buckets.

A document's length is its token count plus one for the separator. Lengths go into one global histogram:
exact up to ``EXACT``, beyond it in bins of less than a thousandth of their length, each of which counts as its
longest document. So the driver sees at most ``EXACT`` rows and 1024 for each further doubling, however many
documents there are. Dynamic programming over the histogram chooses at most ``BUCKETS`` bucket lengths,
each the length of a document, so that padding every document to its bucket's length costs the fewest tokens.
Inside each bucket, documents form batches of at most ``BUDGET`` padded tokens; a bucket longer than the
budget has batches of one document. Only the last batch of a bucket can be short.

Positions inside a bucket are numbered in two steps: by hash blocks of bounded size, and by the counts of
the blocks before. So a bucket with a third of all rows is spread over many tasks.

Defined cases: null and empty texts have length 1. A text of any length is counted whole; runs of over
``LONG_RUN`` space characters, which the counting library can't take, are cut from the text beforehand
just where its own pattern would cut. Documents of equal length are told apart by the hash of key, length
and row number, so equal rows take different slots. Null and repeated keys and repeated rows are documents of
their own. Columns named ``bucket``, ``bucket_length``, ``batch`` or ``slot`` are replaced; others keep their names.
An empty table has no buckets and gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.bpe import WORDS
from tessera.llm.common import cut, documents, fresh, quoted, ship, text_or_empty

BUCKETS = 16
BUDGET = 65_536  # padded tokens of a batch
EXACT = 1 << 20
LONG_RUN = 10_000
BLOCK_ROWS = 200_000
#: Fixed value: what the vocabulary's added token looks like in a text.
SPECIAL = ("<|endoftext|>",)

_LONG_RUN, _WORDS = re.compile(r"\s{%d}" % LONG_RUN), regex.compile(WORDS)


def bin_of(length: Column) -> Column:
    """The length itself up to EXACT, beyond it the upper end of a bin of less than a thousandth of the length."""
    bits = F.greatest(F.length(F.bin(F.greatest(length - 1, F.lit(1)))) - 11, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))
    return F.when(length <= EXACT, length).otherwise(F.floor((length + step - 1) / step) * step).cast("bigint")


def best_buckets(ends: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The bucket lengths, out of the rising ``ends``, that pad least; the last end is always one.

    ``best[j]`` is the least padded total of the bins up to j. A further bucket over the bins i to j costs
    ``best[i - 1] + (upto[j + 1] - upto[i]) * ends[j]``: for each i a line over ``ends[j]``, the steeper the later i.
    So a queue of the lines that can still be least gives all of a round's minima in one pass. Whole numbers only.
    """
    n = len(ends)
    if n <= buckets:
        return list(ends)
    upto = [0, *itertools.accumulate(counts)]
    best, chosen = [upto[j + 1] * ends[j] for j in range(n)], []
    for _ in range(1, buckets):
        lines: deque[tuple[int, int, int]] = deque()  # (slope, height, i)
        new, first = best[:1], [0]
        for j in range(1, n):
            slope, height = -upto[j], best[j - 1]
            while len(lines) > 1:
                (s1, h1, _), (s2, h2, _) = lines[-2], lines[-1]
                if (height - h1) * (s1 - s2) > (h2 - h1) * (s1 - slope):
                    break
                lines.pop()  # never below both its neighbours
            lines.append((slope, height, j))
            x = ends[j]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            total = lines[0][0] * x + lines[0][1] + upto[j + 1] * x
            new.append(min(total, best[j]))
            first.append(lines[0][2] if total < best[j] else 0)
        best = new
        chosen.append(first)
    out, j = [], n - 1
    for first in reversed(chosen):
        if first[j]:
            out.append(ends[j])
            j = first[j] - 1
    out.append(ends[j])
    return out[::-1]


def plan_buckets(df: DataFrame, length: Column, buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths for all rows of ``df``."""
    bins = df.groupBy(bin_of(length).alias("bin")).agg(F.max(length).alias("end"), F.count("*").alias("n")).select("end", "n").toPandas().sort_values("end")
    return best_buckets(bins["end"].tolist(), bins["n"].tolist(), buckets)


def pack(df: DataFrame, length: str, key: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``df`` with ``bucket``, ``bucket_length``, ``batch`` (counted inside its bucket) and ``slot``.

    ``df`` should be slim, and is checkpointed: its rows get their place by hash of ``key``, ``length``
    and row number.
    """
    names = [c for c in df.columns if c not in ("bucket", "bucket_length", "batch", "slot")]
    row, at_bucket, order, block, n, before = fresh(df, "row", "bucket", "order", "block", "n", "before")
    slim = cut(df.select(*[quoted(c) for c in names], F.monotonically_increasing_id().alias(row)))
    ends = plan_buckets(slim, quoted(length), buckets) or [1]
    limits = F.array(*[F.lit(e).cast("bigint") for e in ends])
    blocks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // BLOCK_ROWS))
    placed = slim.withColumns({at_bucket: reduce(add, [(quoted(length) > e).cast("int") for e in ends]), order: F.xxhash64(quoted(key), quoted(length), row)})
    placed = placed.withColumn(block, F.pmod(order, F.lit(blocks)))
    earlier = Window.partitionBy(at_bucket).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(at_bucket, block).agg(F.count("*").alias(n)).select(at_bucket, block, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    at = F.col(before) + F.row_number().over(Window.partitionBy(at_bucket, block).orderBy(order, row)) - 1
    end = F.element_at(limits, F.col(at_bucket) + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / end))
    return placed.join(offsets, [at_bucket, block]).select(
        *[quoted(c) for c in names], F.col(at_bucket).cast("int").alias("bucket"), end.alias("bucket_length"),
        F.floor(at / room).cast("bigint").alias("batch"), (at % room).cast("bigint").alias("slot"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _count(encoding, special: Sequence[str], text: str) -> int:
    """Tokens of the text; each of the ``special`` strings is one token, as for op 10."""
    for one in special:
        if one in text:
            rest = [s for s in special if s != one]
            pieces = text.split(one)
            return len(pieces) - 1 + sum(_count(encoding, rest, piece) for piece in pieces)
    if len(text) > LONG_RUN and _LONG_RUN.search(text):
        return sum(len(encoding._encode_single_piece(word.encode("utf-8"))) for word in _WORDS.findall(text))
    return len(encoding.encode_ordinary(text))


def lengths(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", special: Sequence[str] = SPECIAL) -> DataFrame:
    """``key, length``: tokens of the whole text, by a file of byte-level ranks, and one separator."""
    ship(docs.sparkSession)
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # its size doesn't depend on the data

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        parsed = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.value.splitlines() if line)}
        encoding = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=parsed, special_tokens={})
        for texts in batches:
            yield pd.Series([_count(encoding, special, x) + 1 for x in texts], dtype="int64")

    return docs.select(quoted(key), F.pandas_udf(count, T.LongType())(text_or_empty(text)).alias("length"))


def op9_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack(lengths(documents(spark, sf_dir), path or default_path()), "length", "doc_id")
