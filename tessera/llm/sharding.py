"""Sharding by sampled splitters.

Records are ordered by (hash of the text, key, row number), which sets equal texts next to each other
and spreads everything else. A size-weighted sample of that order gives quantile boundaries that cut it
into many small ranges; ranges that turn out overfull, in bytes or in rows, are cut again by splitters
sampled inside them. Exact sums of the ranges then place the shard boundaries, each inside one range, so
shard sizes differ by less than a record, plus at most ``KEEP_TOGETHER`` of a shard where a boundary
moves to the edge of a group of equal texts. Law: ``bytes``.

The order, the sample and the sums use a slim table (no texts) that is checkpointed once. Only
splitters, range sums and boundaries reach the driver; their number is bounded by ``MAX_RANGES``.
Slots are numbered inside ranges and offset by the sums, so no task sees more than a range: some
``ROWS_PER_RANGE`` rows, more only beyond ``MAX_RANGES / 4`` times as many rows, or where ``ROUNDS`` rounds of
cutting left a range overfull; sizes of shards don't depend on that.

Defined cases: a null text has 0 bytes and size 1. Null keys come first in their group. Repeated rows
are told apart by row number, so a key or text with a third of all rows is cut like any other
stretch. A text of any length is one record, never cut. With fewer records than shards some shards are empty.
Only the columns that are named are read, so others may have any name or type. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, documents, quoted, text_or_empty

SHARDS = 8
RANGES_PER_SHARD = 4
ROWS_PER_RANGE = 2_000_000  # more ranges than RANGES_PER_SHARD asks for where they'd hold more rows
MAX_RANGES = 4096
DRAWS_PER_RANGE = 32
OVERFULL = 2.0  # times the mean range
ROUNDS = 3  # of subdividing
KEEP_TOGETHER = 0.01  # of a shard: groups of equal texts up to this size are not split by a boundary

_KEY = "struct<h:bigint,k:bigint,r:bigint>"
Splitter = tuple  # (h, k, r)


def _lit(splitter: Splitter) -> str:
    h, k, r = ("null" if v is None else f"{v}L" if v > -(1 << 63) else "bigint('-9223372036854775808')" for v in splitter)
    return f"named_struct('h', bigint({h}), 'k', bigint({k}), 'r', bigint({r}))"


def _rank(splitters: list[Splitter], lo: int = 0, hi: int | None = None) -> str:
    """SQL: how many of the sorted splitters are at or below ``o``, by binary search in CASE branches."""
    hi = len(splitters) if hi is None else hi
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"CASE WHEN o < {_lit(splitters[mid])} THEN {_rank(splitters, lo, mid)} ELSE {_rank(splitters, mid + 1, hi)} END"


def _sort_key(splitter: Splitter) -> tuple:
    return tuple((v is not None, v or 0) for v in splitter)


def _ordered(splitters) -> list[Splitter]:
    return sorted(set(splitters), key=_sort_key)


def _drawn(slim: DataFrame, weight: str, draws: float, seed: int) -> list[Splitter]:
    """About ``draws`` keys, each row with a chance in proportion to ``weight`` (which sums to 1), sorted.

    A row's number takes part in the draw, so copies of a row are drawn one by one.
    """
    chance = f"(xxhash64(o, {seed}) & {(1 << 40) - 1}L) < {draws} * {weight} * {float(1 << 40)!r}D"
    return sorted(((x["o"]["h"], x["o"]["k"], x["o"]["r"]) for x in slim.where(chance).select("o").collect()), key=_sort_key)


def _quantiles(sample: list[Splitter], pieces: int) -> list[Splitter]:
    return [sample[len(sample) * i // pieces] for i in range(1, pieces)] if sample else []


def _sums(slim: DataFrame, splitters: list[Splitter]) -> dict[int, tuple[int, int]]:
    rows = slim.groupBy(F.expr(_rank(splitters)).alias("range")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["range"]: (r["b"], r["n"]) for r in rows}


def _splitters(slim: DataFrame, total: int, rows: int, shards: int, seed: int) -> list[Splitter]:
    """Boundaries of ranges, none of them overfull after the rounds of subdividing."""
    pieces = min(MAX_RANGES // 4, max(shards * RANGES_PER_SHARD, -(-rows // ROWS_PER_RANGE)))
    out = _ordered(_quantiles(_drawn(slim, f"size / {float(total)!r}D", DRAWS_PER_RANGE * pieces, seed), pieces))
    most_b, most_n = OVERFULL * total / pieces, OVERFULL * rows / pieces
    for turn in range(1, ROUNDS + 1):
        full = {i: (b, n) for i, (b, n) in _sums(slim, out).items() if (b > most_b or n > most_n) and n > 1}
        if not full or len(out) >= MAX_RANGES:
            break
        within = slim.withColumn("range", F.expr(_rank(out))).where(F.col("range").isin(list(full)))
        # Inside these ranges rows and bytes count alike, else a range of many empty texts stays whole.
        b, n = sum(b for b, _ in full.values()), sum(n for _, n in full.values())
        extra = sum(int(b / most_b + n / most_n) + 1 for b, n in full.values())
        drawn = _drawn(within, f"(size / {2.0 * b!r}D + 1 / {2.0 * n!r}D)", DRAWS_PER_RANGE * extra, seed + turn)
        out = _ordered([*out, *_quantiles(drawn, extra)])
    return out


def _boundaries(slim: DataFrame, splitters: list[Splitter], total: int, shards: int) -> list[Splitter]:
    """The keys at which shards 1, 2, ... begin."""
    sums, start, before = _sums(slim, splitters), {}, 0
    for i in sorted(sums):
        start[i] = before
        before += sums[i][0]
    marks = [total * s / shards for s in range(1, shards)]
    holds = sorted({max(i for i in start if start[i] <= m) for m in marks})
    if not holds:
        return []
    base = F.element_at(F.create_map(*[F.lit(v) for i in holds for v in (i, start[i])]), F.col("range"))
    along = Window.partitionBy("range").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = slim.withColumn("range", F.expr(_rank(splitters))).where(F.col("range").isin(holds)).withColumn("middle", base + F.sum("size").over(along) - F.col("size") / 2)
    # The first record whose middle lies beyond a mark begins the shard; if none of its range's does, the next range does.
    row = near.agg(*[F.min(F.when(F.col("middle") >= m, F.col("o"))).alias(f"m{s}") for s, m in enumerate(marks)]).collect()[0]
    cuts = []
    for s, m in enumerate(marks):
        at = max(i for i in start if start[i] <= m)
        found = row[f"m{s}"]
        cuts.append((found["h"], found["k"], found["r"]) if found else splitters[at] if at < len(splitters) else None)
    return _ordered(_snapped(slim, [c for c in cuts if c is not None], KEEP_TOGETHER * total / shards))


def _snapped(slim: DataFrame, cuts: list[Splitter], most: float) -> list[Splitter]:
    """Each boundary moved to the nearer edge of the group of equal texts that it would split, if that group is small."""
    hashes = sorted({c[0] for c in cuts})
    below = [F.sum(F.expr(f"CASE WHEN o < {_lit(c)} THEN size ELSE 0 END")).alias(f"c{i}") for i, c in enumerate(cuts)]
    found = {r["h"]: r for r in slim.where(F.col("o.h").isin(hashes)).groupBy(F.col("o.h").alias("h")).agg(F.sum("size").alias("all"), *below).collect()}
    out = []
    for i, c in enumerate(cuts):
        whole, part = found[c[0]]["all"], found[c[0]][f"c{i}"]
        if whole > most:
            out.append(c)
        elif 2 * part <= whole or c[0] == (1 << 63) - 1:
            out.append((c[0], None, None))
        else:
            out.append((c[0] + 1, None, None))
    return out


def assign(df: DataFrame, size: Column, text: str = "text", key: str = "doc_id", shards: int = SHARDS, seed: int = 11, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``df``: the key, ``carry``'s columns, ``size``, ``shard`` and ``slot``.

    ``slot`` counts from 0 without gaps in each shard, in the order of the ranges.
    """
    carry = carry or {}
    order = F.struct(F.xxhash64(text_or_empty(text)).alias("h"), quoted(key).cast("bigint").alias("k"), F.monotonically_increasing_id().alias("r"))
    slim = cut(df.select(order.alias("o"), size.cast("bigint").alias("size"), *[c.alias(f"c_{n}") for n, c in carry.items()]))
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).collect()[0]
    splitters = _splitters(slim, total, rows, shards, seed) if rows else []
    cuts = _boundaries(slim, splitters, total, shards) if rows else []
    cuts += [None] * (shards - 1 - len(cuts))
    real = [c for c in cuts if c is not None]
    ranges = _ordered([*splitters, *real])
    sums = _sums(slim, ranges)
    shard_of = [sum(_sort_key(c) <= _sort_key(ranges[i - 1]) for c in real) if i else 0 for i in range(len(ranges) + 1)]
    offset, seen = [], [0] * shards
    for i in range(len(ranges) + 1):
        offset.append(seen[shard_of[i]])
        seen[shard_of[i]] += sums.get(i, (0, 0))[1]
    at = F.col("range") + 1
    return (
        slim.withColumn("range", F.expr(_rank(ranges)))
        .withColumn("slot", F.row_number().over(Window.partitionBy("range").orderBy("o")) - 1 + F.element_at(F.array(*[F.lit(x).cast("bigint") for x in offset]), at))
        .withColumn("shard", F.element_at(F.array(*[F.lit(x) for x in shard_of]), at))
        .select(F.col("o.k").alias(key), *[F.col(f"c_{n}").alias(n) for n in carry], "size", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(text_or_empty("text"), "utf-8")
    return assign(documents(spark, sf_dir), F.octet_length(text_or_empty("text")) + 1, carry={"text_crc32": F.crc32(text)}).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
