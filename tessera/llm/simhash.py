r"""SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are cut into blocks, so that two fingerprints within the threshold differ by at
most ``radius = threshold // blocks`` bits in at least one block. In each block the anchors are the
codewords of a product of Hamming codes and free bits: a covering code, with covering radius 1 per
Hamming part. A fingerprint is replicated, in each block, to every anchor within the covering radius plus
``radius``. Of two fingerprints that nearly agree in a block, the nearest anchor of one is then among the
anchors of the other, so they meet there. Fingerprints are compared per anchor, over all 64 bits.

Only distinct fingerprints take part, so copies of a text cost nothing here. Small anchors compare all
their members at once; large ones walk the graph from member to member and compare each only with those
not yet reached, so a dense group costs little more than its size. Either way an anchor yields at most
one link per member: a spanning forest of its links, never all pairs. Links then join up by large-star and
small-star rounds over DataFrames, and every document takes the smallest doc_id of its component.

Codes grow with the number of fingerprints (``choose_code``): each is exact, they differ in cost alone. Up to
100 million fingerprints make 42 replicas each, of 16 bytes; more make 343, on anchors a thousand times as
many, since comparing within crowded anchors would cost more than that.

``similar_memberships`` and ``keep_one`` link by likeness instead: a cosine of ``SIMILARITY`` or more between the
counts of two texts' 5-word shingles (the same as a Jaccard similarity of two thirds). It is judged by the
differing bits of long SimHash fingerprints, allowing for a standard error, so texts somewhat below it may
link. Texts meet by anchors too: 40 blocks of another long fingerprint, over 2-word shingles, each go to the
anchor within the covering radius, with no further threshold, since more blocks cost less than more replicas
of each. A pair that meets in no block is missed; tests hold recall against all pairs.

A task holds the fingerprints of one anchor at a time: 8 or 72 bytes for each distinct one.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any
other. Texts of any length count whole, those of fewer words than a shingle as one. Rows with a null doc_id link, but never name a component; a component without any doc_id has a
null component_id. Rows that share doc_id and text stand or go together. Columns of the table keep their names
and values, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, documents, fresh, quoted, ship, text_or_empty

SHINGLE = 4
THRESHOLD = 4
SEED = 42

#: What holds at least one in HOT of the rows, links or fingerprints is looked up by broadcast; there can be no more than HOT such values.
HOT = 1000

#: For documents at least so alike: by word shingles of this length, judged on long fingerprints of LONG words of 64 bits.
SIMILARITY, SIMILAR_SHINGLE, MEETING_SHINGLE, LONG = 0.8, 5, 2, 8

#: From this many members on, an anchor is walked instead of compared all against all.
LARGE_ANCHOR = 256


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six spaces
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    """The fingerprint's 64 bits as a signed long."""
    return pd.Series(np.array([fingerprint(x or "") for x in texts], np.uint64).view(np.int64))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return out


#: The constants of the SplitMix64 generator.
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_STREAMS = np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(_GOLDEN)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


def _long_print(words: np.ndarray, shingle: int) -> bytes:
    """The SimHash of ``64 * LONG`` bits over shingles of these words' hashes; zero without words."""
    n = len(words) - min(shingle, len(words)) + 1 if len(words) else 0
    ones = np.zeros(64 * LONG, np.int64)
    for begin in range(0, n, 255 * 16):
        end = min(n, begin + 255 * 16)
        h = np.zeros(end - begin, np.uint64)
        for j in range(min(shingle, len(words))):
            h = _mixed(h * np.uint64(_GOLDEN) + words[begin + j : end + j])
        bits = np.unpackbits(_mixed(h[:, None] + _STREAMS).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # sums that fit a byte
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def long_prints(text: str, hashes: dict | None = None) -> bytes:
    """The fingerprint by which a text meets others, and that by which it is judged, one after the other."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    found = np.fromiter(map((hashes if hashes is not None else _WordHashes()).__getitem__, words), np.uint64, len(words))
    return _long_print(found, MEETING_SHINGLE) + _long_print(found, SIMILAR_SHINGLE)


def _all_long_prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hashes = _WordHashes()
    for texts in batches:
        yield pd.Series([long_prints(x or "", hashes) for x in texts], dtype=object)


def most_differing(similarity: float) -> int:
    """The bits by which long fingerprints of texts this alike differ, and a standard error of that estimate."""
    share = math.acos(similarity) / math.pi
    return int(64 * LONG * share + math.sqrt(64 * LONG * share * (1 - share)))


class Code:
    """One block's anchors: Hamming codes of the given lengths and then free bits, from bit ``first`` on."""

    def __init__(self, first: int, hamming: tuple[int, ...], free: int, radius: int):
        self.first, self.hamming, self.free, self.radius = first, hamming, free, radius
        self.bits = sum(hamming) + free
        # For a syndrome: what to flip to reach a codeword, by excess over the covering radius, one list for each part.
        self.moves = [[self._hamming_moves(n, s) for s in range(n + 1)] for n in hamming]

    def _hamming_moves(self, n: int, syndrome: int) -> list[tuple[int, int]]:
        """(flips, excess) of the codewords within 1 + radius; the first is the nearest."""
        out = [(1 << (syndrome - 1) if syndrome else 0, 0)]
        for size in range(2, self.radius + 2):
            for places in itertools.combinations(range(n), size):
                got = 0
                for p in places:
                    got ^= p + 1
                if got == syndrome:
                    out.append((sum(1 << p for p in places), size - 1))
        return out

    def anchors(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of fingerprint, anchor) for every anchor of every fingerprint."""
        rest = (prints >> np.uint64(self.first)) & np.uint64((1 << self.bits) - 1)
        # Rows of (index, anchor so far, excess so far); each part multiplies them by its moves.
        at, word, excess, low = np.arange(len(prints)), rest.copy(), np.zeros(len(prints), np.int64), 0
        for n, moves in zip(self.hamming, self.moves, strict=True):
            part = (rest >> np.uint64(low)) & np.uint64((1 << n) - 1)
            syndrome = np.zeros(len(part), np.int64)
            for p in range(n):
                syndrome ^= np.where((part >> np.uint64(p)) & np.uint64(1), p + 1, 0)
            most = max(len(m) for m in moves)
            flips = np.zeros((n + 1, most), np.uint64)
            cost = np.full((n + 1, most), 99, np.int64)
            for s, ms in enumerate(moves):
                for j, (f, e) in enumerate(ms):
                    flips[s, j], cost[s, j] = f, e
            s = syndrome[at]
            total = excess[:, None] + cost[s]
            i, j = np.nonzero(total <= self.radius)
            at, word, excess = at[i], word[i] ^ (flips[s[i], j] << np.uint64(low)), total[i, j]
            low += n
        flips = [(0, 0)] + [(sum(1 << (low + p) for p in places), size) for size in range(1, self.radius + 1) for places in itertools.combinations(range(self.free), size)]
        f, e = np.array([x for x, _ in flips], np.uint64), np.array([x for _, x in flips])
        i, j = np.nonzero(excess[:, None] + e[None, :] <= self.radius)
        return at[i], word[i] ^ f[j]


def choose_code(n: int) -> list[Code]:
    """The blocks for ``n`` fingerprints: few copies of each while there are few, finer anchors when there are many."""
    if n <= 100_000_000:
        return [Code(0, (15,), 6, 1), Code(21, (15,), 6, 1), Code(42, (15,), 7, 1)]  # 2^17 to 2^18 anchors a block
    return [Code(0, (31,), 1, 2), Code(32, (31,), 1, 2)]  # 2^27 anchors a block


def meeting_blocks(n: int) -> list[tuple[int, int, Code]]:
    """(word i, word j, code) for ``n`` long fingerprints: a block of the word with the even bits of i and the odd bits of j.

    Of two texts as alike as SIMILARITY asks for, about an eighth of these bits differ, so no block is sure to
    agree; there are so many blocks that at least nine in ten such pairs share an anchor in one of them.
    """
    if n <= 100_000_000:
        codes = Code(0, (15,), 6, 0), Code(21, (15,), 6, 0), Code(42, (15,), 7, 0)
        return [(i, (i + k) % LONG, code) for k in range(2) for i in range(LONG) for code in codes[: 3 - k]]
    return [(i, (i + k) % LONG, code) for k in range(LONG) for i in range(LONG) for code in (Code(0, (15,), 17, 0), Code(32, (15,), 17, 0))]


_EVEN = 0x5555555555555555


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word, or of a row of words, each."""
    found = np.bitwise_count(a ^ b)
    return found if found.ndim < 2 else found.sum(axis=-1, dtype=np.uint16)


def _walk(nodes: np.ndarray, prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints."""
    left, names, pairs = prints, nodes, []
    queue: list[tuple[int, np.ndarray]] = []
    while len(left):
        if not queue:
            queue.append((names[-1], left[-1]))
            left, names = left[:-1], names[:-1]
        name, x = queue.pop()
        near = _distance(left, x) <= threshold
        if near.any():
            pairs.append((np.full(int(near.sum()), name), names[near]))
            queue += zip(names[near], left[near], strict=True)
            left, names = left[~near], names[~near]
    return _joined(pairs, nodes)


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]], like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])) if pairs else (like[:0], like[:0])


def _small(nodes: np.ndarray, prints: np.ndarray, sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The links within groups of consecutive members, comparing each member with those after it."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    pairs, step = [], 1
    at = np.nonzero(np.arange(len(prints)) + step < ends)[0]
    while len(at):
        hit = at[_distance(prints[at], prints[at + step]) <= threshold]
        pairs.append((nodes[hit], nodes[hit + step]))
        step += 1
        at = at[at + step < ends[at]]
    return _joined(pairs, nodes)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of these links, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            keep.append(i)
    return a[keep], b[keep]


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, nodes and fingerprints; of two columns, the nodes are the fingerprints."""
    keys, nodes = (batch.column(i).to_numpy() for i in (0, 1))
    return keys, nodes, nodes.view(np.uint64) if batch.num_columns == 2 else _words(batch.column(2))


def _words(column: pa.Array) -> np.ndarray:
    """A row of words for each of these byte strings, which are equally long."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(len(column), -1)


def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by anchor. Of an anchor that spans batches only its fingerprints are held."""
    held_key, held = None, []

    def links(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins = np.concatenate(([0], np.nonzero(np.diff(keys))[0] + 1)) if len(keys) else np.array([], int)
        sizes = np.diff(np.concatenate((begins, [len(keys)]))) if len(keys) else begins
        pairs = []
        for i in np.nonzero(sizes >= LARGE_ANCHOR)[0]:
            whole = slice(begins[i], begins[i] + sizes[i])
            pairs.append(_walk(nodes[whole], prints[whole], threshold))
        few = (sizes > 1) & (sizes < LARGE_ANCHOR)
        taken = np.repeat(few, sizes)
        pairs.append(_small(nodes[taken], prints[taken], sizes[few], threshold))
        x, y = _forest(*_joined(pairs, nodes))
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    def whole_anchor() -> Iterator[pa.RecordBatch]:
        nodes, prints = (np.concatenate(parts) for parts in zip(*held, strict=True))
        yield from links(np.full(len(nodes), held_key), nodes, prints)

    for batch in batches:
        keys, nodes, prints = _unpacked(batch)
        if not len(keys):
            continue
        first, last = int(np.searchsorted(keys, keys[0], "right")), int(np.searchsorted(keys, keys[-1], "left"))
        if held_key is not None and keys[0] == held_key:
            held.append((nodes[:first].copy(), prints[:first].copy()))
            if first == len(keys):
                continue
        else:
            first = 0
        if held_key is not None:
            yield from whole_anchor()
        yield from links(keys[first:last], nodes[first:last], prints[first:last])
        held_key, held = keys[-1], [(nodes[max(first, last) :].copy(), prints[max(first, last) :].copy())]
    if held_key is not None:
        yield from whole_anchor()


def _met(replicas: DataFrame, threshold: int) -> DataFrame:
    """Links ``(a, b)`` among the replicas ``(anchor, node[, print])`` that share an anchor."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, threshold)

    parts = int(replicas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return replicas.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a bigint, b bigint")


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``(a, b)`` among the distinct longs in ``fp`` that connect all within ``threshold`` bits of each other."""
    ship(prints.sparkSession)
    code = choose_code(prints.count())
    if len(code) * (code[0].radius + 1) <= threshold:
        raise ValueError(f"these blocks prove links up to {len(code) * (code[0].radius + 1) - 1} bits")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 2000):
                some = fp[i : i + 2000]
                for k, block in enumerate(code):
                    at, anchor = block.anchors(some.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(k << 40)).view(np.int64)), pa.array(some[at])], names=["anchor", "node"])

    return _met(prints.select("fp").mapInArrow(replicate, "anchor bigint, node bigint"), threshold)


def similar_links(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` among the distinct ``node`` whose long fingerprints, ``print``, share an anchor and are as alike as asked."""
    ship(prints.sparkSession)
    blocks = meeting_blocks(prints.count())

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                some = batch.slice(i, 2000)
                nodes, words = some.column(0).to_numpy(), _words(some.column(1))
                judged = pa.array([x.as_py()[8 * LONG :] for x in some.column(1)], pa.binary())
                for k, (even, odd, block) in enumerate(blocks):
                    at, anchor = block.anchors(words[:, even] & np.uint64(_EVEN) | words[:, odd] & np.uint64(_EVEN << 1))
                    yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(k << 40)).view(np.int64)), pa.array(nodes[at]), judged.take(pa.array(at))], names=["anchor", "node", "print"])

    return _met(prints.select("node", "print").mapInArrow(replicate, "anchor bigint, node bigint, print binary"), most_differing(similarity))


def _looked_up(rows: DataFrame, found: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``found`` for their key, which every row has; ``count`` is how many rows each key has, about.

    Keys with at least one in HOT of all rows come by broadcast, the others, with bounded groups, by join.
    """
    least = max(2, -(-total // HOT))
    hot = found.where(F.col(count) >= least).withColumn("_hot", F.lit(True))
    looked = rows.join(F.broadcast(hot), key, "left")
    some = looked.where("_hot").drop("_hot", count)
    rest = looked.where("_hot is null").select(*rows.columns).join(found.where(F.col(count) < least), key).drop(count)
    return some.unionByName(rest.select(*some.columns))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: root is the smallest node of its component.

    Rounds of large-star (larger neighbours move to the smallest) and small-star (smaller ones do), each
    cut by a checkpoint, until the links no longer change. Minima are taken with partial aggregation, so a
    node with very many links leaves each task as one row, and its minimum comes back to them by broadcast.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        # Large: every node u, all neighbours; links (v, m) for neighbours v > u. Small: neighbours v <= u; links (v, m), and (u, m).
        around = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
        joined = _looked_up(around, least, "a", "degree", 2 * total)
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])

    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = cut(star(star(edges, True, now[0]), False, now[0]))
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _components_of(slim: DataFrame, print_: str, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``slim`` (doc_id and more, checkpointed) with the ``component_id`` of its fingerprints. ``linked`` gives the links of ``(print, node)``."""
    prints = cut(slim.groupBy(print_).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")))
    # Nodes are numbers of the checkpointed rows, unless fingerprints are numbers themselves.
    prints = prints.withColumn("node", F.col(print_) if prints.schema[print_].dataType.typeName() == "long" else F.monotonically_increasing_id())
    roots = components(linked(prints))
    named = cut(prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select(print_, "copies", "least_id", "root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("prints"))
    of = _looked_up(named.drop("least_id"), ids, "root", "prints", named.count()).select(print_, "copies", "component_id")
    return _looked_up(slim, of, print_, "copies", slim.count())


def memberships(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` for each row of ``df``; fingerprints link at ``threshold`` or fewer differing bits."""
    ship(df.sparkSession)
    slim = cut(_slim(df, text, key).select("doc_id", "text_hash", F.pandas_udf(_fingerprints, "bigint")("text").alias("fp")))
    return _components_of(slim, "fp", lambda prints: links(prints, threshold)).select("doc_id", "text_hash", "fp", "component_id")


def similar_memberships(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_hash, component_id`` for each row of ``df``; texts link when their 5-word shingles are at least so alike.

    Likeness is the cosine of the shingles' counts, estimated by the differing bits of a SimHash of ``64 * LONG`` bits
    and allowing for a standard error. Texts meet by anchors of a second such SimHash, over 2-word shingles, of
    which an edit changes fewer.
    """
    ship(df.sparkSession)
    slim = cut(_slim(df, text, key).select("doc_id", "text_hash", F.pandas_udf(_all_long_prints, "binary")("text").alias("print")))
    return _components_of(slim, "print", lambda prints: similar_links(prints, similarity)).select("doc_id", "text_hash", "component_id")


def _slim(df: DataFrame, text: str, key: str) -> DataFrame:
    rows = df.select(quoted(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float | None = SIMILARITY, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose doc_id names their component: by similarity, or, where that is None, by differing bits of the short fingerprint."""
    found = memberships(df, text, key, threshold) if similarity is None else similar_memberships(df, text, key, similarity)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()
    a, b = fresh(df, "doc_id", "text_hash")
    kept = kept.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    same = quoted(key).cast("bigint").eqNullSafe(F.col(a)) & (F.xxhash64(text_or_empty(text)) == F.col(b))
    return df.join(kept, same, "left_semi")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = memberships(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
