r"""Chat formatting: a hidden Markov model recovers who speaks in plain transcripts.

A transcript is a list of lines. Hidden states are (role, first line or later line of a turn); each line
shows a speaker marker (none, or that of a role), whether a blank line stands before it, whether it ends
in a question mark, and its length in doublings. The features are independent given the state. Start,
transition and emission probabilities are counted, with smoothing, on a bounded sample of labelled turns;
Viterbi then finds the likeliest states, and each run of lines becomes a canonical turn, marker removed:
``<|role|>\n...<|end|>\n``.

Conversations are read in blocks of ``BLOCK`` turn numbers, so that none is gathered whole. A block that
repeats turn numbers and so holds over ``BLOCK`` rows is divided into parts of at most that many rows, each
contiguous in the order of turn, the text's hash and row number. Viterbi over several blocks is exact: a
first pass reduces every block of such a conversation to its max-plus matrix (the best score from each state
at the end of the block before to each state at its own end) with the first state and the order of the best
paths, these few numbers are followed along the conversation, and a second pass decodes every block between
the states found, also knowing whether the next block goes on with its last turn. Scores are multiples of
``GRID``, whose sums are exact, and equal paths are told apart from the end backwards by the lesser state, so
blocks give what one piece gives.

Bound: the model is fitted on the first ``TRAIN_TURNS`` turns in the order of a hash of conv_id, over all
conversations that are not held out (crc32(conv_id as text) mod 4 is 2). Their whole texts are counted, in
executors; only counts reach the driver.

Defined cases: a null text is one empty line. A null conv_id is a conversation of its own for each row; a
null turn comes first. Rows equal in conv_id, turn and the text's hash follow one another in any order. Roles other
than the three known ones train nothing. Without labelled turns all states are equally likely at first.
Texts of any length are read whole; a part's texts are held together. Columns named ``text``, ``n_lines``,
``roles`` or ``rendered`` are replaced; others keep their names, types and values. An empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, quoted, ship, text_or_empty

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2 + (1 for later lines)
BLOCK = 4096
TRAIN_TURNS = 20_000
SMOOTHING = 0.1
GRID = 2.0**-20

#: Speaker markers by role; a line that starts with one and a colon shows it.
MARKERS = {"system": ("system", "sys", "instructions"), "user": ("user", "human", "q", "me", "customer"), "assistant": ("assistant", "ai", "bot", "a", "agent")}
_MARKED = re.compile(r"\s*(?:\*\*)?(" + "|".join(sorted((m for ms in MARKERS.values() for m in ms), key=len, reverse=True)) + r")(?:\*\*)?\s*:\s*", re.IGNORECASE)
_ROLE_OF = {m: i + 1 for i, role in enumerate(ROLES) for m in MARKERS[role]}
SHAPES = (len(ROLES) + 1, 2, 2, 16)  # markers, blank before, question, length


def features(text: str, blank: bool) -> list[tuple[int, int, int, int]]:
    """(marker, blank before, question, length) of each line; ``blank``: whether a blank line stands before the first."""
    out = []
    for line in text.split("\n"):
        found = _MARKED.match(line)
        rest = line[found.end() :] if found else line
        out.append((_ROLE_OF[found[1].lower()] if found else 0, int(blank), int(rest.rstrip().endswith("?")), min(15, len(rest).bit_length())))
        blank = not line.strip()
    return out


@dataclass(frozen=True)
class Hmm:
    """Logarithms: start (S), moves (S, S), and for each feature (S, values)."""

    start: np.ndarray
    moves: np.ndarray
    shows: tuple[np.ndarray, ...]

    def emissions(self, rows: list[tuple[int, int, int, int]]) -> np.ndarray:
        x = np.array(rows)
        return sum(table[:, x[:, i]] for i, table in enumerate(self.shows)).T


#: Counts of starts, moves and the values of each feature, one after the other.
_SIZES = (STATES, STATES * STATES, *(STATES * n for n in SHAPES))


def count_turns(rows: Iterable[tuple[Hashable, str, str]]) -> np.ndarray:
    """The counts of (conversation, role, text) in the order of the conversations, with texts as a transcript shows them."""
    start, moves = np.zeros(STATES), np.zeros((STATES, STATES))
    shows = [np.zeros((STATES, n)) for n in SHAPES]
    last, current = None, None
    for conv, role, text in rows:
        if conv != current:
            last, current = None, conv
        if role not in ROLES:
            last = None
            continue
        for i, row in enumerate(features(text, True)):
            state = 2 * ROLES.index(role) + (i > 0)
            if last is None:
                start[state] += 1
            else:
                moves[last, state] += 1
            for table, value in zip(shows, row, strict=True):
                table[state, value] += 1
            last = state
    return np.concatenate([t.ravel() for t in (start, moves, *shows)])


def fit(counts: np.ndarray) -> Hmm:
    """The model of these counts, smoothed."""
    start, moves, *shows = np.split(counts + SMOOTHING, np.cumsum(_SIZES)[:-1])
    moves, shows = moves.reshape(STATES, STATES), [t.reshape(STATES, n) for t, n in zip(shows, SHAPES, strict=True)]
    # A later line follows its own turn's lines only.
    for a in range(STATES):
        for role in range(len(ROLES)):
            if a // 2 != role:
                moves[a, 2 * role + 1] = 1e-12
    start[1::2] = 1e-12
    log = lambda m: np.round(np.log(m / m.sum(axis=-1, keepdims=True)) / GRID) * GRID
    return Hmm(log(start), log(moves), tuple(log(t) for t in shows))


def reduce_paths(hmm: Hmm, shown: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(S, S) each, from the state just before the block to that at its end: the best path's score, its first state, and its place among those with the same end, by the lesser state from the end backwards."""
    every = np.arange(STATES)
    best, first, place = hmm.moves + shown[0], np.tile(every, (STATES, 1)), np.tile(every[:, None], (1, STATES))
    for row in shown[1:]:
        total = best[:, :, None] + hmm.moves[None]
        last = total.argmax(axis=1)
        best = total.max(axis=1) + row
        first = np.take_along_axis(first, last, axis=1)
        place = (last * STATES + np.take_along_axis(place, last, axis=1)).argsort(axis=0, kind="stable").argsort(axis=0)
    return best, first, place


def reduce_block(hmm: Hmm, shown: np.ndarray) -> np.ndarray:
    """(S, S): the best score from each state just before the block to each state at its end."""
    return reduce_paths(hmm, shown)[0]


def viterbi(hmm: Hmm, shown: np.ndarray, before: int | None = None, at_end: int | None = None) -> np.ndarray:
    """The likeliest states; ``before``: the state just before the first line, ``at_end``: that of the last line."""
    score = (hmm.start if before is None else hmm.moves[before]) + shown[0]
    back = np.zeros((len(shown), STATES), np.int64)
    for i in range(1, len(shown)):
        total = score[:, None] + hmm.moves
        back[i] = total.argmax(axis=0)
        score = total[back[i], np.arange(STATES)] + shown[i]
    out = np.empty(len(shown), np.int64)
    out[-1] = score.argmax() if at_end is None else at_end
    for i in range(len(shown) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def follow(hmm: Hmm, first: np.ndarray, others: list[np.ndarray], places: list[np.ndarray] | None = None) -> list[tuple[int | None, int]]:
    """(state before, state at the end) of each block, from the first block's end scores and the others' matrices; ``places`` decide between equal paths."""
    scores = [first - first.max()]  # the differences matter: small numbers stay exact
    for m in others:
        score = (scores[-1][:, None] + m).max(axis=0)
        scores.append(score - score.max())
    ends = [int(scores[-1].argmax())]
    for k in range(len(others) - 1, -1, -1):
        total = scores[k] + others[k][:, ends[-1]]
        order = np.arange(STATES) if places is None else places[k][:, ends[-1]]
        ends.append(int(np.where(total == total.max(), order, STATES).argmin()))
    ends.reverse()
    return [(None if k == 0 else ends[k - 1], e) for k, e in enumerate(ends)]


def render(text: str, states: np.ndarray, begins: bool, goes_on: bool) -> tuple[str, list[str]]:
    """(canonical text, roles of its turns). A turn that began in an earlier row has no header, one that goes on no end."""
    out, roles = [], []
    for i, (line, state) in enumerate(zip(text.split("\n"), states.tolist(), strict=True)):
        if state % 2 == 0 or (i == 0 and begins):
            if i:
                out.append("<|end|>\n")
            roles.append(ROLES[state // 2])
            out.append(f"<|{roles[-1]}|>\n")
            line = line[found.end() :] if (found := _MARKED.match(line)) else line
        elif not roles:
            roles.append(ROLES[state // 2])
        out.append(line + "\n")
    if not goes_on:
        out.append("<|end|>\n")
    return "".join(out), roles


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows with equal keys from sorted batches; a group may span batches."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if batch.empty:
            continue
        changed = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for a, b in zip(changed, changed[1:]):
            yield tuple(batch.iloc[a][keys]), batch.iloc[a:b]
        held = batch.iloc[changed[-1] :]
    if held is not None:
        yield tuple(held.iloc[0][keys]), held


class _Parts:
    """Rows of whole parts: the columns, and where each part begins and ends."""

    def __init__(self, batch: pa.RecordBatch, bounds: list[tuple[int, int]]):
        self.batch, self.bounds = batch, bounds

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name)


def _whole_parts(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[_Parts]:
    """Sorted rows in which the first ``keys`` columns name the part; a part may span batches, and its rows come together."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
        if not batch.num_rows:
            continue
        names = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        begins = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
        last = begins[-1]
        if last:
            yield _Parts(batch.slice(0, last), list(itertools.pairwise(begins)))
        held = batch.slice(last)
    if held is not None and held.num_rows:
        yield _Parts(held, [(0, held.num_rows)])


_KEYS = ["_conv", "_block", "_part"]


def _laid_out(rows: DataFrame) -> DataFrame:
    """``conv, turn, text, others`` with the conversation's key, the block, its part, and the text's hash."""
    # Conversations without an id: one for each row.
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumns({"_conv": key, "_block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)), "_hash": F.xxhash64("text")})
    crowded = cut(rows.groupBy("_conv", "_block").count().where(F.col("count") > BLOCK).select("_conv", "_block"))
    if crowded.isEmpty():
        return rows.withColumn("_part", F.lit(0).cast("bigint"))
    # Positions in the whole order: that of each sorted range in front, then that within it. The row number spreads equal rows.
    order = ["_conv", "_block", "turn", "_hash", "_row"]
    hot = rows.join(crowded, ["_conv", "_block"], "left_semi").withColumn("_row", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = cut(hot.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row"))
    hot = hot.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = {r["_range"]: r["count"] for r in hot.groupBy("_range").count().collect()}
    starts = [sum(n for k, n in sizes.items() if k < i) for i in range(max(sizes) + 1)]
    position = F.get(F.lit(starts).cast("array<bigint>"), F.col("_range")) + F.col("_at")
    hot = hot.withColumn("_part", F.floor(position / BLOCK)).drop("_range", "_at")
    return rows.join(crowded, ["_conv", "_block"], "left_anti").withColumn("_part", F.lit(0).cast("bigint")).unionByName(hot)


def recover(turns: DataFrame, hmm: Hmm, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``turns`` without ``text``, with ``n_lines, roles, rendered``: the lines of each row and what they become."""
    spark = turns.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(hmm)
    kept = [c for c in turns.columns if c not in (text, "n_lines", "roles", "rendered")]
    # The other columns travel as one struct, which Arrow passes through as it is.
    others = F.struct(F.lit(True).alias("there"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)])
    laid = _laid_out(turns.select(quoted(conv).alias("conv"), quoted(turn).alias("turn"), text_or_empty(text).alias("text"), others.alias("others")))
    order = [*_KEYS, "turn", "_hash", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = lambda df: df.repartition(parts, *_KEYS).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    shown = lambda texts: [features(x, True) for x in texts]

    # First pass, for conversations of several blocks only.
    several = cut(laid.select(*_KEYS).distinct().groupBy("_conv").agg(F.count("*").alias("n"), F.min(F.struct("_block", "_part")).alias("first")).where("n > 1"))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, rows in _runs(batches, _KEYS):
            seen = model.value.emissions([f for fs in shown(rows["text"]) for f in fs])
            m, to, place = reduce_paths(model.value, seen)
            start = viterbi_scores(model.value, seen) if rows["_first"].iloc[0] else []
            yield pd.DataFrame({"_conv": [key[0]], "_block": [key[1]], "_part": [key[2]], "m": [m.ravel().tolist()], "to": [to.ravel().tolist()], "place": [place.ravel().tolist()], "start": [list(start)]})

    long_rows = laid.join(several.select("_conv", "first"), "_conv").withColumn("_first", F.struct("_block", "_part") == F.col("first"))
    blocks = sorted_rows(long_rows.select(*order, "_first")).mapInPandas(summarise, "_conv string, _block bigint, _part bigint, m array<double>, to array<tinyint>, place array<tinyint>, start array<double>")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _runs(batches, ["_conv"]):
            m, to, place = ([np.array(x).reshape(STATES, STATES) for x in rows[c].iloc[1:]] for c in ("m", "to", "place"))
            found = follow(model.value, np.array(rows["start"].iloc[0]), m, place)
            goes_on = [int(x[b, e] % 2) for x, (b, e) in zip(to, found[1:], strict=True)]
            yield rows[_KEYS].assign(before=[-1 if b is None else b for b, _ in found], at_end=[e for _, e in found], goes_on=[*goes_on, 0])

    known = blocks.repartition(parts, "_conv").sortWithinPartitions(*_KEYS).mapInPandas(chain, "_conv string, _block bigint, _part bigint, before int, at_end int, goes_on int")

    def decoded(texts: list[str], before: int | None, end: int | None, next_on: int | None) -> Iterator[tuple[int, str, list[str]]]:
        """(lines, rendered text, roles) of each row of a part."""
        lines = shown(texts)
        opens = before is None or before < 0
        states = viterbi(model.value, model.value.emissions([f for fs in lines for f in fs]), None if opens else before, end)
        at = 0
        for text_, fs in zip(texts, lines, strict=True):
            own, at = states[at : at + len(fs)], at + len(fs)
            goes_on = states[at] % 2 == 1 if at < len(states) else next_on == 1
            yield len(fs), *render(text_, own, opens and at == len(fs), goes_on)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_parts(batches, len(_KEYS)):
            texts, before, end, next_on = (table.column(c).to_pylist() for c in ("text", "before", "at_end", "goes_on"))
            made = [x for a, b in table.bounds for x in decoded(texts[a:b], before[a], end[a], next_on[a])]
            yield pa.RecordBatch.from_arrays(
                [table.column("others"), pa.array([n for n, _, _ in made], pa.int32()), pa.array([r for _, _, r in made], pa.list_(pa.string())), pa.array([t for _, t, _ in made], pa.string())],
                names=["others", "n_lines", "roles", "rendered"],
            )

    if several.isEmpty():
        placed = laid.withColumns({c: F.lit(None).cast("int") for c in ("before", "at_end", "goes_on")})
    else:
        placed = laid.join(known, _KEYS, "left")
    rows = sorted_rows(placed.select(*order, "others", "before", "at_end", "goes_on"))
    schema = T.StructType([rows.schema["others"], T.StructField("n_lines", T.IntegerType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("rendered", T.StringType())])
    out = rows.mapInArrow(decode, schema)
    return out.select(*[F.col("others")[f"c{i}"].alias(c) for i, c in enumerate(kept)], "n_lines", "roles", "rendered")


def viterbi_scores(hmm: Hmm, shown: np.ndarray) -> np.ndarray:
    """The best score of each state at the end of a transcript's first block."""
    score = hmm.start + shown[0]
    for row in shown[1:]:
        score = (score[:, None] + hmm.moves).max(axis=0) + row
    return score


def transcribe(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as plain transcripts show them, with the speaker markers of one of four styles.

    A hash of the conversation picks the style: full names, short names, letters, or no markers at all.
    Roles only choose the marker; the model sees the text.
    """
    style = F.pmod(F.xxhash64(F.col("conv_id").cast("string")), F.lit(4))
    names = {0: ("System", "User", "Assistant"), 1: ("Sys", "Human", "AI"), 2: ("System", "Q", "A")}
    mark = F.lit("")
    for k, words in names.items():
        for role, word in zip(ROLES, words, strict=True):
            mark = F.when((style == k) & (F.col("role") == role), F.lit(f"{word}: ")).otherwise(mark)
    return turns.select("conv_id", "turn", "role", F.concat(mark, text_or_empty("text")).alias("text"))


def train(turns: DataFrame, rows: int = TRAIN_TURNS) -> Hmm:
    """The model of a bounded sample of transcribed turns, none of them held out. Whole texts are counted, in executors; the counts are added up."""
    ship(turns.sparkSession)
    held_out = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % 4 == 2
    labelled = turns.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & ~held_out)
    labelled = labelled.select(F.col("conv_id").cast("string").alias("conv"), F.xxhash64("conv_id").alias("h"), "turn", "role", text_or_empty("text").alias("text"))
    order = ["h", "conv", F.col("turn").asc_nulls_first(), F.xxhash64("text"), "text"]
    sample = labelled.orderBy(*order).limit(rows)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = count_turns(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))))
        yield pa.RecordBatch.from_pydict({"counts": pa.array([found.tolist()], pa.list_(pa.float64()))})

    counted = sample.repartition(parts, "conv").sortWithinPartitions(*order).select("conv", "role", "text").mapInArrow(count, "counts array<double>")
    return fit(np.sum([r["counts"] for r in counted.collect()] or [[0.0] * sum(_SIZES)], axis=0))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = transcribe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = recover(turns, train(turns))
    return found.select("conv_id", "turn", F.col("role").alias("true_role"), "n_lines", F.array_join("roles", ",").alias("roles"), "rendered", F.sha2("rendered", 256).alias("rendered_sha256"))
