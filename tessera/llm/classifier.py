"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from text labelled good and one from text labelled bad. A
text is compressed with each, in whole, piece by piece (so that a long text can't teach the compressor its own
style), and the difference of the sizes per byte says which dictionary it is closer to. A logistic curve,
fitted on labelled texts that did not go into the dictionaries, turns that into a probability of label 1. Texts
of short length carry little evidence, so the curve is given the difference alone and the difference weighted
by length. Of the lengths in ``PIECES``, the fit takes the one whose curve predicts these texts best, each by a
curve fitted on the others (least log loss over ``CHECKS`` parts); nothing outside the training rows has a say.

Bound: at most ``TRAIN_ROWS`` labelled rows of each label are drawn, by hash of doc_id over all labels, with
their whole texts. Only the text and the label are used. The dictionaries are trained on the driver, so two
thirds of these rows' texts must fit there; of the others only numbers reach it. Dictionaries and coefficients
are all that is broadcast; their size is fixed.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: they never reach the fit.

Defined cases: a null text counts as empty; the difference of an empty text is 0, so its score is the
curve's value there. Texts of any length are compressed whole, one piece at a time. A null doc_id is not held
out. Labels other than 0 and 1 are ignored, as are doc_ids with both. Of rows that share a labelled doc_id the
least text trains. Without labels of both kinds every score is 0.5. Equal texts get equal scores. Columns named
like the result are replaced; others keep their names and values. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, documents, fresh, quoted, ship, text_or_empty

TRAIN_ROWS = 3000  # of each label
DICTIONARY = 112 << 10  # bytes
LEVEL = 3
PIECES = (512, 1024, 4096, 16384)  # bytes
CHECKS = 5
CUT = 0.7  # least score predicted 1
FOLDS, HELD_OUT = 4, 2


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo FOLDS; null for a null key."""
    return F.crc32(F.encode(quoted(key).cast("string"), "utf-8")) % FOLDS


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    piece: int
    weights: tuple[float, float, float]


class Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for raw in (good, bad):
            prepared = zstandard.ZstdCompressionDict(raw)
            prepared.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str, length: int) -> tuple[float, int]:
        """((bad - good) / bytes, bytes): above 0 for text closer to the good dictionary. ``length``: bytes of a piece."""
        raw = text.encode("utf-8", "surrogatepass")
        good = bad = 0
        for i in range(0, len(raw), length):
            piece = raw[i : i + length]
            good += len(self.compressors[0].compress(piece))
            bad += len(self.compressors[1].compress(piece))
        return (bad - good) / max(1, len(raw)), len(raw)


def _features(found: Sequence[tuple[float, int]]) -> np.ndarray:
    """Of each (difference, bytes)."""
    z, n = np.array([x for x, _ in found], float), np.array([n for _, n in found], float)
    return np.stack([np.ones(len(z)), 20 * z, 20 * z * np.log1p(n) / 8], axis=1).reshape(-1, 3)


def _curve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = _curve(x, w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    """The mean log loss of each part of the rows under the curve of the others."""
    out = []
    for part in range(CHECKS):
        own = np.arange(len(y)) % CHECKS == part
        p = np.clip(_curve(x[own], _logistic(x[~own], y[~own])), 1e-9, 1 - 1e-9)
        out += (-(y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p))).tolist()
    return float(np.mean(out))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """``h, y, text`` of the drawn rows, at most ``rows`` of each label, none of them held out."""
    clean = (
        labels.where(quoted(label).isin(0, 1) & (fold(key) != HELD_OUT))
        .groupBy(quoted(key).alias("k"))
        .agg(F.min(quoted(label)).alias("y"), F.max(quoted(label)).alias("y2"))
        .where("y = y2")
        .select("k", F.col("y").cast("int").alias("y"), F.xxhash64(F.col("k").cast("string")).alias("h"))
    )
    drawn = None
    for y in (0, 1):
        some = clean.where(F.col("y") == y).orderBy("h", "k").limit(rows)
        drawn = some if drawn is None else drawn.unionByName(some)
    # At most 2 * rows keys are broadcast. Copies of a doc_id count once.
    found = docs.select(quoted(key).alias("k"), text_or_empty(text).alias("text")).join(F.broadcast(drawn), "k")
    return found.groupBy("k").agg(F.min("h").alias("h"), F.min("y").alias("y"), F.min("text").alias("text")).where("text != ''").select("h", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Model | None:
    """The model, or None without text of both labels. Two thirds of the rows go into the dictionaries, the others into the curve."""
    spark = docs.sparkSession
    ship(spark)
    drawn = cut(training_rows(docs, labels, text, key, label, rows).withColumn("into", F.pmod(F.xxhash64("h"), F.lit(3)) != 0))
    samples = drawn.where("into").select("h", "y", "text").toPandas().sort_values(["h", "text"])
    dictionaries = [_dictionary([x.encode("utf-8", "surrogatepass") for x in samples["text"][samples["y"] == y]]) for y in (1, 0)]
    held = spark.sparkContext.broadcast(tuple(dictionaries))

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(*held.value)
        for texts in batches:
            yield pd.Series([[v for piece in PIECES for v in sizes.difference(x, piece)] for x in texts], dtype=object)

    measured = drawn.where("not into").select("h", "y", F.pandas_udf(measure, "array<double>")("text").alias("m")).toPandas().sort_values("h")
    y = measured["y"].to_numpy(float)
    if not all(dictionaries) or len(set(y)) < 2:
        return None
    m = np.stack(measured["m"].to_list()).reshape(len(y), len(PIECES), 2)
    found = {piece: _features(m[:, i]) for i, piece in enumerate(PIECES)}
    piece = min(PIECES, key=lambda p: _loss(found[p], y))
    return Model(*dictionaries, piece, tuple(_logistic(found[piece], y).tolist()))


def _dictionary(samples: list[bytes]) -> bytes:
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text serves as it is
        return b"".join(samples)[-DICTIONARY:].rjust(8, b" ")


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of its texts, without the texts."""
    plain = [c for c in df.columns if c not in (text, out)]
    if model is None:
        return df.select(*[quoted(c) for c in plain], F.lit(0.5).alias(out))
    ship(df.sparkSession)
    t = fresh(df, "text")[0]
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(held.value.good, held.value.bad)
        for texts in batches:
            yield pd.Series(_curve(_features([sizes.difference(x, held.value.piece) for x in texts]), np.array(held.value.weights)))

    udf = F.pandas_udf(run, T.DoubleType())
    return df.select(*[quoted(c) for c in plain], text_or_empty(text).alias(t)).withColumn(out, udf(t)).drop(t)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
