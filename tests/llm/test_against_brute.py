"""Queries without SQL against plain Python versions."""

import math
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tests.llm import brute
from tessera.llm import chat, classifier


def test_op2_scores(spark, small):
    folder = small.replace("sf0.001", "sf0.01")  # 200 documents are too few labels to learn from
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in classifier.op2_quality(spark, folder).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        good, bad = (sum(len(p.compress(raw[i : i + model.piece])) for i in range(0, len(raw), model.piece)) for p in packers)
        z = 20 * (bad - good) / max(1, len(raw))
        score = 1 / (1 + math.exp(-np.clip(model.weights[0] + model.weights[1] * z + model.weights[2] * z * math.log1p(len(raw)) / 8, -30, 30)))
        assert abs(r["score"] - score) < 1e-9 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_the_piece_is_chosen_inside_the_training_rows(spark, small):
    """Whole texts train, the piece length is the one with the least log loss, and only drawn rows matter."""
    folder = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    assert model.piece in classifier.PIECES
    drawn = {r["text"] for r in classifier.training_rows(docs, labels).collect()}
    assert drawn <= {r["text"] for r in docs.collect()} and max(map(len, drawn)) > 4096
    keys = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2
    emptied = docs.withColumn("text", F.when(keys, F.lit("held out")).otherwise(F.col("text")))
    assert classifier.fit(emptied, labels) == model


def test_op7_conversations(spark, small):
    turns = chat.transcribe(spark.read.parquet(f"{small}/conversations.parquet"))
    hmm = chat.train(turns)
    rows = [(r["conv_id"], r["turn"], r["text"]) for r in turns.collect()]
    want = brute.conversations(rows, hmm, chat.features)
    found = {(r["conv_id"], r["turn"]): (r["n_lines"], r["roles"], r["rendered"]) for r in chat.op7_chat(spark, small).collect()}
    assert len(found) == len(rows) and found == want
    assert any("," in roles or n > 1 for n, roles, _ in want.values())


def test_op7_counts(spark, small):
    """The model's tables are the counts of the labelled turns that are not held out."""
    turns = chat.transcribe(spark.read.parquet(f"{small}/conversations.parquet"))
    kept = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect() if zlib.crc32(str(r["conv_id"]).encode()) % 4 != 2 and r["role"] in chat.ROLES)
    start = {}
    for conv, _, role, _ in kept:
        start.setdefault(conv, role)
    counts = np.array([sum(r == role for r in start.values()) for role in chat.ROLES]) + chat.SMOOTHING
    model = np.exp(chat.train(turns).start[::2])
    assert np.allclose(model, counts / counts.sum(), atol=1e-4)
