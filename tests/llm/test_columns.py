"""Columns of every type pass through the operators that return rows, whatever their names."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tessera.llm import bpe, chat, classifier, exact_dedup, packing, quality_rules, secrets, sharding, simhash

GOOD = " ".join(f"word{i}" for i in range(80))
WHEN, PRICE = dt.datetime(2024, 5, 6, 7, 8, 9, 123456), Decimal("12345678901234567890.125")
TEXTS = [(1, GOOD), (2, GOOD + " end"), (3, None), (4, ""), (None, GOOD), (1, GOOD), (5, " " * 30_000 + GOOD), (6, GOOD * 200), (7, "password=abcdefgh12 " + GOOD)]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("when", T.TimestampType()),
        T.StructField("price", T.DecimalType(38, 3)),
        T.StructField("tags", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("parts", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType())]))),
        T.StructField("_t_text", T.ByteType()),
        T.StructField("a.b`c", T.DateType()),
        T.StructField("_T_text_hash", T.BinaryType()),
        T.StructField("void", T.LongType()),
    ]
)
EXTRA = (WHEN, PRICE, {"k": 1, "l": None}, [(1,), (None,)], 7, dt.date(2024, 1, 2), bytearray(b"\x00\xff"), None)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in TEXTS], SCHEMA)


def extras(rows, names):
    return [tuple(r[n] for n in names) for r in rows]


def check(out, n=None):
    names = SCHEMA.names[2:]
    rows = out.collect()
    want = tuple([tuple(p) for p in x] if isinstance(x, list) else x for x in EXTRA)
    assert all(tuple([tuple(p) for p in x] if isinstance(x, list) else x for x in got) == want for got in extras(rows, names))
    assert n is None or len(rows) == n
    assert [f.dataType for f in out.schema.fields if f.name in names] == [SCHEMA[x].dataType for x in names]


def test_operators_that_keep_rows(spark, table):
    everything = len(TEXTS)
    check(classifier.score(table, classifier.Model(b"good words here", b"bad words there", 1024, (0.1, 1.0, 0.5))), everything)
    check(quality_rules.judge(table), everything)
    check(quality_rules.keep_good(table))
    check(simhash.keep_one(table))
    check(simhash.keep_one(table, similarity=None))
    check(secrets.scan(table), everything)
    check(secrets.redact(table), everything)
    check(bpe.count_tokens(table, bpe.default_path()), everything)
    check(bpe.decode(bpe.encode(table, bpe.default_path()), bpe.default_path()), everything)
    index = exact_dedup.DigestIndex(spark, "columns_index", 2)
    check(exact_dedup.deduplicate(table, index), 5)
    index.drop()
    assert sharding.assign(table, F.lit(3)).count() == everything
    check(packing.pack(table.withColumn("length", F.lit(5)), "length", "doc_id"), everything)


def test_chat_keeps_columns(spark, table):
    turns = table.withColumns({"conv_id": F.lit(3), "turn": F.col("doc_id"), "role": F.lit("user")})
    check(chat.recover(turns, chat.train(chat.transcribe(turns))), len(TEXTS))


def test_stages_keep_columns(spark, table):
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        check(docs)
        assert docs.columns == table.columns, name
