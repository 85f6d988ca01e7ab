import base64

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tessera.llm import bpe, packing, simhash


def test_pipeline_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if brute.kept(t)]
    rows = [rows[g[0]] for g in brute.exact_groups(rows).values()]
    prints = [int.from_bytes(simhash.long_prints(t)[8 * simhash.LONG :], "little") for _, t in rows]
    ids = brute.components(prints, [i for i, _ in rows], simhash.most_differing(simhash.SIMILARITY))
    rows = [(i, t) for (i, t), c in zip(rows, ids) if i == c]
    rows = [(i, brute.redacted(t, s)) for (i, t), s in zip(rows, brute.all_spans([t for _, t in rows]))]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.default_path(), "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    want = {i: len(encoding.encode(t, allowed_special="all")) + 1 for i, t in rows}
    found = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"]: r["length"] for r in found} == want and len(found) == len(want)
    ends = sorted(set(want.values()))
    counts = [sum(n == e for n in want.values()) for e in ends]
    assert sum(r["bucket_length"] for r in found) == brute.least_padded(ends, counts, packing.BUCKETS)


def test_stages_keep_columns_and_meet_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "word " * 60, "y"), (3, "a b c", None)]
    good = " ".join(f"word{i}" for i in range(80))
    rows += [(4, good, "x"), (5, good, "x"), (6, good + "  ", "x"), (6, good + "  ", "x"), (7, good + " password=abcdefgh12", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("digest", F.lit(1))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, k
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert [(r["doc_id"], r["text"]) for r in docs.collect()] == [(6, good + "  ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
