import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import ODD, docs, random_docs
from tessera.llm import simhash


def edited_docs(n, seed):
    """(doc_id, text, base): texts, and copies of them with more and more words changed."""
    rng, out = random.Random(seed), []
    for base in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.5):
            changed = [f"x{rng.randrange(3000)}" if rng.random() < share else w for w in words]
            out.append((len(out), " ".join(changed), base))
    return out


def test_similar_texts_join_and_others_do_not(spark):
    rows = edited_docs(60, 3)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_memberships(docs(spark, [(i, t) for i, t, _ in rows])).collect()}
    assert len(found) == len(rows)
    alike = joined = 0
    for i, text, base in rows:
        for j, other, base_of_other in rows[:i]:
            if base != base_of_other:
                assert found[i] != found[j]
                continue
            if brute.cosine(text, other) >= simhash.SIMILARITY:
                alike, joined = alike + 1, joined + (found[i] == found[j])
    assert alike > 500 and joined >= 0.95 * alike
    least = {}
    for i, c in found.items():
        least.setdefault(c, []).append(i)
    assert all(c == min(ids) for c, ids in least.items())


def test_long_prints_estimate_the_angle():
    rows = edited_docs(40, 5)
    for i in range(0, len(rows), 7):
        for j in range(i + 1, i + 7):
            a, b = (np.frombuffer(simhash.long_prints(rows[k][1]), "<u8")[simhash.LONG :] for k in (i, j))
            share = np.arccos(min(1.0, brute.cosine(rows[i][1], rows[j][1]))) / np.pi
            assert abs(int(np.bitwise_count(a ^ b).sum()) - 512 * share) <= 60
    assert simhash.long_prints("") == bytes(128) and simhash.long_prints("One  TWO\n") == simhash.long_prints("one two") != simhash.long_prints("two one")


def test_odd_texts_and_exact_copies(spark):
    found = simhash.similar_memberships(docs(spark, ODD)).collect()
    named = {}
    for r in found:
        named.setdefault(r["text_hash"], set()).add(r["component_id"])
    assert len(found) == len(ODD) and all(len(ids) == 1 for ids in named.values())
    assert simhash.similar_memberships(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0
    out = simhash.keep_one(docs(spark, ODD))
    assert out.columns == docs(spark, ODD).columns and {r["doc_id"] for r in out.collect()} >= {1, 2, 8, 10}


def test_crowded_anchors_by_walking_and_finer_blocks(spark, monkeypatch):
    rows = [(i, t) for i, t, _ in edited_docs(25, 9)]
    read = lambda: sorted((r["doc_id"], r["component_id"]) for r in simhash.similar_memberships(docs(spark, rows, False)).collect())
    small = read()
    monkeypatch.setattr(simhash, "LARGE_ANCHOR", 2)
    assert read() == small


def test_finer_blocks_meet_as_well():
    texts = [t for _, t, _ in edited_docs(30, 11)]
    words = np.stack([np.frombuffer(simhash.long_prints(t), "<u8") for t in texts])
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if brute.cosine(texts[i], texts[j]) >= simhash.SIMILARITY]
    for n in (1000, 10**9):
        met = set()
        for even, odd, code in simhash.meeting_blocks(n):
            at, anchor = code.anchors(words[:, even] & np.uint64(simhash._EVEN) | words[:, odd] & np.uint64(simhash._EVEN << 1))
            key = dict(zip(at.tolist(), anchor.tolist(), strict=True))
            met |= {p for p in alike if key[p[0]] == key[p[1]]}
        assert len(met) >= 0.95 * len(alike)


def test_a_fingerprint_with_half_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 5)
    rows = [(i, " a  b" if i % 2 else f"text number {i} of some words that differ {i * i} {i + 1}") for i in range(300)] + random_docs(40, 3)
    rows += [(1000 + i, None) for i in range(50)]
    prints = [brute.fingerprint(t) for _, t in rows]
    want = sorted((str(i), str(c)) for (i, _), c in zip(rows, brute.components(prints, [i for i, _ in rows])))
    found = simhash.memberships(docs(spark, rows))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found.collect()) == want
    # The rows of one fingerprint stay dealt out: none of the tasks holds them all.
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 0.6 * len(rows)


def test_hubs_of_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    edges = [(0, i) for i in range(1, 200)] + [(500 + i, 501 + i) for i in range(30)] + [(900, 900 + i) for i in range(1, 50)] + [(949, 150)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in [*range(200), *range(900, 950)]) and all(found[500 + i] == 500 for i in range(31))
