import json
import random
import subprocess
import sys
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.cli import main, report, types_of
from tessera.operators import index as ix
from tessera.operators import layout, profile
from tessera.plans.codegen import generate
from tessera.plans.model import BuildConfig, Chunk, Field, FieldStats, Manifest, Schema, merge_types
from tessera.sources import loader
from tessera.sources.datasource import register
from tessera.sources.store import Store, build, export_json, vacuum
from tessera.streaming import ingest


def users(n=50):
    return [{"id": f"u{i:03}", "name": f"Name {i}", "age": 20 + i % 30, "city": ["Oslo", "Bonn", "Lyon"][i % 3], "active": i % 2 == 0, "createdAt": f"2024-03-{i % 28 + 1:02}"} for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(users(), "id string, name string, age bigint, city string, active boolean, createdAt string")


@pytest.fixture(scope="module")
def store(spark, frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    build(frame, path, "1kb", "id", ["city", "active"])
    return Store(spark, path)


def test_schema_and_choices(frame):
    rows, schema = profile.infer_schema(loader.with_ordinal(frame), loader.ORDINAL, frame.columns)
    assert rows == 50 and schema.primary == "id" and [f.name for f in schema.fields] == ["id", "active", "age", "city", "createdAt", "name"]
    assert {f.name: f.type for f in schema.fields} == {"id": "string", "active": "boolean", "age": "number", "city": "string", "createdAt": "date", "name": "string"}
    assert schema.indexed == ["active", "city"] and profile.suggest_chunk_field(schema, rows) == "id"
    assert schema.field("city").stats.samples == ["Oslo", "Bonn", "Lyon"] and schema.field("age").stats.min == 20


def test_nulls_dates_and_mixed(spark):
    df = spark.createDataFrame([("2024-01-01", None, "x"), ("2024-02-30", None, None)], "d string, e string, s string")
    fields = {f.name: f for f in profile.infer_schema(df)[1].fields}
    assert fields["d"].type == "string" and fields["e"].type == "null" and fields["e"].nullable and fields["s"].stats.null_count == 1
    good = spark.createDataFrame([("2024-01-01T10:00:00.000Z",), ("2024-01-02",), (None,)], "d string")
    assert profile.infer_schema(good)[1].fields[0].type == "date"
    assert (merge_types("null", "date"), merge_types("date", "string"), merge_types("number", "boolean"), merge_types("number", "number")) == ("date", "string", "string", "number")


def test_heuristics():
    f = lambda name, n, kind="string", samples=(): Field(name, kind, False, False, FieldStats(n, 0, None, None, list(samples)))
    assert [profile.worth_index(x, 1000) for x in (f("status", 1), f("status", 3), f("status", 501), f("big", 600), f("website_url", 5), f("content_type", 5), f("ok", 2, "boolean"), f("pic", 3, samples=["http://x"]))] == [
        False, True, False, False, False, True, True, False]
    assert profile.find_primary(5, [f("name", 5), f("width", 5), f("key", 5)]) == "width"
    assert profile.suggest_chunk_field(Schema([f("a", 10), f("created_date", 90, "date"), f("n", 100, "number")]), 100) == "created_date"
    assert layout.estimate_chunks(100, 30, 3) == 3 and layout.estimate_chunks(0, 30, 3) == 1


def test_cardinality_cap_switches_primary_off(spark):
    df = spark.range(30).withColumnRenamed("id", "row_id")
    assert profile.infer_schema(df, cap=20)[1].primary is None
    assert profile.infer_schema(df, cap=None)[1].primary == "row_id" and profile.infer_schema(df, cap=20, primary="row_id")[1].primary == "row_id"


def test_builds_find_a_primary_field_beyond_the_cap(spark, tmp_path):
    df = spark.range(30).select((F.col("id") % 29).alias("grid"), F.when(F.col("id") > 0, F.col("id")).alias("id_or_null"), F.col("id").alias("row_id"))
    assert profile.infer_schema(df, cap=20, whole=True)[1].primary == "row_id"
    assert profile.infer_schema(df.drop("row_id"), cap=20, whole=True)[1].primary is None and profile.infer_schema(df, cap=29, whole=True)[1].primary == "row_id"
    build(df, str(tmp_path / "s"), cap=20)
    store = Store(spark, str(tmp_path / "s"))
    assert store.get(7)["row_id"] == 7 and store.get(-5) is None


def greedy(sizes, target, rule):
    out, chunk, size = [], 0, 0
    for s in sizes:
        if rule == "before" and size and size + s > target:
            chunk, size = chunk + 1, 0
        out.append(chunk)
        size += s
        if rule == "after" and size >= target:
            chunk, size = chunk + 1, 0
    return out


@pytest.mark.parametrize("rule", ["before", "after"])
def test_fold_in_parts_is_the_sequential_fold(rule):
    rng = random.Random(5)
    for _ in range(300):
        target, sizes = rng.randint(1, 40), [rng.randint(1, 60 if rng.random() < 0.2 else 12) for _ in range(rng.randint(0, 60))]
        edges = sorted(rng.randint(0, len(sizes)) for _ in range(3))
        parts = [sizes[a:b] for a, b in zip([0, *edges], [*edges, len(sizes)])]
        got, open_size, chunks = [], 0, 0
        for part in parts:
            if not part:
                continue
            fold = layout.Fold(np.array(part), target, rule)
            started = np.zeros(len(part), int)
            started[fold.starts(open_size)] = 1
            got += (chunks - 1 + np.cumsum(started)).tolist()
            step = max((r for r in fold.table() if r[0] <= open_size), key=lambda r: r[0])
            assert step[2] == started.sum()
            open_size, chunks = step[1] + step[3] * open_size, chunks + step[2]
        assert got == greedy(sizes, target, rule)


def test_chunks_bounds_and_meta(store):
    chunks = store.manifest.chunks
    assert sum(c.count for c in chunks) == 50 == store.manifest.total and len(chunks) > 3
    assert all(c.byte_size <= 1024 + 2 or c.count == 1 for c in chunks) and [c.id for c in chunks] == list(range(len(chunks)))
    ids = []
    for c in chunks:
        rows = store.chunk(c.id).collect()
        assert len(rows) == c.count and c.ranges["age"] == (min(r["age"] for r in rows), max(r["age"] for r in rows)) and "active" not in c.ranges
        ids += [r["id"] for r in rows]
    assert ids == sorted(ids)
    with pytest.raises(KeyError):
        store.chunk(99)


def test_index_lookups(store):
    index = store.manifest.index
    assert set(index) == {"city", "active"} and set(index["active"]) == {"true", "false"}
    assert ix.find_value(index, "city", "Rome") == [] and ix.find_value(index, "age", 3) is None
    assert ix.find_conditions(index, {"city": "Oslo", "active": True, "age": 3}) == sorted(set(index["city"]["Oslo"]) & set(index["active"]["true"]))
    assert ix.find_conditions(index, {"age": 3}) is None
    assert ix.index_size({"a": {"é": [1]}}) == len('{"a":{"é":[1]}}')


def test_index_cap_nulls_and_odd_values(spark):
    df = spark.createDataFrame([(0, "constructor", 1.0), (1, None, 2.0), (1, "constructor", 1.0)], "chunk_id int, s string, d double")
    schema = Schema([Field("s", "string"), Field("d", "number")])
    assert ix.build_index(df, schema, ["s", "d", "zz"]) == {"s": {"constructor": [0, 1]}, "d": {"1": [0, 1], "2": [1]}}
    assert ix.build_index(df, schema, ["s", "d"], cap=1) == {"s": {"constructor": [0, 1]}}


def test_index_rows_has_every_value(spark):
    df = spark.range(12_000).select((F.col("id") % 7).cast("int").alias("chunk_id"), (F.col("id") / 8).alias("x"), (F.col("id") % 3).cast("string").alias("s"))
    rows = ix.index_rows(df, ["x", "s"])
    assert {r["field"]: r["count"] for r in rows.groupBy("field").count().collect()} == {"x": 12_000, "s": 3}
    index = ix.gather(rows, {"x": 1.5, "s": "1", "other": 1}, ["x", "s"])
    assert index == {"x": {"1.5": [12 % 7]}, "s": {"1": list(range(7))}} and ix.find_conditions(index, {"x": 1.5, "s": "1"}) == [12 % 7]
    assert ix.find_value(ix.gather(rows, {"x": -1}, ["x"]), "x", -1) == [] and ix.find_value(ix.gather(rows, {"s": 7}, ["x"]), "s", 7) is None


def test_get_count_cache(store):
    assert store.get("u007")["name"] == "Name 7" and store.get(7) is None and store.count() == 50
    assert store.count({"city": "Oslo"}) == 17 and store.query({"where": {"city": "Oslo"}, "limit": 2}).count() == 17
    assert [r["id"] for r in store.query().limit(3).execute().collect()] == ["u000", "u001", "u002"]
    store.cache()
    assert store.count({"active": False}) == 25
    store.clear_cache()
    assert store.get_schema().primary == "id"


def test_pruning_never_changes_results(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(20)]), rng.choice([None, "a", "b", "c"]), rng.random() * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, n int, s string, x double")
    path = str(tmp_path / "s")
    build(df, path, 700, "x", ["s", "n"])
    pruned, whole = Store(spark, path), Store(spark, path, pruning=False)
    for _ in range(25):
        where = {}
        for field, values in (("n", [*range(-1, 21), None, "5"]), ("s", ["a", "z", None, 3]), ("x", [0.0, 2.5, 5, 11])):
            op = rng.choice(["eq", "neq", "in", "none", "literal"] + (["gt", "gte", "lt", "lte"] if field != "s" else []))
            value = rng.choice(values)
            if op in ("gt", "gte", "lt", "lte") and not isinstance(value, (int, float)):
                continue
            if op != "none":
                where[field] = value if op == "literal" else {op: [value, rng.choice(values)] if op == "in" else value}
        got, want = ([tuple(r) for r in s.query({"where": where}).execute().orderBy("id").collect()] for s in (pruned, whole))
        assert got == want, where
    assert len(pruned.candidates({"x": {"gte": 9.5}})) < len(pruned.manifest.chunks) and pruned.candidates({"s": "zzz"}) == []


ODD_DOUBLES = [1e-4, 1e16, 99.0, -0.0, 0.1, 1.5e300, 2.0**53, 2.2250738585072014e-308, float("nan"), float("inf"), -12.25, None]


def test_pruning_odd_numbers_never_changes_results(spark, tmp_path):
    rng = random.Random(3)
    big = [2**53, 2**53 + 1, -(2**53) - 1, 2**62, 7, 0, None]
    money = [Decimal("10.00"), Decimal("0.10"), Decimal("1000000000000.01"), Decimal("0.00"), Decimal("-3.50"), None]
    rows = [(i, rng.choice(ODD_DOUBLES), rng.choice(money), rng.choice(big), rng.choice([0.1, 2.5, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, d double, m decimal(20,2), b bigint, f float")
    for chunk_by in ("d", "m", "b"):
        path = str(tmp_path / chunk_by)
        build(df, path, 700, chunk_by, ["d", "m", "b", "f"])
        pruned, whole = Store(spark, path), Store(spark, path, pruning=False)
        pools = {"d": [*ODD_DOUBLES, 99, 1, Decimal("0.1")], "m": [*money, 10, 10.0, 0.1, Decimal("10"), Decimal("1E+1")], "b": [*big, float(2**53), 7.0], "f": [0.1, 2.5, float(np.float32(0.1))]}
        for _ in range(15):
            field = rng.choice(list(pools))
            op = rng.choice(["eq", "in", "gt", "gte", "lt", "lte"])
            value = rng.choice(pools[field])
            if value is None and op not in ("eq", "in"):
                continue
            where = {field: {op: [value, rng.choice(pools[field])] if op == "in" else value}}
            got, want = (sorted(r["id"] for r in s.query({"where": where}).execute().collect()) for s in (pruned, whole))
            assert got == want, (chunk_by, where)
    assert Store(spark, str(tmp_path / "d")).count({"d": 1e-4}) == sum(r[1] == 1e-4 for r in rows) > 0
    assert ix.find_value(pruned.manifest.index, "m", Decimal("10")) == ix.find_value(pruned.manifest.index, "m", 10.0) != []


def test_manifest_keeps_types():
    ranges = {"m": (Decimal("1.50"), Decimal("2")), "t": (datetime(2024, 1, 2, 3, 4, 5, 678), datetime(2025, 1, 1)), "d": (date(2024, 1, 2), date(2024, 2, 2)), "n": (2**62, float("inf"))}
    manifest = Manifest(Schema([Field("m", "number", stats=FieldStats(min=Decimal("1.50")))]), [Chunk(0, 1, 2, ranges)], ix.Index({"m": {"1.5": [0]}}), 1, BuildConfig())
    assert Manifest.from_json(manifest.to_json()) == manifest


def test_lists_prune_as_the_manifest_does(spark, frame, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice(ODD_DOUBLES), rng.choice([None, *range(12)]), rng.choice([None, "a", "b", "c"]), rng.random() < 0.5) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, `d.x` double, n bigint, s string, b boolean")
    inline, listed = str(tmp_path / "inline"), str(tmp_path / "listed")
    build(df, inline, 700, "n", ["n", "s", "b", "d.x"])
    monkeypatch.setattr("tessera.sources.store.INLINE", 2)
    manifest = build(df, listed, 700, "n", ["n", "s", "b", "d.x"])
    one, two = Store(spark, inline), Store(spark, listed)
    assert not manifest.chunks and not manifest.index and len(manifest.lists) == 1 and two.manifest.n_chunks == one.manifest.n_chunks > 5 and two.count() == 240
    for where in ({"n": 3}, {"n": {"gte": 4, "lt": 9}}, {"n": {"in": [1, 7]}, "s": "b"}, {"s": "zz"}, {"d.x": 1e-4}, {"d.x": {"gt": 90}}, {"d.x": float("nan")}, {"b": True, "n": 2}, {"n": None}, {"d.x": {"in": [0.0, -12.25]}}, {}):
        assert set(two.candidates(where)) >= set(one.candidates(where)), where
        got, want = (sorted(r["id"] for r in x.query({"where": where}).execute().collect()) for x in (two, one))
        assert got == want, where
    assert [r["id"] for r in two.chunk(3).collect()] == [r["id"] for r in one.chunk(3).collect()] and len(two.candidates({"n": 3})) < two.manifest.n_chunks
    two.cache()
    assert two.count({"n": 3}) == one.count({"n": 3})
    two.clear_cache()
    assert vacuum(spark, listed) == []


def test_a_manifest_that_outgrows_itself(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    build(frame.where("age < 40"), path, "1kb", "id", ["city"])
    small = Store(spark, path).manifest
    assert small.chunks and not small.lists
    monkeypatch.setattr("tessera.sources.store.INLINE", len(small.chunks))
    ingest.append(path, frame.where("age >= 40"), "x", 1)
    store = Store(spark, path)
    assert len(store.manifest.lists) == 2 and not store.manifest.chunks and store.count() == store.query().execute().count() == 50
    assert store.count({"city": "Oslo"}) == 17 and store.count({"age": {"gte": 45}}) == sum(u["age"] >= 45 for u in users()) and len(store.candidates({"age": {"gte": 45}})) < store.manifest.n_chunks
    monkeypatch.setattr(ix, "INDEX_CAP", 4)
    ingest.append(path, spark.createDataFrame([{**u, "city": f"c{i}"} for i, u in enumerate(users(9))], frame.schema), "x", 2)
    again = Store(spark, path)
    assert again.manifest.config.indexed == [] and again.count({"city": "Oslo"}) == 17 and again.count({"city": "c3"}) == 1


def test_only_what_the_manifest_names_is_read(spark, frame, tmp_path):
    path = str(tmp_path / "s")
    build(frame.where("age < 40"), path, "1kb", "id", ["city"])
    frame.write.parquet(f"{path}/data/left-behind")
    late = frame.where("age >= 40")
    first = Store(spark, path)
    assert first.query().execute().count() == first.count() == 40
    for _ in range(2):
        ingest.append(path, late, "stream", 4)
    ingest.append(path, late, "stream", 3)
    again = Store(spark, path)
    assert again.query().execute().count() == again.count() == 50 and first.count() == 40
    assert vacuum(spark, path) == ["left-behind"] and Store(spark, path).query().execute().count() == 50
    build(frame, path, "1kb", "id", ["city"])
    assert Store(spark, path).query().execute().count() == 50 and len(vacuum(spark, path)) == 2


def test_append_widens_bounds_and_types(spark, tmp_path):
    path = str(tmp_path / "s")
    build(spark.createDataFrame([("b", "2024-01-01", 5.0), ("c", "2024-01-02", 6.0)], "s string, d string, x double"), path, "1kb", "s", [])
    m = ingest.append(path, spark.createDataFrame([("a", "no date", None), ("é", None, -1.0)], "s string, d string, x double"))
    fields = {f.name: f for f in Manifest.from_json(m.to_json()).schema.fields}
    assert (fields["s"].stats.min, fields["s"].stats.max) == ("a", "é") and (fields["x"].stats.min, fields["x"].stats.max) == (-1.0, 6.0)
    assert fields["d"].type == "string" and fields["x"].nullable and not fields["s"].nullable
    assert Store(spark, path).count({"x": {"lt": 0}}) == 1


def test_unsteady_input_is_pinned(spark, tmp_path):
    steady = Store(spark, _built(spark, tmp_path)).rows
    assert layout.stable(loader.with_ordinal(steady).where("id > 3")).inputFiles()
    shuffled = loader.with_ordinal(steady.repartition(3))
    pinned = layout.stable(shuffled)
    assert pinned is not shuffled and not pinned.inputFiles()
    build(steady.repartition(5).select("id"), str(tmp_path / "again"), 100, "id", [])
    assert sorted(r["id"] for r in Store(spark, str(tmp_path / "again")).query().execute().collect()) == list(range(60))


def _built(spark, tmp_path):
    build(spark.range(60).toDF("id"), str(tmp_path / "built"), 100, "id", [])
    return str(tmp_path / "built")


def test_chunks_are_kept_after_reading(store, monkeypatch):
    monkeypatch.setattr("tessera.sources.store.MEMO", 2)
    store.clear_cache()
    one = store.chunk(0)
    assert store.chunk(0) is one
    store.chunk(1), store.chunk(2)
    assert list(store._memo) == [1, 2] and store.chunk(0) is not one
    store.clear_cache()
    assert not store._memo


def test_many_candidates_are_joined(spark, store, monkeypatch):
    monkeypatch.setattr("tessera.sources.store.STRETCHES", 0)
    assert store.query({"where": {"age": {"lt": 30}, "id": {"in": ["u001", "u002"]}}}).count() == 2


def test_append_and_ingest(spark, frame, tmp_path):
    base = str(tmp_path)
    for turn in range(2):
        frame.where((F.substring("id", 4, 1).cast("int") % 2) == turn).coalesce(1).write.mode("append").parquet(f"{base}/in")
        ingest.ingest(spark, f"{base}/in", "parquet", frame.schema, f"{base}/store", f"{base}/ck", chunk_size="1kb", chunk_by="id", indexed=["city"])
    s = Store(spark, f"{base}/store")
    assert s.count() == 50 and sorted(r["id"] for r in s.query().execute().collect()) == [u["id"] for u in users()]
    assert s.count({"city": "Bonn"}) == 17 and [c.id for c in s.manifest.chunks] == list(range(len(s.manifest.chunks)))


def test_json_export_and_source(spark, frame, store, tmp_path):
    out = str(tmp_path / "json")
    export_json(store, out)
    assert json.loads((next((tmp_path / "json" / "chunk_id=0").glob("part-*"))).read_text())[0]["id"] == "u000"
    register(spark)
    df = spark.read.format("chunked_json").schema(frame.schema).option("manifest", f"{store.path}/manifest.json").load(out)
    assert df.count() == 50 and df.where("age < 25 and city = 'Oslo'").count() == len([u for u in users() if u["age"] < 25 and u["city"] == "Oslo"])


def test_codegen_is_python(frame, store):
    text = generate(profile.infer_schema(loader.with_ordinal(frame), loader.ORDINAL, frame.columns)[1])
    space: dict = {}
    exec(text, space)
    client = space["Client"](store.spark, store.path)
    assert client.get("u007")["name"] == "Name 7" and client.get("zz") is None and client.count({"city": "Oslo"}) == 17 and client.first({"age": {"gt": 47}})["age"] > 47
    assert [r["id"] for r in client.find({"city": "Oslo"}, "age", "desc", limit=2, offset=1).collect()] and client.query({"city": "Bonn"}).count() == 17
    assert space["PRIMARY"] == "id" and set(space["Item"].__annotations__) == set(frame.columns) and "'active': 'bool'" in text and "active" not in text.split("SortableField")[1].split("PRIMARY")[0]
    with pytest.raises(ValueError):
        generate(Schema([]), "class")


def test_cli(spark, tmp_path, capsys):
    path = tmp_path / "users.json"
    path.write_text(json.dumps([{k: v for k, v in u.items() if k != "name" or i % 2} for i, u in enumerate(users())]))
    assert main(["build", str(path), "-o", str(tmp_path / "out"), "-s", "1kb"], spark) == 0
    assert "50 records" in capsys.readouterr().out and Store(spark, str(tmp_path / "out")).manifest.config.chunk_by == "id"
    assert "primary: id" in report(spark, str(path)) and "about" in report(spark, str(path), fast=True)
    assert "TypedDict" in types_of(spark, str(path))
    assert main(["types", str(path), "-o", str(tmp_path / "t.py")], spark) == 0 and (tmp_path / "t.py").exists()
    assert main(["inspect", str(tmp_path / "none")], spark) == 1 and main(["build", str(path), "-o", str(tmp_path / "o2"), "-s", "zz"], spark) == 1
    empty = tmp_path / "e.json"
    empty.write_text("[]")
    assert main(["build", str(empty), "-o", str(tmp_path / "o3")], spark) == 1


def test_library_does_not_import_the_optional_subpackage():
    code = "import sys, tessera.cli, tessera.plans.catalog; sys.exit(any(m.startswith('tessera.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], check=False, cwd=str(__import__("pathlib").Path(__file__).parent.parent)).returncode == 0
