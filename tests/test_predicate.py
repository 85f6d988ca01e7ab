import pytest

from tessera.plans.query import Dataset

ROWS = [("a", 5, True, "x1"), ("b", None, False, None), ("c", 9, None, "x2"), ("d", 5, True, "yx")]


@pytest.fixture(scope="module")
def data(spark):
    return Dataset(spark.createDataFrame(ROWS, "id string, n int, flag boolean, s string"), "id", ["id"])


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        ({}, "abcd"),
        ({"n": 5}, "ad"),
        ({"n": {"eq": 5}}, "ad"),
        ({"n": None}, "b"),
        ({"n": {"eq": None}}, "b"),
        ({"n": {"neq": 5}}, "bc"),
        ({"n": {"neq": None}}, "acd"),
        ({"n": "5"}, ""),
        ({"n": {"neq": "5"}}, "abcd"),
        ({"n": True}, ""),
        ({"n": {"gt": 5}}, "c"),
        ({"n": {"gte": 5, "lt": 9}}, "ad"),
        ({"n": {"lte": 5}}, "ad"),
        ({"s": {"gt": 1}}, ""),
        ({"n": {"in": [9, "5"]}}, "c"),
        ({"n": {"in": [9, None]}}, "bc"),
        ({"n": {"in": []}}, ""),
        ({"s": {"contains": "x"}}, "acd"),
        ({"s": {"contains": "%"}}, ""),
        ({"s": {"startsWith": "x"}}, "ac"),
        ({"s": {"endsWith": "x"}}, "d"),
        ({"n": {"contains": "5"}}, ""),
        ({"flag": True, "n": 5}, "ad"),
    ],
)
def test_conditions(data, where, ids):
    assert "".join(sorted(r["id"] for r in data.query({"where": where}).execute().collect())) == ids


@pytest.mark.parametrize(
    ("where", "error"),
    [
        ({"n": {"like": 1}}, ValueError),
        ({"nope": 1}, ValueError),
        ({"n": {"gt": "abc"}}, TypeError),
        ({"n": {"gt": None}}, TypeError),
        ({"n": [1, 2]}, TypeError),
        ({"n": {"in": "ab"}}, TypeError),
        ({"s": {"contains": 1}}, TypeError),
    ],
)
def test_malformed_conditions_raise(data, where, error):
    with pytest.raises(error):
        data.query({"where": where}).execute()


def test_nested_fields_are_rejected(spark):
    nested = Dataset(spark.createDataFrame([(1, [1])], "id int, xs array<int>"))
    with pytest.raises(TypeError):
        nested.query({"where": {"xs": 1}}).execute()


def test_typed_ranges_are_opt_in(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert Dataset(df, typed_ranges=True).query({"where": {"s": {"gte": "b"}}}).count() == 1


def test_sort_page_first_count_get(data):
    ids = lambda q: [r["id"] for r in q.execute().collect()]
    assert ids(data.query().order_by("n")) == ["a", "d", "c", "b"]
    assert ids(data.query().order_by("n", "desc")) == ["c", "a", "d", "b"]
    assert ids(data.query().order_by({"field": "n", "direction": "desc"}).offset(1).limit(2)) == ["a", "d"]
    assert ids(data.query().limit(0)) == []
    assert ids(data.query().offset(3)) == ["d"]
    assert ids(data.query().where({"n": 5}).where({"n": 9})) == ["c"]
    q = data.query().order_by("id").offset(1).limit(0)
    assert q.first()["id"] == "b" and q.count() == 4
    assert data.query({"where": {"n": 77}}).first() is None
    assert data.get("c")["n"] == 9 and data.get("zz") is None and data.get(3) is None
    assert data.count({"n": 5}) == 2
    for bad in (lambda: data.query().limit(-1), lambda: data.query().offset(True), lambda: data.query().order_by("zz"), lambda: data.query({"wher": {}})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        Dataset(data.df).get("a")


def test_plan_pushes_filters_and_prunes_columns(spark, tmp_path):
    spark.createDataFrame(ROWS, "id string, n int, flag boolean, s string").write.parquet(str(tmp_path / "t"))
    df = Dataset(spark.read.parquet(str(tmp_path / "t")), order=["id"]).query({"where": {"n": {"neq": 5}, "s": {"startsWith": "x"}}, "orderBy": "n", "limit": 3}).execute()
    plan = df.select("id", "n")._jdf.queryExecution().toString()
    assert "StringStartsWith(s,x)" in plan and "EqualNullSafe" in plan and "TakeOrderedAndProject" in plan and "flag" not in plan.split("ReadSchema")[1].split("\n")[0]
