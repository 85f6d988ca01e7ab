import json

import pytest

from tessera.functions.text import format_bytes, parse_size, python_text, row_size, shorten, streaming_row_size
from tessera.sources import loader


@pytest.mark.parametrize(("text", "size"), [("10", 10), ("10b", 10), ("1kb", 1024), ("1.5 KB", 1536), ("5mb", 5 << 20), ("2GB", 2 << 30)])
def test_parse_size(text, size):
    assert parse_size(text) == size


@pytest.mark.parametrize("text", ["", "mb", "5tb", "-1kb", "1 2"])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        parse_size(text)


def test_small_helpers():
    assert (format_bytes(512), format_bytes(1536), shorten("x" * 40)) == ("512 B", "1.5 KB", "x" * 27 + "...")
    assert (python_text(True), python_text("3.0")) == ("true", "3.0")


def test_formats_and_errors(spark, tmp_path):
    array, lines, table, lone = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.csv", tmp_path / "d.txt"
    array.write_text(json.dumps([{"id": 1, "n": {"x": 1}}, {"id": 2}]))
    lines.write_text('{"id": 1}\n\n  {"id": 2, "s": null}\n')
    table.write_text("id,name\n1,a\n2,\n\n")
    lone.write_text('{"id": 1}')
    assert [loader.detect_format(spark, str(p)) for p in (array, lines, table, lone)] == ["json", "ndjson", "csv", "json"]
    assert loader.load(spark, str(array)).count() == 2 and loader.load(spark, str(lines)).count() == 2
    assert [r["id"] for r in loader.load(spark, str(table)).collect()] == [1, 2]
    assert loader.field_order(spark, str(array), "json") == ["id", "n"]
    with pytest.raises(ValueError):
        loader.load(spark, str(lone))
    with pytest.raises(ValueError):
        loader.load(spark, str(array), "xml")
    with pytest.raises(FileNotFoundError):
        loader.load(spark, str(tmp_path / "none.json"))
    broken = tmp_path / "e.ndjson"
    broken.write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(ValueError, match="line 2 is no JSON object"):
        loader.load(spark, str(broken)).collect()
    assert loader.file_size(spark, str(array)) == array.stat().st_size


def test_row_sizes_follow_json_text(spark):
    rows = [{"d": 99.0, "i": 1, "s": 'é"😀', "b": True}, {"d": None, "i": None, "s": None, "b": None}, {"d": 1.5, "i": 10, "s": "", "b": False}]
    df = spark.createDataFrame(rows, "b boolean, d double, i bigint, s string")
    order = lambda r: {k: (int(v) if isinstance(v, float) and v.is_integer() else v) for k, v in sorted(r.items())}
    want = [len(json.dumps(order(r), separators=(",", ":"), ensure_ascii=False).encode("utf-16-le")) // 2 for r in rows]
    assert [r[0] for r in df.select(row_size(df)).collect()] == want
    estimate = [2 + (1 + 3) * 4 + 4 + 2 + 1 + 2 + 4, 2 + 16 + 16, 2 + 16 + 5 + 3 + 2 + 2]
    assert [r[0] for r in df.select(streaming_row_size(df)).collect()] == estimate


def test_json_arrays_become_lines(spark, tmp_path):
    records = [{"id": i, "s": 'a,"b]}é😀' * (i % 4), "n": {"x": [1, 2, {"y": None}]}} for i in range(500)] + [{"id": 500, "s": "long" * 5000, "n": None}]
    for k, text in enumerate((json.dumps(records), "\ufeff" + json.dumps(records, indent=1, ensure_ascii=False), " [ ] ")):
        path = tmp_path / f"{k}.json"
        path.write_text(text, encoding="utf-8")
        want = records if k < 2 else []
        for piece in (7, 1000, 1 << 20):
            assert [json.loads(x) for x in loader.array_records(str(path), piece)] == want
    assert [json.loads(x) for x in loader.array_records(f"file://{tmp_path}/0.json")] == records
    loader.convert_json_array(spark, str(tmp_path / "0.json"), str(tmp_path / "lines"), per_file=100)
    assert len(list((tmp_path / "lines").glob("part-*"))) == 6
    assert sorted(r["id"] for r in loader.load(spark, str(tmp_path / "lines"), "ndjson").select("id").collect()) == list(range(501))
    for broken in ("[1, 2", '{"a": 1}', '[{"a": ]', ""):
        path.write_text(broken)
        with pytest.raises(ValueError):
            list(loader.array_records(str(path)))
    assert [json.loads(x) for x in loader.array_records(_written(tmp_path, "[1, 23, 4.5, true, null]"), 2)] == [1, 23, 4.5, True, None]


def _written(folder, text):
    (folder / "some.json").write_text(text)
    return str(folder / "some.json")
