"""Array files that are cut anywhere."""

import json

import pytest

from corpuseval.sources import io

SCHEMA = "a string, b struct<c:array<struct<d:int>>>, e int"
ROWS = [
    {"a": "plain", "b": {"c": [{"d": 1}, {"d": 2}]}, "e": 1},
    {"a": 'quotes " and } and ] and \\ and \\" }]', "b": None, "e": 2},
    {"a": "é 日本 😀 }{", "b": {"c": []}, "e": None},
    {},
    {"a": "\\\\", "b": {"c": [{"d": None}]}, "e": 5},
    {"a": "}", "e": 6},
]


@pytest.fixture
def cut(spark):
    """Sets the size of splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def put(size):
        for n in names:
            spark.conf.set(n, size)

    yield put
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def test_arrays_are_the_same_wherever_they_are_cut(spark, tmp_path, cut):
    texts = {"one.json": json.dumps(ROWS, ensure_ascii=False), "two.json": "﻿ \n[\n" + ",\n".join(json.dumps(r, indent=1) for r in ROWS[::-1]) + "\n ]\n", "three.json": "[]", "four.json": " ", "five.json": json.dumps(ROWS[1])}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    paths = [str(tmp_path / n) for n in ("one.json", "two.json", "three.json", "five.json")]
    want = sorted(str(r) for r in spark.read.schema(SCHEMA).option("multiLine", True).json(paths).collect())
    assert len(want) == 2 * len(ROWS) + 1
    for size in ("150b",):
        cut(size)
        assert sorted(str(r) for r in io.read_json_array(spark, [*paths, str(tmp_path / "four.json")], SCHEMA).collect()) == want, size


def test_an_array_that_is_cut_at_every_byte(spark, tmp_path, cut):
    rows = [{"a": '\\"}é'}, {"e": 2}]
    (tmp_path / "all.json").write_text(json.dumps(rows, ensure_ascii=False, separators=(",", ":")), encoding="utf-8")
    for size in ("1b",):
        cut(size)
        got = io.read_json_array(spark, str(tmp_path / "all.json"), SCHEMA).collect()
        assert len(got) == 2 and {(r.a, r.e) for r in got} == {('\\"}é', None), (None, 2)}


def test_elements_that_are_no_objects_give_no_rows(spark, tmp_path):
    (tmp_path / "odd.json").write_text('[5, "x{", [{"e": 1}, "}"], {"e": 2}, null, {"e": 3}, [4]]')
    assert sorted(r.e for r in io.read_json_array(spark, str(tmp_path / "odd.json"), "e int").collect()) == [2, 3]
