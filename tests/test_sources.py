import json
import os

import pytest
from pyspark.sql import functions as F

from paramlens.plans import dims
from paramlens.sources import rows as sources
from paramlens.streaming import tail

LINES = [
    '{"a": 1, "b": null, "c": {"d": {"e": "x"}}, "s": ["p", "q"], "v": [1, 2.5], "t": true}',
    "",
    '{"a": 2.5, "c": {"d": {"e": "y"}}, "s": [], "v": [3, 4], "m": {"z": 1, "a": [true]}}',
    "[1]",
    "{broken",
    '{"a": "text", "b": 4, "big": 1152921504606846976}',
]


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(LINES) + "\n")
    parsed = sources.json_lines(spark, str(tmp_path / "r.jsonl"))
    assert sources.bad(parsed).count() == 2 and sources.bad(parsed).first()["bad"] == 2
    kinds = {r["name"]: (r["kind"], r["rows"], r["nulls"]) for r in sources.fields_of(parsed).collect()}
    assert kinds["a"] == ("json", 3, 0) and kinds["b"] == ("num", 2, 1) and kinds["c.d.e"][0] == "str" and kinds["v.1"][0] == "num"
    assert kinds["s"][0] == "set" and kinds["m.z"][0] == "num" and kinds["m.a"][0] == "json" and kinds["big"][0] == "json"
    got = sources.typed(parsed).orderBy("__line").collect()
    assert [r["b"] for r in got] == [None, None, 4.0] and ["b" in r["__present"] for r in got] == [True, False, True]
    assert got[0]["s"] == ["p", "q"] and got[1]["s"] == [] and got[2]["s"] is None and got[0]["v_1"] == 2.5 and got[0]["t"] is True
    assert [json.loads(r["a"]) for r in got] == [1.0, 2.5, "text"] and got[2]["big"] == "1152921504606846976"


def test_row_object():
    assert sources.row_object({"a.b": 1, "a.c.0": 2, "a.c.1": 3, "d": None}) == {"a": {"b": 1, "c": [2, 3]}, "d": None}


def test_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b,c,d\n1,True,"x\ny",\n2.5,False,"q ""z""",3\n,,,4\n7,True\n')
    out = sources.csv(spark, str(tmp_path / "r.csv"))
    good = out.where(F.col("__bad").isNull()).collect()
    assert dict(out.dtypes)["a"] == "double" and dict(out.dtypes)["b"] == "boolean"
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in good] == [(1.0, True, "x\ny", None), (2.5, False, 'q "z"', 3.0), (None, None, None, 4.0)]
    assert len(out.where(F.col("__bad").isNotNull()).collect()) == 1


def test_shards_and_last_write(spark):
    a = spark.createDataFrame([(0, 1.0), (2, 2.0)], "i long, x double")
    b = spark.createDataFrame([(1, "n"), (2, "m")], "i long, y string")
    assert [(r["i"], r["__shard_index"]) for r in sources.interleaved([a, b], "i").collect()] == [(0, 0), (1, 1), (2, 0), (2, 1)]
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k long, at long, v string")
    assert {r["k"]: r["v"] for r in sources.last_write(rows, ["k"], "at").collect()} == {1: "new", 2: "only"}


def test_roles_and_levels(spark):
    rows = spark.createDataFrame([(i, i % 3, f"t{i}", "c", i / 7, [str(i % 2)], None if i % 4 else 1.5) for i in range(100)], "id long, p int, t string, c string, m double, s array<string>, n double")
    got = {r["column"]: r["role"] for r in dims.roles(rows).collect()}
    assert got == {"id": "id", "p": "param", "t": "text", "c": "fixed", "m": "metric", "s": "param", "n": "param"}
    assert [(r["code"], r["key"], r["n"]) for r in dims.levels_of(rows, "n").orderBy("code").collect()] == [(0, "null", 75), (1, "1.5", 25)]
    edges = dims.bin_edges(rows, "id").first()["edges"]
    assert edges == [10 * b for b in range(1, 10)]


def test_tail_reads_appends_and_restarts(tmp_path):
    path = tmp_path / "grow.jsonl"
    reader = tail.TailReader(str(path))
    lines, offset = reader.read(reader.initialOffset())
    assert list(lines) == []
    path.write_text("one\ntwo\npart")
    lines, offset = reader.read(offset)
    assert [x[2] for x in lines] == ["one", "two"]
    with path.open("a") as file:
        file.write("ial\nthree\n")
    before = offset
    lines, offset = reader.read(offset)
    assert [x[2] for x in lines] == ["partial", "three"]
    assert [x[2] for x in reader.readBetweenOffsets(before, offset)] == ["partial", "three"]
    os.remove(path)
    path.write_text("new\n")
    lines, offset = reader.read(offset)
    assert [(x[0], x[2]) for x in lines] == [(1, "new")]


def test_tail_stream(spark, tmp_path):
    path = tmp_path / "grow.txt"
    path.write_text("a\nb\n")
    query = tail.append_to(tail.follow(spark, str(path)), str(tmp_path / "out"), str(tmp_path / "check"))
    try:
        query.processAllAvailable()
        with path.open("a") as file:
            file.write("c\n")
        for _ in range(50):
            query.processAllAvailable()
            if sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]:
                break
        assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    finally:
        query.stop()


@pytest.mark.parametrize("text,kind", [("", "null"), ("True", "bool"), ("-3", "num"), ("1e5", "num"), (" 5", "str"), ("1d", "str"), ("[1, 2]", "json"), ("[x", "str"), ("nan", "num")])
def test_csv_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(sources.csv_kind(F.col("t"))).first()[0] == kind
