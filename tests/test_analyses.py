"""Numerics at large means, first-half reading, rounds beside rows, and sources, against plain Python."""

import gzip
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paramlens.functions import kernel
from paramlens.operators import ablation, cohort, effects, first_half, gates, members, rounds, trials
from paramlens.plans import cells, ranges
from paramlens.plans.cells import Target
from paramlens.sources import experiment
from paramlens.sources import rows as sources
from paramlens.streaming import logs, tail

BIG = 1e9


def test_spreads_at_a_large_mean(spark):
    values = [BIG + i / 1000 for i in range(7)] * 10
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", v) for i, v in enumerate(values)], "i long, p string, y double")
    last = trials.record_curve(rows, Target("y"), "i").orderBy(F.desc("at")).first()
    sd = np.std(np.array(values) - BIG, ddof=1)
    assert last["sd"] == pytest.approx(sd, rel=1e-4) and last["luck"] - BIG == pytest.approx(0.003 + sd * kernel.expected_max_z(70), abs=2e-6)
    one = trials.like(rows, Target("y"), ["p"], rows.where("i = 0"), "i").first()
    others = [v - BIG for i, v in enumerate(values) if i % 2 == 0 and i]
    assert one["n"] == len(others) and one["sd"] == pytest.approx(np.std(others, ddof=1), rel=1e-4)
    told = effects.levels(rows, Target("y"), ["p"]).where("level = 'a'").first()
    assert told["sd"] == pytest.approx(np.std([v - BIG for i, v in enumerate(values) if i % 2], ddof=1), rel=1e-4)


def test_record_curve_by_time_and_without_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "i long, y double").withColumn("at", F.timestamp_seconds("i"))
    got = trials.record_curve(rows, Target("y"), "at").orderBy("at").collect()
    assert [r["record"] for r in got][:6] == [True] * 5 + [False] and got[-1]["best"] == 4.0
    assert trials.record_curve(rows.where("i < 0"), Target("y"), "i").count() == 0


def test_ablation_matches_a_dense_fit(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        drops = [m for m in "xyz" if rng.random() < 0.3]
        f = "uvw"[rng.integers(3)]
        rows.append((f, drops, BIG + 2.0 * ("x" in drops) - 1.0 * (f == "v") + float(rng.normal(0, 0.5))))
    got = {r["term"]: r for r in ablation.model(spark.createDataFrame(rows, "f string, d array<string>, y double"), Target("y"), ["f"], "d").collect()}
    x = np.array([[1, f == "v", f == "w", "x" in d, "y" in d, "z" in d] for f, d, _ in rows], dtype=float)
    y = np.array([v - BIG for *_, v in rows])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    se = np.sqrt(np.diag(inverse @ ((x * ((y - x @ beta) ** 2 / (1 - h) ** 2)[:, None]).T @ x) @ inverse))
    for term, b, e in zip(["(mean)", "f=v", "f=w", "x", "y", "z"], beta, se, strict=True):
        assert got[term]["effect"] - (BIG if term == "(mean)" else 0) == pytest.approx(b, abs=1e-5) and got[term]["se"] == pytest.approx(e, rel=1e-4)
    assert got["x"]["member"] and got["x"]["detectable"] and not got["f=v"]["member"]


def test_tails_against_known_values(spark):
    for f, d1, d2, p in ((3.0, 2, 10, 0.0953674), (1.0, 1, 1, 0.5), (4.0, 5, 60, 0.003384)):
        assert kernel.f_survival(f, d1, d2) == pytest.approx(p, abs=2e-5)
    assert kernel.chi2_survival(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and kernel.chi2_survival(10.0, 4) == pytest.approx(0.0404277, abs=1e-6)
    assert kernel.t_inv(0.975, 10) == pytest.approx(2.228139, abs=1e-5)


def test_order_statistics_and_running_sums(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(0, 1, 25_000), 3)
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(6)
    n, found = ranges.order_statistics(rows, {"v": F.col("v")}, (0.0, 0.013, 0.5, 0.99, 1.0))["v"]
    want = np.sort(v)
    assert n == len(v) and [x[0] for x in found] == [want[min(int(f * n), n - 1)] for f in (0.0, 0.013, 0.5, 0.99, 1.0)]
    assert ranges.order_statistics(rows.where("v > 99"), {"v": F.col("v")}, (0.5,))["v"] == (0, [[]])
    counts = rows.groupBy("v").agg(F.count("*").alias("c"))
    got = sorted((r["v"], r["u"]) for r in ranges.running(counts, "v", {"u": F.col("c")}).collect())
    values, c = np.unique(v, return_counts=True)
    assert [u for _, u in got] == np.cumsum(c).tolist() and [x for x, _ in got] == values.tolist()


@pytest.mark.parametrize(
    "value,text",
    [(1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (0.0001, "0.0001"), (-0.00025, "-0.00025"), (0.1, "0.1"), (3600.0, "3600"), (1234567.5, "1234567.5"), (12345678.25, "12345678.25"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (2.5e30, "2.5e+30"), (-0.5, "-0.5")],
)
def test_level_texts(spark, value, text):
    assert spark.createDataFrame([(value,)], "x double").select(cells.key_of("x", "double")).first()[0] == text


def test_first_half_never_stands_in(spark):
    rows = spark.createDataFrame([(1.0, 2.0, None, 5.0), (3.0, None, 4.0, 6.0)], "y double, y1 double, y2 double, z double")
    got = first_half.first_half(rows, ["y", "z"], {"y": ("y1", "y2")}).collect()
    assert [(r["y"], r["z"]) for r in got] == [(2.0, None), (None, None)]
    reads = first_half.gate_reads([gates.Gate("y", ">", 1), gates.Gate("z", ">", 1)], {"y": ("y1", "y2")})
    assert [(g.column, h) for g, h in reads] == [("y1", True), ("z", False)]
    assert first_half.touched_by_second("y", reads, {"y": ("y1", "y2")}) == ["z>1"]
    a = spark.createDataFrame([("p", "u", 50, 1.0, False), ("p", "v", 40, -1.0, False), ("p", "w", 5, 9.0, True), ("q", "u", 50, 1.0, False)], "dim string, level string, n long, lift double, withheld boolean")
    b = spark.createDataFrame([("p", "u", 30, 2.0, False), ("p", "v", 60, 1.0, False), ("q", "u", 50, 1.0, False)], a.schema)
    agree = {r["dim"]: r["agree"] for r in first_half.lift_agreement(a, b).collect()}
    assert agree["p"] == pytest.approx((30 * 2 - 40) / math.sqrt((30 + 40) * (30 * 4 + 40))) and agree["q"] is None


def test_rounds_beside_rows(spark):
    assert [r[0] for r in spark.createDataFrame([(1, "a"), (2, None), (None, "a")], "i long, s string").select(rounds.round_key(F.col("i"), F.col("s"))).collect()] == ["a#1", "2", None]
    rows = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "a", 3)], "id string, shard string, at long")
    assert rounds.row_of(rows, "x", "at", "b").first()["at"] == 2 and rounds.row_of(rows, "x", "at").first()["at"] == 1 and rounds.row_of(rows, "z", "at").count() == 0


def test_cohort_rules(spark):
    chosen = spark.createDataFrame([({"model_name": "LGBM one"},), ({"architecture": " ", "model_name": "my regressor"},)], "params map<string,string>")
    one = cohort.cohort_rules(chosen, features=[{"func": "f.price_lines"}]).first()
    assert one["architectures"] == ["LGBM one", "my regressor"] and one["aggregation"] == "probability_weighted" and len(one["notes"]) == 2
    assert cohort.bar_step({"sfd": {"manifest": {"data_source": {"params": {"kline_size": 3600}}}}}) == 3600 and cohort.bar_step({"sfd": {"manifest": {"data_source": {"params": {"kline_size": True}}}}}) is None


def test_lines_and_names(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": {"b": 1}, "a_b": 2}\n\n{"a_b": 3}\nnot\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n')
    parsed = sources.json_lines(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))
    assert sorted((os.path.basename(r["shard"]), r["line"]) for r in parsed.collect()) == [("a.jsonl", 1), ("a.jsonl", 3), ("a.jsonl", 4), ("b.jsonl", 1)]
    assert {"a.b", "a_b", "x"} <= set(sources.typed(parsed).columns)
    with spark_conf(spark, "spark.sql.files.maxPartitionBytes", "64"):
        (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(1, 200)))
        got = sources.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert got.rdd.getNumPartitions() > 3 and all(r["text"] == f"line {r['line']}" for r in got.collect()) and got.count() == 199


class spark_conf:
    def __init__(self, spark, key, value):
        self.spark, self.key, self.value = spark, key, value

    def __enter__(self):
        self.before = self.spark.conf.get(self.key)
        self.spark.conf.set(self.key, self.value)

    def __exit__(self, *_):
        self.spark.conf.set(self.key, self.before)


def test_rounds_are_read_once_and_left_out_with_reason(spark, tmp_path):
    records = [{"round_id": "a", "_round_index": 0}, {"round_id": "b", "_round_index": 0, "execution": {"pos": [1], "gross": [1], "net": [1]}}, {"round_id": "c", "_round_index": 1, "execution": {"pos": [1], "gross": [1, 2], "net": [1]}}, {"round_id": "d", "_round_index": 2}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, records)) + '\n{"round_id": "torn", "_round')
    log = experiment.round_log(spark, str(tmp_path / "r.jsonl"))
    assert sorted(r["round_id"] for r in log.where("bad is null").collect()) == ["b", "c", "d"] and log.where("bad is not null").count() == 1
    assert {r["round_id"]: r["reason"] for r in experiment.left_out(log.where("bad is null")).collect()} == {"c": "execution arrays differ in length", "d": "no execution was recorded"}


def test_storage_and_search_space():
    assert experiment.round_file({"round_data.jsonl"}, None, "packed") == "round_data.jsonl"
    assert experiment.round_file({"round_data.jsonl.gz"}, "packed", "packed") == "round_data.jsonl.gz"
    for names, declared in (({"round_data.jsonl.gz"}, None), ({"round_data.jsonl"}, "packed"), (set(), "other")):
        with pytest.raises(ValueError):
            experiment.round_file(names, declared, "packed")
    space = experiment.search_space({"a": [1, 2, 3], "b": ["x", "y"]}, {"a": [1, 9], "c": [0]})
    assert (space["combinations"], space["left"], len(space["problems"])) == (6, 2, 2)


def test_log_edges(spark):
    text = ["sampling 9 perms...", "1/9 2s a=1 a=2", "Traceback (most recent call last):", "ValueError: one", "During handling of the above exception, another exception occurred:", "Traceback (most recent call last):", '  File "/own/x.py", line 3, in f']
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "log string, at long, value string")
    marked = logs.classified(lines)
    assert logs.progress(marked).first()["values"] == {"a": 2.0}
    crash = logs.crashes(marked).first()
    assert crash["exceptions"] == ["ValueError"] and crash["end"] == 6 and (crash["path"], crash["line"], crash["function"]) == ("/own/x.py", 3, "f")
    unfinished = logs.classified(lines, finished=False)
    assert logs.crashes(unfinished).count() == 0 and [r["at"] for r in logs.writing(unfinished).collect()] == [6]
    assert logs.pace(logs.progress(marked)).count() == 0 and logs.others(marked).count() == 0


def test_tail_of_replaced_files_and_gzip_members(tmp_path):
    path = tmp_path / "grow.txt"
    path.write_text("one\ntwo\n")
    reader = tail.TailReader(str(path))
    _, before = reader.read(reader.initialOffset())
    with path.open("r+") as file:  # the same file, longer, with another beginning
        file.write("other\nlines\nhere\n")
    lines, offset = reader.read(before)
    assert [(g, t) for g, _, t in lines] == [(1, "other"), (1, "lines"), (1, "here")]
    with pytest.raises(ValueError):
        list(reader.readBetweenOffsets(reader.initialOffset(), before))
    packed = tmp_path / "r.gz"
    first, second = gzip.compress(b"a\nb\n"), gzip.compress(b"c\n")
    packed.write_bytes(first + second[:9])
    reader = tail.GzipTailReader(str(packed))
    lines, offset = reader.read(reader.initialOffset())
    assert [t for *_, t in lines] == ["a", "b"] and offset["at"] == len(first)
    packed.write_bytes(first + second)
    lines, end = reader.read(offset)
    assert [t for *_, t in lines] == ["c"] and [t for *_, t in reader.readBetweenOffsets(offset, end)] == ["c"]


def test_generations(spark):
    lines = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "shard string, generation int, value string")
    assert sorted(r["value"] for r in tail.current(lines, "shard").collect()) == ["y", "z"] and [r["value"] for r in tail.archived(lines, "shard").collect()] == ["x"]
