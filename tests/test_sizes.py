"""What only shows on larger tables: counts beyond a long's cube, means that differ in the last bit."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from paramlens import queries, queries_runs
from paramlens.operators import clusters, halves
from paramlens.sources import members


def test_millions_of_equal_values(spark):
    n = 2_200_000  # the cube is over the largest long
    rows = spark.range(n).select(F.lit(0.5).alias("v"), (F.col("id") % 2 == 0).alias("g")).unionByName(spark.createDataFrame([(1.0, True)], "v double, g boolean"))
    got = halves.mann_whitney(rows, "v", "g").first()
    m, na, nb = n + 1, n // 2 + 1, n // 2
    spread = math.sqrt(na * nb / 12 * (m + 1 - (float(n) ** 3 - n) / (m * (m - 1.0))))
    assert (got["na"], got["nb"]) == (na, nb) and got["U"] - na * nb / 2 == pytest.approx(nb / 2)
    assert got["z"] == pytest.approx((nb / 2 - 0.5) / spread, rel=1e-6)


def test_equal_means_share_a_rank(spark, tmp_path):
    prices = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [0.15], 4: [0.5]}
    rows = [(2 * (10 * c + i), c, p) for c, own in prices.items() for i, p in enumerate(own)] + [(1, 5, 0.7), (4, 6, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["c"]: r["rank_first"] for r in queries.first_half_ranks(spark, str(tmp_path)).collect()}
    assert got == {4: 1, 1: 2, 2: 2, 3: 4}


def test_steady_means_of_any_doubles(spark):
    rows = [(1, math.nan), (1, 1.0), (2, math.inf), (3, 1e300), (3, 1e300), (4, 1 / 3), (4, 1 / 3), (5, None), (6, -2.5), (6, None)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(halves.steady_mean(F.col("v")).alias("m")).collect()}
    assert math.isnan(got.pop(1)) and got == {2: math.inf, 3: 1e300, 4: 1 / 3, 5: None, 6: -2.5}


def test_members_of_one_file_are_not_sorted_by_one_task(spark, tmp_path):
    raw = b"".join(gzip.compress(f'{{"round_id": "r{i}"}}\n'.encode(), mtime=0) for i in range(200))
    (tmp_path / "r.gz").write_bytes(raw)
    found = members.members(spark, str(tmp_path / "r.gz"), width=500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if any(step in line for step in ("Sort ", "Window ", "hashpartitioning"))]
    assert moved and not [line for line in moved if "payload" in line or "start" in line]
    assert [r["payload"] for r in found.orderBy("start").collect()] == [f'{{"round_id": "r{i}"}}\n' for i in range(200)]
    assert {r["lo"] for r in members.scanned(spark, str(tmp_path / "r.gz"), width=500).select("lo").distinct().collect()} == set(range(0, len(raw), 500))


def test_rounds_of_one_file_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") * 7 % 4000).alias("o_orderkey"), F.lit(4).cast("long").alias("o_custkey"), F.lit(1.5).alias("o_totalprice"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    parts = [[r["k"] for r in part] for part in queries_runs._ranges(spark, str(tmp_path), 4).rdd.glom().collect()]
    assert max(map(len, parts)) < 2500 and [k for part in parts for k in part] == list(range(4000))
    got = members.members(spark, f"{queries_runs.round_files(spark, str(tmp_path))}/*.jsonl.gz").orderBy("start").collect()
    assert len({r["file"] for r in got}) == 1 and [json.loads(r["payload"])["_round_index"] for r in got] == list(range(4000))
    index = queries_runs.round_index(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in index] == [(0, 4000, 0)]


def test_groups_work_out_ranks_once_and_however_rows_meet_them(spark, monkeypatch):
    rows = spark.range(600).select("id", (F.col("id") % 3 + F.col("id") / 10_000).alias("a"), F.when(F.col("id") % 50 > 0, F.col("id") % 3 * 5.0).alias("b"), F.lit(1.0).alias("c"))
    got = clusters.assign(rows, ["a", "b", "c"], ["id"])
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    own = {r["id"]: r["cluster"] for r in got.collect()}
    assert sorted(i for i, c in own.items() if c is None) == list(range(0, 600, 50)) and len(set(own.values())) > 2
    monkeypatch.setattr(clusters, "BROADCAST", 0)
    assert {r["id"]: r["cluster"] for r in clusters.assign(rows, ["a", "b", "c"], ["id"]).collect()} == own
