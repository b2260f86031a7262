"""Order statistics and ranges: exact at any size, and no task with much more than its share."""

import random

import pytest
from pyspark.sql import functions as F

from paramlens.operators import cohort, halves
from paramlens.plans import ranges


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), float(rng.randint(0, 3)), 7.0, None if i % 3 else rng.lognormvariate(0, 8), float("nan") if i % 2 else float("inf") if i % 5 else -1e300) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "i long, a double, b double, c double, d double, e double").repartition(5)


def exact(rows, at, fractions, positions):
    own = sorted(r[at] for r in rows if r[at] is not None and r[at] == r[at])
    return len(own), [[own[p] for p in positions(f, len(own))] for f in fractions]


@pytest.mark.parametrize("few", [50_000, 40, 3])
def test_order_statistics_are_exact_however_few_values_a_task_may_sort(values, monkeypatch, few):
    rows, df = values
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "GRID", 10)
    monkeypatch.setattr(ranges, "SKETCH", 300)
    fractions = (0.0, 0.05, 0.5, 0.99, 1.0)
    for positions in (ranges.nearest, lambda f, n: sorted({int(f * (n - 1)), min(n - 1, int(f * (n - 1)) + 1)})):
        got = ranges.order_statistics(df, {c: F.col(c) for c in "abcde"}, fractions, positions)
        assert got == {c: exact(rows, at + 1, fractions, positions) for at, c in enumerate("abcde")}


def test_order_statistics_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert ranges.order_statistics(df, {"v": F.col("v")}, (0.5,)) == {"v": (0, [[]])}


@pytest.fixture
def parts(spark):
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    spark.conf.set(name, "16")
    yield spark
    spark.conf.set(name, old)


def test_ranges_cut_a_value_that_most_rows_share(parts):
    rng = random.Random(5)
    rows = [(i, 1.0 if rng.random() < 0.9 else rng.random() * 2, float(i % 11)) for i in range(16_000)]
    rng.shuffle(rows)
    df = parts.createDataFrame(rows, "i long, v double, w double").repartition(7)
    placed = ranges.ranged(df, "v", "i").cache()
    counts = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert max(counts) <= 2 * 1000 and len(counts) >= 12
    got = [(r["v"], r["i"]) for r in placed.orderBy("_part", "v", "i").collect()]
    assert got == sorted((v, i) for i, v, _ in rows)
    ranked = cohort.ranked(df, "v", "i").orderBy("place").collect()
    assert [(r["place"], r["i"]) for r in ranked] == [(k + 1, i) for k, (i, v, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]
    kept = halves.kept_lead(df, "v", "w", "i").first()
    head = sorted(rows, key=lambda r: (-r[1], r[0]))[:1600]
    assert kept["top"] == 1600 and abs(kept["lead_second"] - (sum(r[2] for r in head) / 1600 - sum(r[2] for r in rows) / 16_000)) < 1e-9
