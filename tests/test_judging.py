"""Cohorts judged on shared bars, and refused with reasons."""

import pytest
from pyspark.sql import functions as F

from paramlens.operators import bars, judging

ROUND = f"member string, params map<string,string>, alignment {judging.ALIGNMENT}, preds array<double>, probs array<double>, market struct<ret:array<double>>"
HOUR = 3600


def a_round(member, hours, params=None, missing=(), given=True, first=0, told=None, **over):
    """Hourly bars of one day from ``first`` on, less those missing."""
    at = [h for h in range(first, first + hours) if h not in missing]
    clock = lambda h: f"2026-01-0{1 + h // 24}T{h % 24:02d}:00:00"
    row = {
        "member": member, "params": {"model_name": "lgbm"} if params is None else params,
        "alignment": (clock(first), clock(first + hours - 1) + "Z", [clock(h) + "+00:00" for h in missing], told),
        "preds": [float((h + len(member)) % 3 > 0) for h in at], "probs": [((h * 7 + len(member)) % 10) / 10 for h in at] if given else None, "market": ([0.01 * ((h % 5) - 2) if h % 11 else None for h in at],),
    }
    return tuple((row | over).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROUND)


def test_iso_times(spark):
    cases = {"2026-01-01T00:00:00Z": 1767225600, "2026-01-01": 1767225600, "2026-01-01T01:00:00+01:00": 1767225600, "2026-01-01 00:00:00.5": 1767225600, "2026-01-01T00:00": 1767225600, "x": None, "2026-13-01": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", judging.seconds(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == cases


def test_times_are_rebuilt_and_counted(spark):
    start = 1767225600
    rows = judging.aligned(frame(spark, a_round("a", 10, missing=(3, 4)), a_round("b", 3, told=["2025-12-31", "2026-01-01T00:00:00", "2026-01-01T00:30:00", "2026-01-01T02:00:00"]), a_round("c", 5, preds=[1.0] * 4)), HOUR)
    got = {r["member"]: r for r in rows.collect()}
    assert got["a"]["times"] == [start + HOUR * h for h in (0, 1, 2, 5, 6, 7, 8, 9)] and got["a"]["problem"] is None
    assert got["b"]["times"] == [start, start + 1800, start + 2 * HOUR]
    assert got["c"]["problem"] == "4 bars where the alignment makes 5" and got["c"]["times"] is None


@pytest.mark.parametrize("change,why", [
    ({"preds": None}, "no predictions"), ({"alignment": None}, "no alignment"), ({"alignment": ("x", "2026-01-01", [], None)}, "no time"),
    ({"alignment": ("2026-01-01", "2026-01-01T04:00:00", ["?"], None)}, "missing bar"), ({"probs": [2.0] * 5}, "within 0 and 1"), ({"probs": [0.5]}, "differ in length"),
    ({"market": None}, "no market"), ({"market": ([0.1],)}, "market returns and predictions"), ({"preds": [1.0, None, 1.0, 0.0, 1.0]}, "no number"),
    ({"alignment": ("2026-01-01", "2026-01-01T04:00:00", [], ["2026-01-01T01:00:00", "2026-01-01"])}, "do not rise"), ({"alignment": ("2026-01-01", "2026-01-01T04:00:00", [], ["2026-01-02"])}, "do not fit"),
])
def test_rounds_with_problems(spark, change, why):
    (row,) = judging.aligned(frame(spark, a_round("m", 5, **change)), HOUR).collect()
    assert why in row["problem"] and row["times"] is None


def test_refusals(spark):
    good = a_round("a", 8)
    for rows, step, why in (
        ([], HOUR, "0 members"), ([good, a_round("b", 8, {"model_name": "ridge"})], HOUR, "several architectures"), ([good, a_round("b", 8, given=False)], HOUR, "gave no probabilities"),
        ([good, a_round("b", 8, first=20)], HOUR, "fewer than two bars"), ([good], None, "neither times nor"), ([good, a_round("b", 8, preds=[1.0])], HOUR, "round b: 1 bars"),
    ):
        with pytest.raises(judging.Refused, match=why):
            judging.judge(frame(spark, *rows), step)
    with pytest.raises(judging.Refused, match="basis points"):
        judging.judge(frame(spark, good), HOUR, fee_bps=-1)
    assert judging.judge(frame(spark, a_round("a", 8, {"model_name": "other"}, given=False)), HOUR).aggregation == "majority_vote"


def test_a_cohort_is_judged_as_its_bars_are(spark):
    rows = [a_round("a", 30), a_round("bb", 30, {"model_name": "lgbm", "use_calibration": "true", "stop_loss_bps": "5"}, first=4), a_round("ccc", 36, missing=(9,), first=1)]
    got = judging.judge(frame(spark, *rows), HOUR)
    assert got.architecture == "lgbm" and got.aggregation == "probability_weighted" and got.bars == 25
    # own second halves begin at hours 15, 19 and 19 (of 1 to 36 without 9)
    assert got.between == 4 and len(got.notes) == 3 and "4 bars" in got.notes[0]
    each = judging.bars_of(judging.aligned(frame(spark, *rows), HOUR))
    want = {(r["member"], r["part"]): r for r in bars.judge(each, True).collect()}
    assert {(r["member"], r["part"]): r for r in got.windows.collect()} == want and want["cohort", "whole"]["bars"] == 25
    assert want["cohort", "first"]["bars"] + want["cohort", "second"]["bars"] == 21
