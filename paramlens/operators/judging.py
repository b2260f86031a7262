"""A cohort of recorded rounds judged on the bars that they share, or refused with a reason.

Times of bars are rebuilt from a round's first and last bar and the data's step, less those it dropped, or read where
they were recorded. How many there must be is counted before any bar is made, and held against
the lengths of the recorded arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bars
from .cohort import cohort_rules

#: Members that a cohort may have.
MOST = 1000
_NUMBERS = "array<double>"
ALIGNMENT = "struct<first_test_datetime:string, last_test_datetime:string, missing_datetimes:array<string>, test_datetimes:array<string>>"


def seconds(text: Column) -> Column:
    """Seconds since the epoch of an ISO time; one without a zone is UTC, and a date is its midnight. Null if it is no time."""
    full = F.regexp_replace(text, r"([T ]\d\d:\d\d)(?=$|Z|[+-])", "$1:00")
    dated = F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\d$"))
    zoned = F.rlike(text, F.lit(r"(Z|[+-]\d\d:?\d\d)$")) & ~dated
    whole = F.when(dated, F.concat(text, F.lit("T00:00:00Z"))).when(zoned, full).otherwise(F.concat(full, F.lit("Z")))
    sound = F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"))
    return F.when(sound, F.unix_seconds(whole.try_cast("timestamp")))


def _each(texts: Column) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), seconds)


def aligned(rounds: DataFrame, step: int | None) -> DataFrame:
    """Adds ``times``, ``expected``, and ``problem``: why a round's arrays can't be laid on a time line, or null.

    ``rounds`` has member, alignment, preds, probs and market. ``times`` is null where there is a problem; ``expected`` is
    how many bars the alignment makes.
    """
    a = F.col("alignment")
    rows = rounds.withColumns({"_first": seconds(a["first_test_datetime"]), "_last": seconds(a["last_test_datetime"]), "_gone": _each(a["missing_datetimes"]), "_told": F.when(a["test_datetimes"].isNotNull(), _each(a["test_datetimes"]))})
    within = F.filter("_told", lambda t: t.between(F.col("_first"), F.col("_last")))
    rows = rows.withColumn("_in", within)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("_told") - 1, F.lit(1))), lambda i: (F.size("_told") < 2) | (F.get("_told", i) > F.get("_told", i - 1)))
    ends = (F.array_contains("_gone", F.col("_first")) | (F.get("_in", F.lit(0)) == F.col("_first"))) & (F.array_contains("_gone", F.col("_last")) | (F.try_element_at("_in", F.lit(-1)) == F.col("_last")))
    size = F.lit(step).cast("long")
    last = F.col("_first") + F.ceil((F.col("_last") - F.col("_first")) / size) * size
    dropped = F.size(F.array_distinct(F.filter("_gone", lambda t: t.between(F.col("_first"), last) & ((t - F.col("_first")) % size == 0))))
    counted = F.when(F.col("_told").isNotNull(), F.size(F.filter("_in", lambda t: ~F.array_contains("_gone", t)))).when(size.isNotNull(), (last - F.col("_first")) / size + 1 - dropped)
    rows = rows.withColumn("expected", counted.cast("long"))
    n, ret = F.size("preds"), F.col("market")["ret"]
    bad = lambda c, wrong: F.exists(F.coalesce(c, F.array().cast(_NUMBERS)), wrong)
    problem = (
        F.when(F.col("preds").isNull(), "no predictions were recorded").when(a.isNull(), "no alignment was recorded")
        .when(F.col("_first").isNull() | F.col("_last").isNull(), "the first or last bar has no time").when(F.exists("_gone", lambda t: t.isNull()), "a missing bar has no time")
        .when(F.col("_told").isNotNull() & F.exists(F.coalesce("_told", F.array().cast("array<long>")), lambda t: t.isNull()), "a recorded bar has no time")
        .when(F.col("_told").isNotNull() & ~rising, "the recorded times do not rise").when(F.col("_told").isNotNull() & ((F.size("_in") == 0) | ~F.coalesce(ends, F.lit(False))), "the recorded times do not fit the first and last bar")
        .when(F.col("_told").isNull() & F.lit(step is None), "neither times nor the data's step are known")
        .when(F.col("expected") != n, F.concat(n.cast("string"), F.lit(" bars where the alignment makes "), F.col("expected").cast("string")))
        .when(bad(F.col("preds"), lambda x: x.isNull() | F.isnan(x)), "a prediction is no number").when(F.col("probs").isNotNull() & (F.size("probs") != n), "probabilities and predictions differ in length")
        .when(bad(F.col("probs"), lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)), "a probability is not within 0 and 1")
        .when(ret.isNull(), "no market returns were recorded").when(F.size(ret) != n, "market returns and predictions differ in length")
    )
    rows = rows.withColumn("problem", problem)
    made = F.when(F.col("_told").isNotNull(), F.col("_in")).otherwise(F.sequence(F.col("_first"), last, size) if step else F.lit(None).cast("array<long>"))
    times = F.when(F.col("problem").isNull(), F.filter(made, lambda t: ~F.array_contains("_gone", t)))
    return rows.withColumn("times", times).drop("_first", "_last", "_gone", "_told", "_in")


def bars_of(sound: DataFrame) -> DataFrame:
    """(member, at, pred, prob, ret), one row a bar of aligned rounds without problems."""
    zipped = F.arrays_zip("times", "preds", F.coalesce("probs", F.array().cast(_NUMBERS)).alias("probs"), F.col("market")["ret"].alias("ret"))
    return sound.where(F.col("problem").isNull()).select("member", F.explode(zipped).alias("b")).select("member", F.col("b.times").alias("at"), F.col("b.preds").alias("pred"), F.col("b.probs").alias("prob"), "b.ret")


class Refused(ValueError):
    """A cohort that can't be judged, with the reason."""


@dataclass(frozen=True)
class Judged:
    """``windows`` has a row for the cohort and each member, whole and by halves; ``between`` bars are in neither half."""

    architecture: str
    aggregation: str
    bars: int
    between: int
    fired: float
    windows: DataFrame
    notes: list[str]


def judge(
    rounds: DataFrame, step: int | None, fee_bps: float = bars.FEE_BPS, slip_bps: float = bars.SLIP_BPS,
    reference: str | None = None, module: str | None = None, features: list[dict] = (),
) -> Judged:
    """Judges a cohort; ``rounds`` has member, params (a map), alignment, preds, probs and market.

    Refused are cohorts without members or with too many, of several architectures, with a round whose arrays don't
    fit its times, that average probabilities which a member lacks, or that share fewer than two bars. Runs small jobs, each of which gives the
    driver one row or one reason.
    """
    if not (0 <= fee_bps < bars.BPS and 0 <= slip_bps < bars.BPS):
        raise Refused("fee and slippage are basis points from 0 on")
    rules = cohort_rules(rounds, "params", reference, module, features).first()
    if not 0 < rules["members"] <= MOST:
        raise Refused(f"{rules['members']} members where there are 1 to {MOST}")
    if len(rules["architectures"]) > 1:
        raise Refused(rules["notes"][0])
    weighted = rules["aggregation"] == "probability_weighted"
    rows = aligned(rounds, step)
    wrong = rows.where(F.col("problem").isNotNull()).orderBy("member").select("member", "problem").first()
    if wrong:
        raise Refused(f"round {wrong['member']}: {wrong['problem']}")
    p = F.col("params")
    exits = p["take_profit_bps"].isNotNull() | p["stop_loss_bps"].isNotNull()
    told = rows.agg(F.count(F.when(F.col("probs").isNull(), 1)).alias("none"), F.count(F.when(exits, 1)).alias("exits"), F.count_distinct(F.coalesce(p["use_calibration"] == "true", F.lit(False))).alias("ways")).first()
    if weighted and told["none"]:
        raise Refused(f"{told['none']} of {rules['members']} members gave no probabilities, which the members of {rules['architectures'][0]} are averaged by")
    each = bars_of(rows)
    common = bars.ensemble(each, weighted, rules["cut"])
    starts = rows.select(F.get("times", F.floor(F.size("times") / 2).cast("int")).alias("s")).agg(F.min("s").alias("a"), F.max("s").alias("b")).first()
    one = common.agg(F.count("*").alias("n"), F.avg("signal").alias("fired"), F.count(F.when(F.col("at").between(starts["a"], starts["b"] - 1), 1)).alias("between")).first()
    if one["n"] < 2:
        raise Refused("the members share fewer than two bars")
    notes = list(rules["notes"])
    if one["between"]:
        notes.append(f"{one['between']} bars are in the first half of some members and the second of others, and so in neither")
    if told["exits"]:
        notes.append(f"{told['exits']} members exit by take-profit or stop-loss, which is not rebuilt")
    if weighted and told["ways"] > 1:
        notes.append("calibrated and uncalibrated probabilities are averaged together")
    windows = bars.judge(each, weighted, fee_bps, slip_bps, rules["cut"])
    return Judged(rules["architectures"][0], rules["aggregation"], one["n"], one["between"], one["fired"], windows, notes)
