"""Quality rules: a table of thresholds compiled into one projection.

``measures`` gives the ratios of a text, ``RULES`` the bounds on them, and ``judge`` puts both into
a single select. Null and empty texts have no words and fail the base rule. Rows with equal or
null ids, and equal texts, are judged one by one; very long texts are measured whole and not
rejected for their length. An empty table gives an empty one. ``keep`` returns the caller's
columns as they are; ``judge`` replaces those of its own names. No user functions, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, settled, squeezed

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Frequent function words of English, German, French and Spanish; fixed values.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au avec dans de des du en est et il la le les ne par pas pour que qui sur un une "
    "al con como de del el en es la las lo los más no para por que se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """A bound on a measure; holds from ``least_words`` words on."""

    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


RULES = (
    Rule("n_words", low=20),
    Rule("repeat_ratio", high=0.3),
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbol_ratio", high=0.2),
    Rule("dup_line_ratio", high=0.3),
    Rule("stop_ratio", low=0.01, least_words=50),
)


def _starts(words: str, window: int = WINDOW) -> Column:
    n = F.size(words)
    return F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<int>"))


def _neighbour(placed: str, x: Column, j: Column, step: int) -> Column:
    return F.coalesce(F.get(placed, j + step)["w"] == x["w"], F.lit(False))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ratios that rules speak of."""
    words = F.split("_flat", " ")
    stop = sorted(set(STOP_WORDS.split()))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = docs.withColumn("_flat", squeezed(text))
    out = out.withColumns(
        {
            "n_words": n_words(F.col("_flat")),
            "n_symbols": F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]++", "")).cast("long"),
            "_words": words,
            "_lines": lines,
        }
    )
    out = out.withColumns(
        {
            "word_chars": F.when(F.col("n_words") == 0, F.lit(0)).otherwise(F.length("_flat") - F.col("n_words") + 1).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(*stop))).cast("long"),
            "_hashes": F.transform(_starts("_words"), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        }
    )
    # Each step is a column of its own: inside a lambda an expression would be computed anew for each element.
    # Equal windows have equal hashes, so only texts with equal hashes need the words themselves.
    placed = F.transform(
        _starts("_words"), lambda i: F.struct(F.array_join(F.slice("_words", i, WINDOW), " ").alias("w"), i.alias("i"))
    )
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(placed)))
    twice = F.filter("_placed", lambda x, j: _neighbour("_placed", x, j, -1) | _neighbour("_placed", x, j, 1))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    out = out.withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
    out = out.withColumn(
        "n_repeat_words",
        F.aggregate(
            F.transform("_at", lambda p, j: F.least(F.coalesce(F.get("_at", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0),
            lambda a, x: a + x,
        ).cast("long"),
    )
    per_word = {"mean_word_chars": "word_chars", "symbol_ratio": "n_symbols", "stop_ratio": "n_stop", "repeat_ratio": "n_repeat_words"}
    ratios = {k: F.try_divide(F.col(v), F.col("n_words")) for k, v in per_word.items()}
    ratios["dup_line_ratio"] = F.try_divide(F.col("n_dup_lines"), F.col("n_lines"))
    return settled(out.withColumns(ratios), "n_words").drop("_flat", "_words", "_lines", "_hashes", "_placed", "_at")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether all rules hold; a ratio without words or lines breaks none."""
    holds = F.lit(True)
    for rule in rules:
        value, broken = F.col(rule.measure), F.lit(False)
        if rule.low is not None:
            broken = broken | (value < rule.low)
        if rule.high is not None:
            broken = broken | (value > rule.high)
        holds = holds & ~F.coalesce(broken & (F.col("n_words") >= rule.least_words), F.lit(False))
    return holds


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that all rules keep, with their own columns, whatever these are called."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return judge(rows, rules).where("kept").select("_doc.*")


def digest_row(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
