"""Per-bar execution: what a window of bars earned, its trades, and ensembles of members.

Bars are rows (member, at, pos, gross, net, ret); ``ret`` is null where the market gave none. Trades
are runs of bars in the market, found as gaps and islands; returns compound by running products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import shortfall

BPS = 10_000.0
#: Basis points paid where a run names none.
FEE_BPS, SLIP_BPS = 5.0, 5.0
#: How near below its threshold a probability counts as within reach; least trades for a t.
REACH, T_TRADES = 0.05, 30


def bars_of(rounds: DataFrame) -> DataFrame:
    """Rounds with array columns ``pos``, ``gross``, ``net`` and ``ret`` as one row a bar."""
    zipped = F.arrays_zip("pos", "gross", "net", F.coalesce("ret", F.array().cast("array<double>")).alias("ret"))
    return rounds.select("member", F.posexplode(zipped).alias("at", "b")).select("member", "at", "b.pos", "b.gross", "b.net", "b.ret")


def model_outputs(rounds: DataFrame) -> DataFrame:
    """Shares of probabilities that pass the threshold or come within reach, and the margin of the largest.

    Null where a round recorded no probabilities.
    """
    n = F.size("probs")

    def share(reach: float) -> Column:
        def over(p: Column) -> Column:
            return F.when(F.col("threshold_rule") == ">", p + reach > F.col("optimal_threshold")).otherwise(p + reach >= F.col("optimal_threshold"))

        return F.round(F.when(n > 0, F.size(F.filter("probs", over)) / n), 6)

    return rounds.withColumns({"fired": share(0.0), "reach": share(REACH), "margin": F.round(F.array_max("probs") - F.col("optimal_threshold"), 6)})


def trades(bars: DataFrame) -> DataFrame:
    """(member, trade, bars, ret): each run of bars with a position, its net return compounded."""
    order = W.partitionBy("member").orderBy("at")
    opens = (F.col("pos") > 0) & (F.coalesce(F.lag("pos").over(order), F.lit(0.0)) <= 0)
    marked = bars.withColumn("trade", F.sum(opens.cast("int")).over(order)).where(F.col("pos") > 0)
    return marked.groupBy("member", "trade").agg(F.count("*").alias("bars"), (F.product(1 + F.col("net")) - 1).alias("ret"))


def _six(c: str) -> Column:
    """Rounded to six significant digits."""
    size = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), 5 - size)
    return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.rint(F.col(c) * scale) / scale)


def windows(bars: DataFrame) -> DataFrame:
    """Per member: return, cost, winning share, inventory, trades with mean and t, timing, market; in basis points.

    A t needs 30 trades that differ. Timing and market are over bars with a market return.
    """
    valid = F.col("ret").isNotNull()
    own = bars.groupBy("member").agg(
        F.count("*").alias("bars"), (F.avg("net") * BPS).alias("pnl"), (F.avg(F.col("gross") - F.col("net")) * BPS).alias("cost"),
        F.avg((F.col("net") > 0).cast("double")).alias("wins"), F.avg("pos").alias("inventory"),
        ((F.avg(F.when(valid, F.col("gross"))) - F.avg(F.when(valid, F.col("pos"))) * F.avg("ret")) * BPS).alias("timing"),
        (F.product(F.when(valid, 1 + F.col("ret"))) - 1).alias("market"),
    )
    done = trades(bars).groupBy("member").agg(F.count("*").alias("trades"), F.avg("ret").alias("_m"), F.var_samp("ret").alias("_v"), F.max(F.abs("ret")).alias("_x"))
    differ = (F.col("trades") >= T_TRADES) & (F.col("_v") > F.pow(F.col("_x") * 1e-9, 2))
    out = own.join(done, "member", "left").withColumns({"trades": F.coalesce("trades", F.lit(0)), "trade_mean": F.col("_m") * BPS, "trade_t": F.when(differ, F.col("_m") / F.sqrt(F.col("_v") / F.col("trades")))})
    return out.withColumns({c: _six(c) for c in ("pnl", "cost", "wins", "inventory", "timing", "market", "trade_mean", "trade_t")}).drop("_m", "_v", "_x")


def halves(bars: DataFrame, first_end: Column | None = None, second_start: Column | None = None) -> DataFrame:
    """Adds ``half``, 1 or 2: by the middle of each member's bars, or by given cuts, with null between them."""
    n, at = F.count("*").over(W.partitionBy("member")), F.row_number().over(W.partitionBy("member").orderBy("at")) - 1
    middle = F.floor(n / 2)
    if first_end is None or second_start is None:
        return bars.withColumn("half", F.when(n < 2, None).when(at < middle, 1).otherwise(2))
    return bars.withColumn("half", F.when(F.col("at") < first_end, 1).when(F.col("at") >= second_start, 2))


def long_flat(signals: DataFrame, fee_bps: float = FEE_BPS, slip_bps: float = SLIP_BPS, lag: int = 1) -> DataFrame:
    """Signals (member, at, signal, ret) executed: long on a bar when the signal ``lag`` bars before was 1.

    A bar without a market return can't be traded. Slippage moves both fills; the fee is paid on what is
    bought and on what is sold.
    """
    fee, slip = fee_bps / BPS, slip_bps / BPS
    order = W.partitionBy("member").orderBy("at")
    on = (F.coalesce(F.lag("signal", lag).over(order), F.lit(0)) == 1) & F.col("ret").isNotNull()
    rows = signals.withColumn("on", on)
    rows = rows.withColumns({"entry": F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False)), "leaving": F.col("on") & ~F.coalesce(F.lead("on").over(order), F.lit(False))})
    rows = rows.withColumn("run", F.sum(F.col("entry").cast("int")).over(order))
    within = W.partitionBy("member", "run", "on").orderBy("at")
    held = F.product(1 + F.col("ret")).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) / (1 + slip)
    rows = rows.withColumn("held", F.when(F.col("on"), held))
    equity = F.when(F.col("leaving"), F.col("held") * (1 - fee) * (1 - slip) - fee).otherwise(F.col("held") - fee)
    rows = rows.withColumn("equity", equity)
    before = F.when(F.col("entry"), F.lit(1.0)).otherwise(F.lag("equity").over(within))
    return rows.select("member", "at", F.col("on").cast("double").alias("pos"), F.when(F.col("on"), F.col("ret")).otherwise(0.0).alias("gross"), F.when(F.col("on"), F.col("equity") / before - 1).otherwise(0.0).alias("net"), "ret")


def shared(bars: DataFrame) -> DataFrame:
    """The bars that all members have."""
    members = bars.select("member").distinct().agg(F.count("*").alias("_k"))
    common = bars.select("member", "at").distinct().groupBy("at").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(members))  # one row
    return bars.join(common.where(F.col("_n") == F.col("_k")).select("at"), "at", "left_semi")


def ensemble(bars: DataFrame, weighted: bool, cut: float = 0.5) -> DataFrame:
    """Signal of a cohort over the bars its members share: mean probability over a half, or most votes.

    ``bars`` has member, at, pred, prob and ret. The market's return is the first member's.
    """
    mean = F.avg("prob") if weighted else F.avg((F.col("pred") > cut).cast("double"))
    out = shared(bars).groupBy("at").agg((mean > 0.5).cast("int").alias("signal"), F.min_by("ret", "member").alias("ret"))
    return out.select(F.lit("cohort").alias("member"), "at", "signal", "ret")


def judge(bars: DataFrame, weighted: bool, fee_bps: float = FEE_BPS, slip_bps: float = SLIP_BPS, cut: float = 0.5) -> DataFrame:
    """The cohort and each member executed alike over the shared bars: whole and by halves.

    No bar is in the second half of which any member's own second half doesn't hold; bars between are in neither.
    """
    n, place = F.count("*").over(W.partitionBy("member")), F.row_number().over(W.partitionBy("member").orderBy("at")) - 1
    starts = bars.withColumn("_p", place).withColumn("_n", n).where(F.col("_p") == F.floor(F.col("_n") / 2)).agg(F.min("at").alias("_a"), F.max("at").alias("_b"))
    own = shared(bars).select("member", "at", (F.col("pred") > cut).cast("int").alias("signal"), "ret")
    market = ensemble(bars, weighted, cut)
    rows = own.drop("ret").join(market.select("at", "ret"), "at").select("member", "at", "signal", "ret").unionByName(market)
    done = long_flat(rows, fee_bps, slip_bps).crossJoin(F.broadcast(starts))  # one row
    half = F.when(F.col("at") < F.col("_a"), "first").when(F.col("at") >= F.col("_b"), "second")
    parts = done.withColumn("part", F.explode(F.array_compact(F.array(F.lit("whole"), half))))
    keyed = parts.withColumn("member", F.concat_ws("\n", "member", "part")).drop("part", "_a", "_b")
    out = windows(keyed)
    return out.withColumns({"part": F.substring_index("member", "\n", -1), "member": F.substring_index("member", "\n", 1)})


def costs_of(rounds: DataFrame) -> DataFrame:
    """The commonest pair of fee and slippage; at equal counts the cheaper."""
    pair = rounds.select(F.coalesce("fee_bps", F.lit(FEE_BPS)).alias("fee"), F.coalesce("slip_bps", F.lit(SLIP_BPS)).alias("slip"))
    return pair.groupBy("fee", "slip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("fee") + F.col("slip")).limit(1)


def bar_times(rounds: DataFrame) -> DataFrame:
    """(member, at) from ``first``, ``last``, ``step`` seconds and ``missing``: the rebuilt times of a round's bars."""
    every = F.sequence("first", "last", F.make_dt_interval(secs=F.col("step")))
    return rounds.select("member", F.explode(F.array_except(every, F.coalesce("missing", F.array().cast("array<timestamp>")))).alias("at"))


def held_back(rounds: DataFrame) -> DataFrame:
    """How many rounds never fired, and of those how many came within reach; the lower median of the shortfall."""
    never = F.col("fired") == 0
    counts = rounds.agg(
        F.count("*").alias("rounds"), F.sum(never.cast("int")).alias("never"), F.sum((never & (F.col("reach") > 0)).cast("int")).alias("within_reach"),
        F.sum(F.col("fired").isNull().cast("int")).alias("unknown"), F.lit(shortfall(rounds)).cast("double").alias("shortfall"),
    )
    return counts
