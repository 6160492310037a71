"""The trade journal: results, scorecards, equity, drawdown, breaker, context effects, vote and plan of a signal.

Journal rows are those of sources.market.journal. actual_r is the logged reward ratio for a win and -1 for a loss; costs are COST in units of risk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.registry import resolve

COST, MIN_LIVE, MIN_CONTEXT, MIN_RATE = 0.05, 10, 15, 0.60
MAX_LOSSES, MAX_DRAWDOWN, MAX_OPEN = 8, -15.0, 6
PENALTY = 0.5
WEIGHTS = {"1min": 0.5, "5min": 0.75, "15min": 1.0, "1h": 1.5, "4h": 2.0, "1d": 2.5}
GROUP = ["pattern", "timeframe", "direction"]


def resolved(journal: DataFrame, rr: float = 4.0) -> DataFrame:
    """Won and lost trades with actual_r, actual_r_after_costs. A plan's own rr_ratio column, if there is one, goes before ``rr``."""
    ratio = F.coalesce(F.col("rr_ratio"), F.lit(rr)) if "rr_ratio" in journal.columns else F.lit(rr)
    return journal.where("outcome in ('win', 'loss')").withColumn("actual_r", F.when(F.col("outcome") == "win", ratio).otherwise(-1.0)).withColumn("actual_r_after_costs", F.col("actual_r") - COST)


def summary(journal: DataFrame) -> DataFrame:
    """Counts by state and the live win rate."""
    wins, losses = F.count_if(F.col("outcome") == "win"), F.count_if(F.col("outcome") == "loss")
    return journal.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "open").alias("open"), wins.alias("wins"), losses.alias("losses"), F.round(wins / F.nullif(wins + losses, F.lit(0)), 6).alias("live_win_rate"))


def _label(n: Column, low: Column, high: Column, mined: Column) -> Column:
    return F.when(n < MIN_LIVE, "UNPROVEN").when(high < mined, "DECAYING").when(low >= MIN_RATE, "CONFIRMED").otherwise("WATCH")


def scorecard(journal: DataFrame, library: DataFrame) -> DataFrame:
    """Live results of each pattern, timeframe and direction, with its credibility against the library's win rate (pattern, timeframe, direction, mined_win_rate)."""
    n, wins = F.count(F.lit(1)), F.count_if(F.col("outcome") == "win")
    g = resolved(journal).groupBy(*GROUP).agg(n.alias("live_samples"), wins.alias("wins"), F.round(wins / n, 6).alias("live_win_rate"), F.round(F.sum("actual_r"), 6).alias("total_r"), F.round(F.sum("actual_r_after_costs"), 6).alias("total_r_after_costs"))
    g = g.join(library, GROUP, "left")
    c = F.col
    low, high = stats.wilson_lower(c("wins"), c("live_samples")), stats.wilson_upper(c("wins"), c("live_samples"))
    g = g.withColumn("wilson_low", low).withColumn("wilson_high", high).withColumn("label", _label(c("live_samples"), c("wilson_low"), c("wilson_high"), c("mined_win_rate")))
    proven = c("live_samples") >= MIN_LIVE
    return g.withColumn("wilson_low", F.when(proven, F.round("wilson_low", 6))).withColumn("wilson_high", F.when(proven, F.round("wilson_high", 6)))


def suspended(card: DataFrame) -> DataFrame:
    return card.where("label = 'DECAYING'").select(*GROUP)


def drift(card: DataFrame) -> DataFrame:
    """Patterns with enough live trades and a mined rate, and whether they decay."""
    return card.where(f"live_samples >= {MIN_LIVE} and mined_win_rate is not null").select(*GROUP, "live_win_rate", "live_samples", "wilson_high", "mined_win_rate", (F.col("label") == "DECAYING").alias("decaying"))


def should_self_heal(card: DataFrame, age_days: float) -> DataFrame:
    """One row: decaying patterns, and whether to mine again (three of them, or a library a day old)."""
    return card.agg(F.count_if(F.col("label") == "DECAYING").alias("n_decaying")).withColumn("rebuild", (F.col("n_decaying") >= 3) | F.lit(age_days >= 1.0))


CONTEXT = {
    "confluence_count": "CASE WHEN confluence_count >= 3 THEN '3+' ELSE cast(confluence_count AS string) END",
    "session_at_entry": "session_at_entry",
    "volatility_shock_ratio": "CASE WHEN volatility_shock_ratio < 1.3 THEN 'normal' WHEN volatility_shock_ratio < 2.0 THEN 'elevated' WHEN volatility_shock_ratio >= 2.0 THEN 'shock' END",
}


def context_scorecard(journal: DataFrame) -> DataFrame:
    """Results per context bucket against the pattern's other trades; a bucket is decaying when both sides have 15 trades and its upper bound lies below the others' rate."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.expr(e).alias("bucket")) for k, e in CONTEXT.items()])
    long = resolved(journal).select(*GROUP, "outcome", F.explode(pairs).alias("p")).select(*GROUP, "outcome", "p.*").where("bucket is not null")
    g = long.groupBy(*GROUP, "dimension", "bucket").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("outcome") == "win").alias("wins"))
    w = Window.partitionBy(*GROUP, "dimension")
    g = g.withColumn("rest", F.sum("samples").over(w) - F.col("samples")).withColumn("rest_wins", F.sum("wins").over(w) - F.col("wins")).where(f"samples >= {MIN_CONTEXT}")
    base = F.when(F.col("rest") >= MIN_CONTEXT, F.col("rest_wins") / F.col("rest"))
    high = stats.wilson_upper(F.col("wins"), F.col("samples"))
    g = g.withColumn("baseline", base).withColumn("decaying", F.coalesce(high < F.col("baseline"), F.lit(False)))
    return g.select(*GROUP, "dimension", "bucket", "samples", "wins", F.round(F.col("wins") / F.col("samples"), 6).alias("win_rate"), F.round(high, 6).alias("wilson_high"), F.round("baseline", 6).alias("baseline"), "decaying")


def context_penalty(signals: DataFrame, card: DataFrame) -> DataFrame:
    """Signals (pattern, timeframe, direction, confluence_count, session_at_entry) with multiplier: 0.5 where a bucket known beforehand is decaying."""
    bad = card.where("decaying and dimension <> 'volatility_shock_ratio'").select(*GROUP, F.concat_ws("=", "dimension", "bucket").alias("key")).groupBy(*GROUP).agg(F.collect_set("key").alias("bad"))
    out = signals.join(bad, GROUP, "left")
    own = F.array(*[F.concat_ws("=", F.lit(k), F.expr(CONTEXT[k])) for k in ("confluence_count", "session_at_entry")])
    return out.withColumn("multiplier", F.when(F.arrays_overlap(own, F.col("bad")), PENALTY).otherwise(1.0)).drop("bad")


#: Order of the trades: by time, then identifier.
_BY_TIME = ["logged_at_utc", "signal_id"]


def equity_curve(journal: DataFrame, by: str = "timeframe") -> DataFrame:
    """Cumulative results of resolved trades in order, with peak and drawdown, per value of ``by`` (each is an engine of its own)."""
    w = Window.partitionBy(by).orderBy(*_BY_TIME).rowsBetween(Window.unboundedPreceding, 0)
    e = resolved(journal).withColumn("cumulative_r", F.sum("actual_r").over(w)).withColumn("cumulative_r_after_costs", F.sum("actual_r_after_costs").over(w))
    return e.withColumn("peak", F.max("cumulative_r").over(w)).withColumn("drawdown", F.expr("cumulative_r - peak")).select(by, *_BY_TIME, "pattern", "outcome", "actual_r", "cumulative_r", "cumulative_r_after_costs", "peak", "drawdown")


def current_streak(journal: DataFrame, by: str = "timeframe") -> DataFrame:
    """The last outcome of each engine and how many trades in a row have had it."""
    back = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in _BY_TIME])
    r = resolved(journal).withColumn("k", F.row_number().over(back)).withColumn("last", F.first("outcome").over(back))
    return r.groupBy(by).agg(F.max("last").alias("streak_type"), (F.coalesce(F.min(F.when(F.col("outcome") != F.col("last"), F.col("k"))) - 1, F.count(F.lit(1)))).cast("bigint").alias("streak_length"))


def circuit_breaker(journal: DataFrame, by: str = "timeframe") -> DataFrame:
    """One row per engine: streak, drawdown, open trades and which of them trip; an engine without resolved trades has none of the first two."""
    streak = current_streak(journal, by)
    fall = equity_curve(journal, by).groupBy(by).agg(F.round(F.min("drawdown"), 6).alias("max_drawdown_r"))
    state = journal.groupBy(by).agg(F.count_if(F.col("status") == "open").alias("open_trades"))
    out = state.join(streak, by, "left").join(fall, by, "left").fillna({"max_drawdown_r": 0.0})
    losing = F.coalesce((F.col("streak_type") == "loss") & (F.col("streak_length") >= MAX_LOSSES), F.lit(False))
    out = out.withColumn("losing", losing).withColumn("fallen", F.col("max_drawdown_r") <= MAX_DRAWDOWN).withColumn("crowded", F.col("open_trades") >= MAX_OPEN)
    return out.withColumn("tripped", F.expr("losing or fallen or crowded"))


def overall(journal: DataFrame) -> DataFrame:
    """One row of results over all resolved trades."""
    n, wins = F.count(F.lit(1)), F.count_if(F.col("outcome") == "win")
    r = lambda c, x: F.round(c, 6).alias(x)
    return resolved(journal).agg(
        n.alias("resolved"), wins.alias("wins"), r(stats.wilson_lower(wins, n), "wilson_low"), r(stats.wilson_upper(wins, n), "wilson_high"), r(F.sum("actual_r"), "total_r"), r(F.avg("actual_r"), "avg_r"),
        r(F.avg("actual_r_after_costs"), "avg_r_after_costs"), r(F.max("actual_r"), "best_r"), r(F.min("actual_r"), "worst_r"),
    )


def new_entries(signals: DataFrame, journal: DataFrame, key: tuple[str, ...] = ("timeframe", "pattern", "entry_candle_timestamp")) -> DataFrame:
    """Signals that the journal doesn't hold yet; appended as they are."""
    return signals.join(journal.select(*key), list(key), "left_anti")


def vote(active: DataFrame, library: DataFrame, decaying: DataFrame) -> DataFrame:
    """One row per symbol: BUY, SELL or HOLD by weighted vote of the active patterns.

    active: symbol, timeframe, pattern, direction, regime_ok, coarse_ok. library: pattern, timeframe, direction, resolved, win_rate,
    wilson_lower of what qualifies. Suspended directions are taken out first, so a pattern falls to its next direction; of each symbol, timeframe
    and direction the heaviest counts; ties go by pattern.
    """
    q = active.join(library, GROUP).join(decaying, GROUP, "left_anti")
    first = Window.partitionBy("symbol", "timeframe", "pattern").orderBy(F.col("win_rate").desc(), "direction")
    q = q.withColumn("k", F.row_number().over(first)).where("k = 1")
    scale = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    half = lambda c: F.when(F.coalesce(F.col(c), F.lit(True)), 1.0).otherwise(PENALTY)
    q = q.withColumn("weight", F.coalesce(F.try_element_at(scale, F.col("timeframe")), F.lit(1.0)) * F.col("wilson_lower") * F.least(F.col("resolved") / 200, F.lit(1.0)) * half("regime_ok") * half("coarse_ok"))
    best = Window.partitionBy("symbol", "timeframe", "direction").orderBy(F.col("weight").desc(), "pattern")
    used = q.withColumn("k", F.row_number().over(best)).where("k = 1")
    bull, bear = F.col("direction") == 1, F.col("direction") == -1
    top = lambda side: F.max_by(F.struct("wilson_lower", "pattern", "timeframe"), F.when(side, F.struct("weight", "timeframe", "pattern")))
    v = used.groupBy("symbol").agg(F.coalesce(F.sum(F.when(bull, F.col("weight"))), F.lit(0.0)).alias("bull"), F.coalesce(F.sum(F.when(bear, F.col("weight"))), F.lit(0.0)).alias("bear"), top(bull).alias("top_bull"), top(bear).alias("top_bear"))
    v = v.withColumn("signal", F.expr("case when bull > bear then 'BUY' when bear > bull then 'SELL' else 'HOLD' end")).withColumn("top", F.expr("case signal when 'BUY' then top_bull when 'SELL' then top_bear end"))
    v = v.withColumn("agreement", F.coalesce(F.abs(F.col("bull") - F.col("bear")) / F.nullif(F.col("bull") + F.col("bear"), F.lit(0.0)), F.lit(0.0)))
    return v.select("symbol", "signal", "bull", "bear", "agreement", F.coalesce(100 * F.col("top.wilson_lower") * F.col("agreement"), F.lit(0.0)).alias("confidence"), F.col("top.pattern").alias("primary_pattern"), F.col("top.timeframe").alias("primary_timeframe"))


def trade_plan(bars: DataFrame, rr: float = 4.0, stop_atr: float = 1.5) -> DataFrame:
    """Plan of a trade at the close of the last bar of each series, in both directions; none where the ATR is unknown or 0."""
    w = Window.partitionBy("symbol", "timeframe").orderBy(F.col("ts").desc())
    last = resolve(bars, ["atr"]).withColumn("k", F.row_number().over(w)).where("k = 1 and atr > 0")
    risk = F.col("atr") * stop_atr
    sided = last.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("risk", risk)
    return sided.select("symbol", "timeframe", "ts", "direction", F.col("close").alias("entry"), (F.col("close") - F.col("direction") * F.col("risk")).alias("stop_loss"), (F.col("close") + F.col("direction") * rr * F.col("risk")).alias("take_profit"), "risk")


def freshness(bars: DataFrame, minutes: Column, now: str) -> DataFrame:
    """Age of each series' last closed bar at ``now``, and whether it is older than three bars."""
    last = bars.groupBy("symbol", "timeframe").agg(F.max("ts").alias("ts")).withColumn("closed_at", F.expr("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes))
    age = F.expr(f"timestampdiff(SECOND, closed_at, timestamp_ntz'{now}') / 60.0D")
    return last.withColumn("age_minutes", age).withColumn("stale", F.col("age_minutes") > 3 * minutes)


def position_size(plans: DataFrame, account: float, risk_pct: float, contract: float = 100.0) -> DataFrame:
    """Plans with dollar_risk, units and lots; settings or a risk that aren't positive are an error."""
    if account <= 0 or not 0 < risk_pct <= 100 or contract <= 0:
        raise ValueError("account, risk_pct and contract must be positive")
    risk = F.when(F.col("risk") > 0, F.col("risk")).otherwise(F.raise_error(F.lit("risk per unit must be positive")).cast("double"))
    return plans.withColumn("dollar_risk", F.lit(account * risk_pct / 100)).withColumn("units", F.col("dollar_risk") / risk).withColumn("lots", F.col("units") / contract)


def volatility_shock(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Mean ATR over each resolved trade over the ATR at its signal, by prefix sums of the ATR."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("ts")
    b = resolve(bars, ["bar_idx", "atr"]).select("symbol", "timeframe", "bar_idx", "atr", F.sum(F.coalesce("atr", F.lit(0.0))).over(w).alias("total"))
    t = trades.where("bars_to_resolve is not null").withColumn("end_idx", F.expr("bar_idx + 1 + bars_to_resolve"))
    start = b.select("symbol", "timeframe", "bar_idx", F.col("atr").alias("atr0"), F.col("total").alias("total0"))
    end = b.select("symbol", "timeframe", F.col("bar_idx").alias("end_idx"), F.col("total").alias("total1"))
    return t.join(start, ["symbol", "timeframe", "bar_idx"]).join(end, ["symbol", "timeframe", "end_idx"]).withColumn("shock_ratio", F.expr("(total1 - total0) / (end_idx - bar_idx) / nullif(atr0, 0)"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of probability over its range, right-closed: n, mean probability, win rate; and the Brier score over all. scored: p, won."""
    w = Window.partitionBy(F.lit(1))
    span = scored.agg(F.min("p").alias("lo"), F.max("p").alias("hi")).withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    k = F.expr(f"if(step > 0, greatest(0, least({bins - 1}, ceil((p - lo) / step) - 1)), 0)")
    g = scored.crossJoin(F.broadcast(span)).withColumn("bin", k.cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("won").cast("double")).alias("win_rate"), F.sum(F.pow(F.col("p") - F.col("won").cast("double"), F.lit(2))).alias("squares"))
    return g.withColumn("brier", F.sum("squares").over(w) / F.sum("n").over(w)).drop("squares")


def backtest_stats(trades: DataFrame) -> DataFrame:
    """One row of profit factor, mean, deviation and totals of net_r (resolved trades)."""
    t = trades.where("outcome <> 'unresolved'")
    gain, fall = F.sum(F.greatest(F.col("net_r"), F.lit(0.0))), F.sum(F.greatest(-F.col("net_r"), F.lit(0.0)))
    return t.groupBy("symbol", "timeframe", "direction").agg(F.count(F.lit(1)).alias("n"), F.round(gain / F.nullif(fall, F.lit(0.0)), 6).alias("profit_factor"), F.round(F.avg("net_r"), 6).alias("mean_r"), F.round(F.stddev_samp("net_r"), 6).alias("std_r"))
