"""Queries over bars alone: resampling, sources' merges, indicators, patterns and primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import EXPRESSIONS, define, is_true, select, sql
from ..operators import bars as B
from ..operators import calendar
from ..operators.primitives import PRIMITIVES, column
from ..sources import market, merge, scratch
from .common import ALL, FINE, bars, bars_sql, rounded, rounded_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
_KEYS = ("symbol", "timeframe", "ts")


def _over_bars(name: str, names: list[str], doubles: list[str] | None = None, timeframes: tuple[str, ...] = FINE, digits: int = 6) -> None:
    """A query of named columns over the bars of some sizes, and over all sizes as <name>_all; doubles (by default all) are rounded."""
    doubles = names if doubles is None else doubles
    QUERIES[f"{name}_all"] = lambda spark, d: rounded(select(bars(spark, d, ALL), names), digits)
    QUERIES[name] = lambda spark, d: rounded(select(bars(spark, d, timeframes), names), digits)
    SQL[name] = rounded_sql(sql(bars_sql(timeframes), names), doubles, digits)


def _flags(name: str, names: list[str], timeframes: tuple[str, ...] = ("1h",)) -> None:
    _over_bars(name, names, [], timeframes)


# resampling and merges
for _tf in market.TIMEFRAMES:
    QUERIES[f"ohlc_resample_{_tf}"] = lambda spark, d, tf=_tf: rounded(market.candles(spark, d, (tf,)), 4)
    SQL[f"ohlc_resample_{_tf}"] = rounded_sql(market.candles_sql((_tf,)), ["open", "high", "low", "close", "volume", "ask_volume", "bid_volume"], 4)
QUERIES["daily_candles"] = lambda spark, d: rounded(market.daily_candles(spark, d), 4)
SQL["daily_candles"] = rounded_sql(market.DAILY_SQL, ["open", "high", "low", "close", "volume", "ask_volume", "bid_volume"], 4)


def _two_feeds(spark, d) -> DataFrame:
    """The hourly candles as two feeds: dukascopy has even hours, mt_broker all, with prices a little off."""
    c = market.candles(spark, d, ("1h",))
    feed = c.where("hour(ts) % 2 = 0").withColumn("source", F.lit("dukascopy"))
    broker = c.withColumns({x: F.col(x) + 0.01 for x in ("open", "high", "low", "close")}).withColumns({x: F.lit(None).cast("double") for x in ("ask_volume", "bid_volume")}).withColumn("source", F.lit("mt_broker"))
    return feed.unionByName(broker)


_FEEDS = f"""
SELECT * REPLACE ('dukascopy' AS source) FROM ({market.candles_sql(("1h",))}) c WHERE hour(ts) % 2 = 0
UNION ALL SELECT * REPLACE ('mt_broker' AS source, open + 0.01 AS open, high + 0.01 AS high, low + 0.01 AS low, close + 0.01 AS close, NULL AS ask_volume, NULL AS bid_volume) FROM ({market.candles_sql(("1h",))}) c
"""
_PRICES = ["open", "high", "low", "close", "volume", "ask_volume", "bid_volume"]
QUERIES["priority_upsert"] = lambda spark, d: rounded(merge.upsert(_two_feeds(spark, d)), 4)
SQL["priority_upsert"] = rounded_sql(f"SELECT * FROM ({_FEEDS}) f QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, ts ORDER BY CASE source WHEN 'dukascopy' THEN 2 WHEN 'mt_broker' THEN 1 ELSE 0 END DESC) = 1", _PRICES, 4)
QUERIES["order_flow_merge"] = lambda spark, d: rounded(merge.update_columns(merge.upsert(_two_feeds(spark, d)), market.candles(spark, d, ("1h",)).where("hour(ts) % 3 = 0"), ["ask_volume", "bid_volume", "tick_count"]), 4)
SQL["order_flow_merge"] = rounded_sql(
    f"SELECT b.* REPLACE (coalesce(n.ask_volume, b.ask_volume) AS ask_volume, coalesce(n.bid_volume, b.bid_volume) AS bid_volume, coalesce(n.tick_count, b.tick_count) AS tick_count) FROM ({SQL['priority_upsert']}) b LEFT JOIN (SELECT * FROM ({market.candles_sql(('1h',))}) c WHERE hour(ts) % 3 = 0) n USING (symbol, timeframe, ts)",
    _PRICES, 4,
)
QUERIES["gap_detection"] = lambda spark, d: rounded(merge.gaps(bars(spark, d, ("5min", "1h")), hours=1.0))
SQL["gap_detection"] = rounded_sql(
    f"SELECT symbol, timeframe, gap_from, gap_to, gap_hours FROM (SELECT symbol, timeframe, lag(ts) OVER w AS gap_from, ts AS gap_to, epoch_us(ts - lag(ts) OVER w) / 3600000000.0 AS gap_hours FROM ({bars_sql(('5min', '1h'))}) b WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY ts)) WHERE gap_hours > greatest(1.0, 3.0 * CASE timeframe {' '.join(f'WHEN {k!r} THEN {v}' for k, v in market.TIMEFRAMES.items())} END / 60)",
    ["gap_hours"],
)
QUERIES["coverage_check"] = lambda spark, d: merge.coverage(market.candles(spark, d, ("15min", "1h")), "2024-01-01", "2024-01-31")
SQL["coverage_check"] = f"""
SELECT symbol, timeframe, n_bars, n_bars >= 0.4 * 720 * 5 / 7 * (60.0 / CASE timeframe WHEN '15min' THEN 15 ELSE 60 END) AS covered
FROM (SELECT symbol, timeframe, count(*) AS n_bars FROM ({market.candles_sql(("15min", "1h"))}) c WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL)
"""
QUERIES["tick_sanity"] = lambda spark, d: rounded(merge.sanity(market.ticks(spark, d), 1.0, 300.0))
SQL["tick_sanity"] = rounded_sql(f"SELECT symbol, date_trunc('hour', ts) AS hour, count(*) AS n_ticks, avg(CASE WHEN mid < 1.0 OR mid > 300.0 THEN 1.0 ELSE 0.0 END) AS bad_share, avg(CASE WHEN mid < 1.0 OR mid > 300.0 THEN 1.0 ELSE 0.0 END) > 0.01 AS rejected FROM ({market.TICKS_SQL}) t GROUP BY 1, 2", ["bad_share"])
QUERIES["dedup_ticks"] = lambda spark, d: rounded(merge.dedup_ticks(market.ticks(spark, d).unionByName(market.ticks(spark, d).where("ask_volume > 50"))))
SQL["dedup_ticks"] = rounded_sql(f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY mid, ask NULLS FIRST, bid NULLS FIRST, ask_volume NULLS FIRST, bid_volume NULLS FIRST) AS k FROM ({market.TICKS_SQL}) t) u WHERE k = 1", ["mid", "ask", "bid", "ask_volume", "bid_volume"])
QUERIES["last_bar"] = lambda spark, d: merge.last_bar(bars(spark, d, FINE))
SQL["last_bar"] = f"SELECT symbol, timeframe, max(ts) AS last_ts, count(*) AS n_bars FROM ({bars_sql(FINE)}) b GROUP BY ALL"
QUERIES["storage_by_source"] = lambda spark, d: merge.storage(_two_feeds(spark, d))
SQL["storage_by_source"] = f"SELECT timeframe, source, count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts FROM ({_FEEDS}) f GROUP BY 1, 2"
QUERIES["candle_tail"] = lambda spark, d: rounded(merge.tail(bars(spark, d), 300), 4)
SQL["candle_tail"] = rounded_sql(f"SELECT * FROM ({bars_sql()}) b QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) <= 300", _PRICES, 4)

# indicators
_over_bars("bar_shape", ["body", "bar_range", "body_high", "body_low", "upper_shadow", "lower_shadow", "bullish", "bearish", "body_ratio"], ["body", "bar_range", "body_high", "body_low", "upper_shadow", "lower_shadow", "body_ratio"])
_over_bars("sma", [f"sma_{n}" for n in B.SMA_WINDOWS])
_over_bars("rsi", ["rsi"])
_over_bars("atr", ["true_range", "atr"])
_over_bars("bollinger", ["bb_mid", "bb_upper", "bb_lower", "bb_position"])
_over_bars("stochastic", ["stoch_k", "stoch_d"])
_over_bars("session_vwap", ["vwap"])
_over_bars("obv", ["obv"])
_over_bars("donchian_position", ["donchian_high_20", "donchian_low_20", *[f"donchian_position_{n}" for n in (10, 20, 30, 50, 75)]])
_over_bars("rolling_slope", [f"slope_{n}" for n in (5, 8, 10, 15, 20, 30)])
_over_bars("acceleration", [f"acceleration_{n}" for n in (5, 8, 10, 15, 20, 30)])
_over_bars("period_returns", [f"return_{n}" for n in (1, 3, 5, 10, 20, 50, 100)])
_over_bars("volatility_ratio", ["volatility_ratio"])
_over_bars("vol_of_vol", ["vol_of_vol"])
_over_bars("volatility_regime", ["volatility_regime"], [])
_over_bars("efficiency_ratio", ["efficiency_ratio_20"])
_over_bars("pct_rank", ["volume_percentile", "atr_percentile"])
_over_bars("autocorr_lag1", ["autocorr_50"], digits=5)
_over_bars("range_position", [f"range_position_{n}" for n in (20, 50, 100)])
_over_bars("rolling_quantile_signal", ["return_quantile_90", "return_above_quantile"], ["return_quantile_90"])
_over_bars("ema", ["ema_12", "ema_26"], timeframes=("1h",))
_over_bars("macd", ["macd", "macd_signal", "macd_hist"], timeframes=("1h",))
_over_bars("adx", ["plus_di", "minus_di", "adx"], timeframes=("1h",))
_over_bars("combined_regime", ["trend_regime", "combined_regime"], [], ("1h",))
_over_bars("round_numbers", ["round_level"], timeframes=FINE)
_over_bars("consecutive_runs", ["higher_high_run", "lower_low_run"], [])

# patterns
_CANDLES = [n for n, (f, _) in B.PATTERNS.items() if f == "candlestick"]
_flags("candlestick_single", _CANDLES[:7], FINE)
_flags("candlestick_double", _CANDLES[7:17], FINE)
_flags("candlestick_triple", _CANDLES[17:], FINE)
_INDICATORS = [n for n, (f, _) in B.PATTERNS.items() if f == "indicator"]
_flags("indicator_crosses", _INDICATORS[:-2])
_flags("trend_following", _INDICATORS[-2:], FINE)
_over_bars("swing_points", ["swing_high_confirmed", "swing_low_confirmed"])
_over_bars("swing_levels", ["swing_high", "swing_high_prior", "swing_low", "swing_low_prior"])
_over_bars("daily_pivots", ["pivot_pp", "pivot_r1", "pivot_s1"])
_SR = [n for n, (f, _) in B.PATTERNS.items() if f == "support_resistance"]
_flags("sr_patterns", _SR, FINE)
_flags("liquidity_sweeps", ["smc_liquidity_sweep_low", "smc_liquidity_sweep_high"], FINE)
_flags("fair_value_gaps", ["smc_fvg_bullish", "smc_fvg_bearish", "smc_bullish_sweep_fvg", "smc_bearish_sweep_fvg"], FINE)
_flags("bos_choch", ["smc_bos_bullish", "smc_bos_bearish", "smc_choch_bullish", "smc_choch_bearish"], FINE)
_flags("equal_level_sweeps", ["smc_eq_high_sweep", "smc_eq_low_sweep"], FINE)
_over_bars("order_blocks", ["bullish_block_high", "bullish_block_low", "bearish_block_high", "bearish_block_low", "smc_near_bullish_order_block", "smc_near_bearish_order_block"], ["bullish_block_high", "bullish_block_low", "bearish_block_high", "bearish_block_low"])
_flags("premium_discount", ["smc_discount_zone", "smc_premium_zone"], FINE)
_flags("session_events", [f"session_{s}_{e}" for s in B.SESSIONS for e in ("open", "close")], FINE)
_flags("session_flags", [f"{s}_active" for s in B.SESSIONS], FINE)
_flags("killzones", [f"{s}_active" for s in B.KILLZONES], FINE)
define("session_label", "CASE WHEN " + " OR ".join(f"{s}_active" for s in B.SESSIONS) + " THEN concat_ws(',', " + ", ".join(f"CASE WHEN {s}_active THEN '{s}' END" for s in B.SESSIONS) + ") ELSE 'off_hours' END")
_flags("session_labels", ["session_label"], FINE)

# primitives, by family; the two families on joined columns get them first
_BY_FAMILY: dict[str, list[str]] = {}
for _n, (_f, _) in PRIMITIVES.items():
    _BY_FAMILY.setdefault(_f, []).append(column(_n))


def primitive_bars(spark, d, timeframes: tuple[str, ...] = ("1h",)) -> DataFrame:
    """Bars with the surprises and context series that primitives read."""
    b = calendar.attach_context(scratch.written(bars(spark, d, timeframes), "bars"), calendar.context_series(spark, d))
    return calendar.surprises(b, scratch.written(calendar.macro_events(spark, d), "events"))


def primitive_bars_sql(timeframes: tuple[str, ...] = ("1h",)) -> str:
    return calendar.surprises_sql(calendar.context_sql(bars_sql(timeframes)))


for _f, _names in _BY_FAMILY.items():
    if _f in ("fundamental", "carry"):
        QUERIES[f"primitives_{_f}"] = lambda spark, d, names=_names: select(primitive_bars(spark, d), names)
        QUERIES[f"primitives_{_f}_all"] = lambda spark, d, names=_names: select(primitive_bars(spark, d, ALL), names)
        SQL[f"primitives_{_f}"] = sql(primitive_bars_sql(), _names)
    else:
        _flags(f"primitives_{_f}", _names)

#: Names that anything may use; checked once, when this is imported.
assert all(is_true and n in EXPRESSIONS for n in B.BAR_PATTERNS)
