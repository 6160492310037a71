"""The feature table: 84 columns of shape, momentum, levels, sessions, volume and regime for every bar, and coarser context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import W, define, is_true, lag, resolve, rolling
from . import bars as B
from .asof import asof_join

FEATURES: list[str] = []
_PI = "3.141592653589793"


def feature(name: str, expression: str) -> None:
    """Column f_<name>, always a double."""
    define(f"f_{name}", f"CAST({expression} AS DOUBLE)")
    FEATURES.append(f"f_{name}")


def _number(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _streak(name: str, condition: str) -> str:
    """Bars since the condition last failed, up to this one."""
    define(f"{name}_on", is_true(condition))
    define(f"{name}_off_at", f"CASE WHEN NOT {name}_on THEN bar_idx END")
    return define(f"{name}_streak", f"bar_idx - coalesce(max({name}_off_at) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)")


# shape
feature("body_ratio", "body_ratio")
feature("upper_wick_ratio", "coalesce(upper_shadow / bar_range, 0)")
feature("lower_wick_ratio", "coalesce(lower_shadow / bar_range, 0)")
feature("is_bullish", _number("bullish"))
feature("atr_norm", "atr / nullif(close, 0)")
for _n in (1, 3, 5, 10, 20, 50):
    feature(f"return_{_n}", f"return_{_n}")
    feature(f"return_{_n}_atr_norm", f"(close - close_lag_{_n}) / safe_atr")
for _n in (10, 20, 50, 100, 200):
    feature(f"dist_sma_{_n}_atr_norm", f"(close - sma_{_n}) / safe_atr")
feature("rsi_14", "rsi")
feature("macd_line_norm", "macd / nullif(close, 0)")
feature("macd_hist_norm", "macd_hist / nullif(close, 0)")
feature("adx_14", "adx")
feature("donchian_position", "donchian_position_20")
feature("volatility_ratio", "volatility_ratio")
# time
define("day_fraction", "(hour(ts) * 60 + minute(ts)) / CAST(1440 AS DOUBLE)")
feature("hour_sin", f"sin(2 * {_PI} * day_fraction)")
feature("hour_cos", f"cos(2 * {_PI} * day_fraction)")
feature("day_of_week", "WEEKDAY(ts)")
for _s in B.SESSIONS:
    for _e in ("open", "close"):
        feature(f"session_{_s}_{_e}", _number(f"session_{_s}_{_e}"))
# levels; the sign tells the side
feature("dist_to_swing_high_atr", "(swing_high - close) / safe_atr")
feature("dist_to_swing_low_atr", "(close - swing_low) / safe_atr")
feature("dist_to_round_number_atr", "(close - round_level) / safe_atr")
feature("dist_to_pivot_r1_atr", "(pivot_r1 - close) / safe_atr")
feature("dist_to_pivot_s1_atr", "(close - pivot_s1) / safe_atr")
# tests of a level since it came into force, and the share of them that closed beyond it
for _x, _name, _touch, _broken in (("high", "resistance", "high >= swing_high - 0.5 * atr", "close > swing_high"), ("low", "support", "low <= swing_low + 0.5 * atr", "close < swing_low")):
    _l = f"swing_{_x}"
    define(f"{_l}_1", lag(_l))
    define(f"{_l}_new", f"CASE WHEN {_l} = {_l}_1 OR ({_l} IS NULL AND {_l}_1 IS NULL) THEN 0 ELSE 1 END")
    define(f"{_l}_segment", f"sum({_l}_new) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    define(f"{_l}_test", f"CASE WHEN {_touch} THEN 1 ELSE 0 END")
    define(f"{_l}_break", f"CASE WHEN {_touch} AND {_broken} THEN 1 ELSE 0 END")
    _s = f"(PARTITION BY symbol, timeframe, {_l}_segment ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    define(f"{_l}_tests", f"CASE WHEN {_l} IS NOT NULL THEN CAST(sum({_l}_test) OVER {_s} AS DOUBLE) END")
    define(f"{_l}_breaks", f"CASE WHEN {_l} IS NOT NULL THEN CAST(sum({_l}_break) OVER {_s} AS DOUBLE) END")
    feature(f"{_name}_test_count", f"{_l}_tests")
    feature(f"{_name}_break_rate", f"{_l}_breaks / nullif({_l}_tests, 0)")
# opening ranges: the first three bars from each session's open, from the third on
for _s in B.SESSIONS:
    define(f"{_s}_ordinal", f"sum(CASE WHEN session_{_s}_open THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    define(f"{_s}_place", f"row_number() OVER (PARTITION BY symbol, timeframe, {_s}_ordinal ORDER BY ts)")
    for _x, _agg in (("high", "max"), ("low", "min")):
        define(f"{_s}_head_{_x}", f"CASE WHEN {_s}_place <= 3 THEN {_x} END")
        define(f"{_s}_range_{_x}", f"CASE WHEN {_s}_ordinal > 0 AND {_s}_place >= 3 THEN {_agg}({_s}_head_{_x}) OVER (PARTITION BY symbol, timeframe, {_s}_ordinal ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END")
    feature(f"dist_to_{_s}_open_range_high_atr", f"({_s}_range_high - close) / safe_atr")
    feature(f"dist_to_{_s}_open_range_low_atr", f"(close - {_s}_range_low) / safe_atr")
# streaks and trends
_streak("bull", "close > open")
_streak("not_bull", "NOT coalesce(close > open, false)")
_streak("higher_highs", "high > high_1")
_streak("lower_lows", "low < low_1")
feature("candle_direction_streak", "bull_streak - not_bull_streak")
feature("higher_high_streak", "higher_highs_streak")
feature("lower_low_streak", "lower_lows_streak")
for _n in (3, 5, 8):
    define(f"body_lag_{_n}", lag("body", _n))
    feature(f"body_size_trend_{_n}", f"(body - body_lag_{_n}) / {_n} / safe_atr")
feature("candle_overlap_atr", "greatest(least(high, high_1) - greatest(low, low_1), 0) / safe_atr")
feature("gap_atr_norm", "(open - close_1) / nullif(atr_1, 0)")
feature("range_vs_atr", "(high - low) / safe_atr")
define("volume_base", rolling("avg", "volume", 100, prior=True))
feature("volume_ratio", "volume / nullif(volume_base, 0)")
feature("volume_percentile", "volume_percentile")
for _n in (3, 5, 10):
    define(f"volume_lag_{_n}", lag("volume", _n))
    feature(f"volume_trend_{_n}", f"(volume - volume_lag_{_n}) / {_n} / nullif(volume_base, 0)")
feature("ask_bid_volume_imbalance", "(ask_volume - bid_volume) / nullif(ask_volume + bid_volume, 0)")
define("tick_base", rolling("avg", "tick_count", 100, prior=True))
feature("tick_count_ratio", "tick_count / nullif(tick_base, 0)")
feature("volatility_percentile", "atr_percentile")
define("month_days", "CAST(day(last_day(ts)) AS DOUBLE)")
define("month_day", "CAST(day(ts) AS DOUBLE)")
feature("day_of_month_sin", f"sin(2 * {_PI} * month_day / month_days)")
feature("day_of_month_cos", f"cos(2 * {_PI} * month_day / month_days)")
feature("is_month_end", _number("month_days - month_day <= 2"))
feature("is_quarter_end", _number("month_days - month_day <= 2 AND month(ts) % 3 = 0"))
feature("return_autocorr_50", "autocorr_50")
feature("efficiency_ratio_20", "efficiency_ratio_20")
# phases: trending or ranging, and on which side
define("phase", "CASE WHEN efficiency_ratio_20 IS NULL OR donchian_position_20 IS NULL OR return_20 IS NULL THEN NULL WHEN efficiency_ratio_20 >= 0.3 THEN CASE WHEN return_20 > 0 THEN 'markup' ELSE 'markdown' END WHEN donchian_position_20 < 0.5 THEN 'accumulation' ELSE 'distribution' END")
for _x in ("markup", "markdown", "accumulation", "distribution"):
    feature(f"regime_{_x}", _number(f"phase = '{_x}'"))
define("phase_1", lag("phase"))
define("phase_start", "CASE WHEN phase = phase_1 THEN NULL ELSE bar_idx END")
feature("regime_duration", f"CASE WHEN phase IS NOT NULL THEN bar_idx - max(phase_start) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 END")

#: The columns that coarser bars lend to finer ones.
COARSE = [f"f_{x}" for x in ("dist_sma_50_atr_norm", "rsi_14", "adx_14", "volatility_ratio", "volatility_percentile", "donchian_position", "efficiency_ratio_20")]


def features(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """symbol, timeframe, ts, bar_idx and the named features (all by default) of every bar."""
    names = FEATURES if names is None else names
    return resolve(bars, ["bar_idx", *names]).select("symbol", "timeframe", "ts", "bar_idx", *names)


def coarser(fine: DataFrame, coarse: DataFrame, minutes: int, names: list[str] | None = None) -> DataFrame:
    """Fine bars with the last coarse bar that was closed at their time: columns ctx_<name>."""
    names = COARSE if names is None else names
    c = resolve(coarse, names).select("symbol", F.expr(f"ts + INTERVAL {minutes} MINUTES").alias("closed_at"), *[F.col(n).alias("ctx_" + n.removeprefix("f_")) for n in names])
    return asof_join(fine, c, ["symbol"], "ts", "closed_at", ["ctx_" + n.removeprefix("f_") for n in names])
