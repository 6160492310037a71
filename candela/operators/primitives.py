"""Discovery primitives: 310 parametrised conditions, as name -> (family, hint)."""

from __future__ import annotations

from ..functions.registry import define, is_true, lag, running
from . import bars

PRIMITIVES: dict[str, tuple[str, int]] = {}


def _add(name: str, family: str, hint: int, condition: str) -> None:
    """Column prim_<name>, dots as underscores."""
    define(column(name), is_true(condition))
    PRIMITIVES[name] = (family, hint)


def column(name: str) -> str:
    return "prim_" + name.replace(".", "_")


def _both(up: str, down: str, family: str, x: str, y: str, hint: int = 1) -> None:
    _add(up, family, hint, x)
    _add(down, family, -hint, y)


for _n in (5, 8, 10, 15, 20, 30):
    _both(f"slope_up_{_n}", f"slope_down_{_n}", "momentum", f"slope_{_n} > 0", f"slope_{_n} < 0")
    _both(f"accelerating_up_{_n}", f"accelerating_down_{_n}", "momentum", f"acceleration_{_n} > 0", f"acceleration_{_n} < 0")
# run lengths: bars since the condition last failed
define("higher_high", is_true("high > high_1"))
define("lower_low", is_true("low < low_1"))
for _x in ("higher_high", "lower_low"):
    define(f"{_x}_break", f"CASE WHEN NOT {_x} THEN bar_idx END")
    define(f"{_x}_run", f"bar_idx - coalesce({running('max', f'{_x}_break')}, -1)")
for _n in (3, 4, 5, 6, 8, 10):
    _both(f"consecutive_higher_highs_{_n}", f"consecutive_lower_lows_{_n}", "momentum", f"higher_high_run >= {_n}", f"lower_low_run >= {_n}")
for _n in range(55, 90, 5):
    _add(f"rsi_above_{_n}", "momentum", 1, f"rsi > {_n}")
for _n in range(15, 50, 5):
    _add(f"rsi_below_{_n}", "momentum", -1, f"rsi < {_n}")
_both("macd_hist_positive", "macd_hist_negative", "momentum", "macd_hist > 0", "macd_hist < 0")
for _n in range(20, 55, 5):
    _add(f"adx_above_{_n}", "momentum", 0, f"adx > {_n}")
for _n in (10, 20, 50, 100):
    _both(f"momentum_return_up_{_n}", f"momentum_return_down_{_n}", "momentum", f"return_{_n} > 0", f"return_{_n} < 0")
for _n, _p in ((20, 0.01), (20, 0.02), (50, 0.02), (50, 0.03)):
    _both(f"momentum_return_strong_up_{_n}_{_p}", f"momentum_return_strong_down_{_n}_{_p}", "momentum", f"return_{_n} > {_p}", f"return_{_n} < -{_p}")
for _p in (1.2, 1.3, 1.5, 1.75, 2.0, 2.5):
    _add(f"volatility_expansion_{_p}", "volatility", 0, f"volatility_ratio > {_p}")
for _p in (0.4, 0.5, 0.6, 0.7, 0.8):
    _add(f"volatility_contraction_{_p}", "volatility", 0, f"volatility_ratio < {_p}")
for _p in (0.2, 0.3, 0.4, 0.5, 0.6):
    _add(f"vol_of_vol_above_{_p}", "volatility", 0, f"vol_of_vol > {_p}")
_both("bb_upper_breakout", "bb_lower_breakout", "oscillator", "bb_upper_breakout", "bb_lower_breakout")
for _p in (0.9, 0.95, 1.0):
    _add(f"bb_near_upper_{_p}", "oscillator", -1, f"bb_position > {_p}")
for _p in (0.1, 0.05, 0.0):
    _add(f"bb_near_lower_{_p}", "oscillator", 1, f"bb_position < {_p}")
_both("stoch_oversold_cross", "stoch_overbought_cross", "oscillator", "stoch_oversold_cross", "stoch_overbought_cross")
for _n in (10, 20, 30):
    _add(f"stoch_below_{_n}", "oscillator", 1, f"stoch_k < {_n}")
for _n in (70, 80, 90):
    _add(f"stoch_above_{_n}", "oscillator", -1, f"stoch_k > {_n}")
_both("vwap_bullish_cross", "vwap_bearish_cross", "oscillator", "vwap_bullish_cross", "vwap_bearish_cross")
_both("above_vwap", "below_vwap", "oscillator", "close > vwap", "close < vwap")
for _n in (10, 20, 50):
    _both(f"near_range_high_{_n}", f"near_range_low_{_n}", "structure", f"donchian_position_{_n} > 0.8", f"donchian_position_{_n} < 0.2")
for _n in (10, 20, 30, 50, 75):
    for _p in (0.7, 0.75, 0.85, 0.9):
        _add(f"near_range_high_{_n}_{_p}", "structure", 1, f"donchian_position_{_n} > {_p}")
    for _p in (0.1, 0.15, 0.25, 0.3):
        _add(f"near_range_low_{_n}_{_p}", "structure", -1, f"donchian_position_{_n} < {_p}")
for _n in (10, 15, 20, 30, 50, 75, 100):
    _both(f"sma_distance_above_{_n}", f"sma_distance_below_{_n}", "structure", f"close > sma_{_n}", f"close < sma_{_n}")
for _n in (10, 20, 50):
    for _p in (0.3, 0.5, 1.0):
        _both(f"sma_distance_above_{_n}_atr{_p}", f"sma_distance_below_{_n}_atr{_p}", "structure", f"(close - sma_{_n}) / safe_atr > {_p}", f"(sma_{_n} - close) / safe_atr > {_p}")
for _p in (0.3, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0):
    _add(f"near_swing_high_{_p}", "level_swing", -1, f"abs(close - swing_high) / safe_atr < {_p}")
    _add(f"near_swing_low_{_p}", "level_swing", 1, f"abs(close - swing_low) / safe_atr < {_p}")
for _p in (0.2, 0.3, 0.5, 0.75, 1.0):
    _add(f"near_round_number_{_p}", "level_round", 0, f"abs(close - round_level) / safe_atr < {_p}")
for _p in (0.3, 0.5, 0.75, 1.0, 1.5):
    _add(f"near_pivot_r1_{_p}", "level_pivot", -1, f"abs(close - pivot_r1) / safe_atr < {_p}")
    _add(f"near_pivot_s1_{_p}", "level_pivot", 1, f"abs(close - pivot_s1) / safe_atr < {_p}")
#: Columns joined before these are evaluated: surprise z-scores of releases and daily context series.
SURPRISES = [f"{e}_surprise" for e in ("cpi", "pce", "nfp", "gdp")]
CONTEXT = ["dxy", "real_yield_10y"]
for _e in ("cpi", "pce", "nfp", "gdp"):
    for _p in (0.75, 1.0, 1.25, 1.5, 2.0):
        _both(f"fundamental_{_e}_surprise_hot_{_p}", f"fundamental_{_e}_surprise_cool_{_p}", "fundamental", f"{_e}_surprise > {_p}", f"{_e}_surprise < -{_p}")
for _x, _c in (("real_yield", "real_yield_10y"), ("dxy", "dxy")):
    for _n in (20, 100):
        define(f"{_c}_lag_{_n}", lag(_c, _n))
        _both(f"carry_{_x}_rising_{_n}", f"carry_{_x}_falling_{_n}", "carry", f"{_c} > {_c}_lag_{_n}", f"{_c} < {_c}_lag_{_n}", -1)
for _n in (250, 1000):
    _f = f"(PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW)"
    define(f"real_yield_median_{_n}", f"CASE WHEN count(real_yield_10y) OVER {_f} >= {_n // 2} THEN QUANTILE(real_yield_10y, 0.5) OVER {_f} END")
    _both(f"carry_real_yield_above_own_median_{_n}", f"carry_real_yield_below_own_median_{_n}", "carry", f"real_yield_10y > real_yield_median_{_n}", f"real_yield_10y < real_yield_median_{_n}", -1)
for _n in range(1, 13):
    _add(f"seasonality_month_{_n}", "seasonality", 0, f"month(ts) = {_n}")
_add("seasonality_diwali_window", "seasonality", 0, "month(ts) IN (10, 11)")
_add("seasonality_golden_window", "seasonality", 0, "month(ts) IN (11, 12, 1, 2)")
for _x, (_f, _h) in bars.PATTERNS.items():
    if _f == "smc" and not _x.endswith("_zone"):
        _add(_x, "smc", {"smc_near_bullish_order_block": 1, "smc_near_bearish_order_block": -1}.get(_x, _h), _x)
for _n in (20, 50, 100):
    _both(f"smc_discount_zone_{_n}", f"smc_premium_zone_{_n}", "smc", f"range_position_{_n} < 0.3", f"range_position_{_n} > 0.7")
for _x in bars.KILLZONES:
    _add(f"ict_{_x}_active", "ict_timing", 0, f"{_x}_active")
for _x in bars.SESSIONS:
    _add(f"session_{_x}_active", "session", 0, f"{_x}_active")
