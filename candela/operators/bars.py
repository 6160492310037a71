"""Definitions of bar shapes, indicators, levels, sessions and atomic patterns.

PATTERNS lists the atomic patterns as (family, direction hint): 1 bullish, -1 bearish, 0 either. Conditions of unknown
values are false. Rolling values need all their bars. Nothing looks ahead: levels count from the bar after their confirmation.
"""

from __future__ import annotations

from ..functions.registry import W, define, edge, is_true, known_before, lag, rolling, running

PATTERNS: dict[str, tuple[str, int]] = {}


def pattern(name: str, family: str, hint: int, condition: str | None = None) -> None:
    """Registers an atomic pattern; condition None: the name is defined already."""
    if condition is not None:
        define(name, is_true(condition))
    PATTERNS[name] = (family, hint)


# shapes of one bar
define("bar_idx", f"CAST(row_number() OVER ({W}) AS BIGINT) - 1")
define("day", "CAST(ts AS DATE)")
define("body", "abs(close - open)")
define("bar_range", "nullif(high - low, 0)")
define("body_high", "greatest(open, close)")
define("body_low", "least(open, close)")
define("upper_shadow", "high - body_high")
define("lower_shadow", "body_low - low")
define("bullish", "close > open")
define("bearish", "close < open")
define("body_ratio", "coalesce(body / bar_range, 0)")
define("small_wick", "0.3 * coalesce(nullif(body, 0), bar_range)")
for _x in ("open", "high", "low", "close", "body", "bar_range", "body_high", "body_low", "bullish", "bearish", "body_ratio", "upper_shadow", "lower_shadow"):
    define(f"{_x}_1", lag(_x))
    define(f"{_x}_2", lag(_x, 2))

# indicators
define("change", "close - close_1")
define("true_range", "greatest(high - low, abs(high - close_1), abs(low - close_1))")
define("atr", rolling("avg", "true_range", 14))
define("safe_atr", "nullif(atr, 0)")
define("atr_1", lag("atr"))
SMA_WINDOWS = (10, 15, 20, 30, 50, 75, 100, 200)
for _n in SMA_WINDOWS:
    define(f"sma_{_n}", rolling("avg", "close", _n))
    define(f"sma_{_n}_1", lag(f"sma_{_n}"))
define("gain", "CASE WHEN change IS NOT NULL THEN greatest(change, 0) END")
define("loss", "CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END")
define("avg_gain", rolling("avg", "gain", 14))
define("avg_loss", rolling("avg", "loss", 14))
define("rsi", "100 - 100 / (1 + avg_gain / nullif(avg_loss, 0))")
define("rsi_1", lag("rsi"))
define("ema_12", "EWM(close, 2/13)")
define("ema_26", "EWM(close, 2/27)")
define("macd", "ema_12 - ema_26")
define("macd_signal", "EWM(macd, 2/10)")
define("macd_hist", "macd - macd_signal")
define("macd_hist_1", lag("macd_hist"))
define("up_move", "high - high_1")
define("down_move", "low_1 - low")
define("plus_dm", "CASE WHEN up_move > down_move AND up_move > 0 THEN up_move ELSE 0.0 END")
define("minus_dm", "CASE WHEN down_move > up_move AND down_move > 0 THEN down_move ELSE 0.0 END")
define("smooth_tr", "EWM(true_range, 1/14)")
define("smooth_plus", "EWM(plus_dm, 1/14)")
define("smooth_minus", "EWM(minus_dm, 1/14)")
define("plus_di", "100 * smooth_plus / nullif(smooth_tr, 0)")
define("minus_di", "100 * smooth_minus / nullif(smooth_tr, 0)")
define("dx", "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)")
define("adx", "EWM(dx, 1/14)")
define("bb_mid", "sma_20")
define("bb_std", rolling("stddev_samp", "close", 20))
define("bb_upper", "bb_mid + 2 * bb_std")
define("bb_lower", "bb_mid - 2 * bb_std")
define("bb_upper_1", lag("bb_upper"))
define("bb_lower_1", lag("bb_lower"))
define("bb_position", "(close - bb_lower) / nullif(bb_upper - bb_lower, 0)")
define("low_14", rolling("min", "low", 14))
define("high_14", rolling("max", "high", 14))
define("stoch_k", "100 * (close - low_14) / nullif(high_14 - low_14, 0)")
define("stoch_k_1", lag("stoch_k"))
define("stoch_d", rolling("avg", "stoch_k", 3))
_DAY = "(PARTITION BY symbol, timeframe, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
define("typical_volume", "(high + low + close) / 3 * volume")
define("vwap", f"sum(typical_volume) OVER {_DAY} / nullif(sum(volume) OVER {_DAY}, 0)")
define("vwap_1", lag("vwap"))
define("signed_volume", "coalesce(sign(change), 0) * volume")
define("obv", running("sum", "signed_volume"))
define("obv_20", lag("obv", 20))
for _n in (10, 20, 30, 50, 75):
    define(f"donchian_high_{_n}", rolling("max", "high", _n, prior=True))
    define(f"donchian_low_{_n}", rolling("min", "low", _n, prior=True))
    define(f"donchian_position_{_n}", f"(close - donchian_low_{_n}) / nullif(donchian_high_{_n} - donchian_low_{_n}, 0)")
for _n in (5, 8, 10, 15, 20, 30):
    _f = f"({W} ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW)"
    define(f"slope_{_n}", f"CASE WHEN count(close) OVER {_f} = {_n} THEN regr_slope(close, bar_idx) OVER {_f} END")
    define(f"slope_{_n}_lagged", lag(f"slope_{_n}", _n))
    define(f"acceleration_{_n}", f"slope_{_n} - slope_{_n}_lagged")
for _n in (1, 3, 5, 10, 20, 50, 100):
    define(f"close_lag_{_n}", lag("close", _n))
    define(f"return_{_n}", f"close / nullif(close_lag_{_n}, 0) - 1")
define("atr_base_50", rolling("avg", "atr", 50, prior=True))
define("atr_base_100", rolling("avg", "atr", 100, prior=True))
define("volatility_ratio", "atr / nullif(atr_base_100, 0)")
define("vol_of_vol", f"{rolling('stddev_samp', 'atr', 20)} / nullif({rolling('avg', 'atr', 20)}, 0)")
for _n in (20, 50, 100):
    define(f"range_high_{_n}", rolling("max", "high", _n))
    define(f"range_low_{_n}", rolling("min", "low", _n))
    define(f"range_position_{_n}", f"(close - range_low_{_n}) / nullif(range_high_{_n} - range_low_{_n}, 0)")
define("abs_change", "abs(change)")
define("path_20", rolling("sum", "abs_change", 20))
define("efficiency_ratio_20", "abs(close - close_lag_20) / nullif(path_20, 0)")
define("return_1_1", lag("return_1"))
define("return_pair", "return_1 * return_1_1")
define("autocorr_50", f"({rolling('avg', 'return_pair', 50)} - ({rolling('avg', 'return_1', 50)}) * ({rolling('avg', 'return_1_1', 50)})) / nullif(({rolling('stddev_samp', 'return_1', 50)}) * ({rolling('stddev_samp', 'return_1_1', 50)}), 0)")
for _x in ("volume", "atr"):
    _f = f"({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
    define(f"{_x}_list_100", f"CASE WHEN count({_x}) OVER {_f} = 100 THEN LIST({_x}) OVER {_f} END")
    define(f"{_x}_percentile", f"CASE WHEN {_x}_list_100 IS NOT NULL THEN (COUNT_BELOW({_x}_list_100, {_x}) + CAST(COUNT_EQUAL({_x}_list_100, {_x}) + 1 AS DOUBLE) / 2) / 100 END")
_f = f"({W} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"
define("return_quantile_90", f"CASE WHEN count(return_1) OVER {_f} >= 30 THEN QUANTILE(return_1, 0.9) OVER {_f} END")
define("return_above_quantile", is_true("return_1 > return_quantile_90"))

# regimes
define("volatility_regime", "CASE WHEN volatility_ratio IS NULL THEN NULL WHEN volatility_ratio < 0.8 THEN 'LOW' WHEN volatility_ratio > 1.25 THEN 'HIGH' ELSE 'NORMAL' END")
define("trend_regime", "CASE WHEN adx IS NULL THEN NULL WHEN adx > 25 THEN 'TRENDING' ELSE 'RANGING' END")
define("combined_regime", "volatility_regime || '_' || trend_regime")

# levels: a swing is an extreme of 11 bars, confirmed 5 bars later, known from the bar after
for _x, _agg in (("high", "max"), ("low", "min")):
    _f = f"({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
    define(f"swing_{_x}_point", f"CASE WHEN count({_x}) OVER {_f} = 11 AND {_x} = {_agg}({_x}) OVER {_f} THEN {_x} END")
    define(f"swing_{_x}_confirmed", lag(f"swing_{_x}_point", 5))
    define(f"swing_{_x}", known_before(f"swing_{_x}_confirmed"))
    # the swing before: the level that was current when the last one was confirmed
    define(f"swing_{_x}_at", f"CASE WHEN swing_{_x}_confirmed IS NOT NULL THEN coalesce(swing_{_x}, -1) END")
    define(f"swing_{_x}_prior_raw", known_before(f"swing_{_x}_at"))
    define(f"swing_{_x}_prior", f"nullif(swing_{_x}_prior_raw, -1)")
define("round_level", "CAST(floor((high + low) / 2 / 50 + 0.5) AS DOUBLE) * 50")
_G = "(PARTITION BY symbol, timeframe, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
define("day_high", f"max(high) OVER {_G}")
define("day_low", f"min(low) OVER {_G}")
define("day_close", f"last_value(close) OVER {_G}")
define("day_start", f"lag(day) OVER ({W}) IS NULL OR lag(day) OVER ({W}) <> day")
# the day before, as known on its last bar, is carried from the first bar of a day
for _x in ("high", "low", "close"):
    define(f"day_{_x}_1", lag(f"day_{_x}"))
    define(f"day_{_x}_head", f"CASE WHEN day_start THEN day_{_x}_1 END")
    define(f"prior_day_{_x}", f"first_value(day_{_x}_head) OVER (PARTITION BY symbol, timeframe, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
define("pivot_pp", "(prior_day_high + prior_day_low + prior_day_close) / 3")
define("pivot_r1", "2 * pivot_pp - prior_day_low")
define("pivot_s1", "2 * pivot_pp - prior_day_high")

# sessions: boundaries in local time; a boundary belongs to the first bar at or after it
SESSIONS = {"sydney": ("Australia/Sydney", 540, 1020), "tokyo": ("Asia/Tokyo", 540, 1020), "london": ("Europe/London", 480, 990), "new_york": ("America/New_York", 480, 1020)}
KILLZONES = {"london_kz": ("America/New_York", 120, 300), "ny_am_kz": ("America/New_York", 420, 600)}
define("ts_1", lag("ts"))
for _zone in sorted({z for z, _, _ in SESSIONS.values()}):
    _z = _zone.split("/")[1].lower()
    define(f"local_{_z}", f"LOCAL(ts, '{_zone}')")
    define(f"minute_{_z}", f"hour(local_{_z}) * 60 + minute(local_{_z})")
for _name, (_zone, _open, _close) in SESSIONS.items():
    _z = _zone.split("/")[1].lower()
    define(f"{_name}_active", is_true(f"minute_{_z} >= {_open} AND minute_{_z} < {_close}"))
    for _edge, _m in (("open", _open), ("close", _close)):
        define(f"{_name}_{_edge}_local", f"date_trunc('day', local_{_z}) + INTERVAL '{_m}' MINUTE - CASE WHEN minute_{_z} < {_m} THEN INTERVAL '1440' MINUTE ELSE INTERVAL '0' MINUTE END")
        define(f"{_name}_{_edge}_at", f"UTC({_name}_{_edge}_local, '{_zone}')")
        pattern(f"session_{_name}_{_edge}", "session", 0, f"{_name}_{_edge}_at > ts_1 OR (ts_1 IS NULL AND {_name}_{_edge}_at = ts)")
for _name, (_zone, _open, _close) in KILLZONES.items():
    _z = _zone.split("/")[1].lower()
    define(f"{_name}_active", is_true(f"minute_{_z} >= {_open} AND minute_{_z} < {_close}"))

# candlesticks
define("trend_base", rolling("avg", "close", 10, prior=True))
define("after_fall", is_true("close_1 < trend_base"))
define("after_rise", is_true("close_1 > trend_base"))
define("hammer_shape", is_true("lower_shadow >= 2 * body AND upper_shadow <= small_wick AND body <= 0.4 * bar_range"))
define("star_shape", is_true("upper_shadow >= 2 * body AND lower_shadow <= small_wick AND body <= 0.4 * bar_range"))
define("middle_1", "(open_1 + close_1) / 2")
define("middle_2", "(open_2 + close_2) / 2")
define("inside_body", "body_high <= body_high_1 AND body_low >= body_low_1 AND body <= 0.6 * body_1 AND body_ratio_1 >= 0.4")
define("pair_range", "0.15 * greatest(bar_range, bar_range_1)")
define("small_middle", "body_1 <= 0.5 * body_2 AND bar_range_1 <= 0.6 * bar_range_2 AND body_ratio >= 0.5")
_C = "candlestick"
pattern("doji", _C, 0, "body <= 0.1 * bar_range")
pattern("hammer", _C, 1, "hammer_shape AND after_fall")
pattern("hanging_man", _C, -1, "hammer_shape AND after_rise")
pattern("shooting_star", _C, -1, "star_shape AND after_rise")
pattern("inverted_hammer", _C, 1, "star_shape AND after_fall")
pattern("marubozu_bullish", _C, 1, "bullish AND body_ratio >= 0.9")
pattern("marubozu_bearish", _C, -1, "bearish AND body_ratio >= 0.9")
pattern("bullish_engulfing", _C, 1, "bearish_1 AND bullish AND open <= close_1 AND close >= open_1 AND body_ratio >= 0.6")
pattern("bearish_engulfing", _C, -1, "bullish_1 AND bearish AND open >= close_1 AND close <= open_1 AND body_ratio >= 0.6")
pattern("piercing_line", _C, 1, "bearish_1 AND bullish AND open < close_1 AND close > middle_1 AND close < open_1 AND body_ratio >= 0.5")
pattern("dark_cloud_cover", _C, -1, "bullish_1 AND bearish AND open > close_1 AND close < middle_1 AND close > open_1 AND body_ratio >= 0.5")
pattern("bullish_harami", _C, 1, "bearish_1 AND bullish AND inside_body")
pattern("bearish_harami", _C, -1, "bullish_1 AND bearish AND inside_body")
pattern("tweezer_bottom", _C, 1, "bearish_1 AND bullish AND abs(low - low_1) <= pair_range AND body_ratio >= 0.3")
pattern("tweezer_top", _C, -1, "bullish_1 AND bearish AND abs(high - high_1) <= pair_range AND body_ratio >= 0.3")
pattern("outside_bar", _C, 0, "high > high_1 AND low < low_1")
pattern("inside_bar", _C, 0, "high < high_1 AND low > low_1")
pattern("morning_star", _C, 1, "bearish_2 AND small_middle AND bullish AND close >= middle_2")
pattern("evening_star", _C, -1, "bullish_2 AND small_middle AND bearish AND close <= middle_2")
pattern("three_white_soldiers", _C, 1, "bullish_2 AND bullish_1 AND bullish AND open_1 > open_2 AND close_1 > close_2 AND open > open_1 AND close > close_1 AND upper_shadow_2 <= 0.3 * body_2 AND upper_shadow_1 <= 0.3 * body_1 AND upper_shadow <= 0.3 * body")
pattern("three_black_crows", _C, -1, "bearish_2 AND bearish_1 AND bearish AND open_1 < open_2 AND close_1 < close_2 AND open < open_1 AND close < close_1 AND lower_shadow_2 <= 0.3 * body_2 AND lower_shadow_1 <= 0.3 * body_1 AND lower_shadow <= 0.3 * body")

# indicator conditions
_I = "indicator"
pattern("golden_cross", _I, 1, "sma_50 > sma_200 AND sma_50_1 <= sma_200_1")
pattern("death_cross", _I, -1, "sma_50 < sma_200 AND sma_50_1 >= sma_200_1")
pattern("rsi_oversold_cross", _I, 1, "rsi > 30 AND rsi_1 <= 30")
pattern("rsi_overbought_cross", _I, -1, "rsi < 70 AND rsi_1 >= 70")
pattern("macd_bullish_cross", _I, 1, "macd_hist > 0 AND macd_hist_1 <= 0")
pattern("macd_bearish_cross", _I, -1, "macd_hist < 0 AND macd_hist_1 >= 0")
pattern("donchian_breakout_up", _I, 1, "close > donchian_high_20")
pattern("donchian_breakout_down", _I, -1, "close < donchian_low_20")
pattern("atr_expansion", _I, 0, "atr > 1.3 * atr_base_50")
pattern("bb_upper_breakout", _I, 1, "close > bb_upper AND close_1 <= bb_upper_1")
pattern("bb_lower_breakout", _I, -1, "close < bb_lower AND close_1 >= bb_lower_1")
pattern("stoch_oversold_cross", _I, 1, "stoch_k > 20 AND stoch_k_1 <= 20")
pattern("stoch_overbought_cross", _I, -1, "stoch_k < 80 AND stoch_k_1 >= 80")
pattern("adx_trending", _I, 0, "adx > 25")
pattern("vwap_bullish_cross", _I, 1, "close > vwap AND close_1 <= vwap_1")
pattern("vwap_bearish_cross", _I, -1, "close < vwap AND close_1 >= vwap_1")
define("trend_up", is_true("sma_50 > sma_200"))
define("momentum_up", is_true("rsi > 50"))
define("participation_up", is_true("obv - obv_20 > 0"))
define("lively", is_true("atr > 1.1 * atr_base_50"))
edge("trend_following_long", "trend_up AND momentum_up AND participation_up AND lively")
edge("trend_following_short", "NOT trend_up AND NOT momentum_up AND NOT participation_up AND lively")  # unknown counts as not up
pattern("trend_following_long", _I, 1)
pattern("trend_following_short", _I, -1)

# support and resistance
for _level, _high, _low in (("swing", "swing_high", "swing_low"), ("round_number", "round_level", "round_level"), ("pivot", "pivot_r1", "pivot_s1")):
    _up, _down = {"swing": ("swing_high", "swing_low"), "round_number": ("round_number",) * 2, "pivot": ("pivot_r1", "pivot_s1")}[_level]
    pattern(f"sr_{_up}_rejection", "support_resistance", -1, f"close_1 < {_high} AND high >= {_high} - 0.5 * atr AND close < {_high} AND upper_shadow >= 1.5 * body AND lower_shadow <= small_wick")
    pattern(f"sr_{_down}_bounce", "support_resistance", 1, f"close_1 > {_low} AND low <= {_low} + 0.5 * atr AND close > {_low} AND lower_shadow >= 1.5 * body AND upper_shadow <= small_wick")

# market structure
_S = "smc"
pattern("smc_liquidity_sweep_low", _S, 1, "low < swing_low AND close > swing_low")
pattern("smc_liquidity_sweep_high", _S, -1, "high > swing_high AND close < swing_high")
pattern("smc_fvg_bullish", _S, 1, "low > high_2")
pattern("smc_fvg_bearish", _S, -1, "high < low_2")
pattern("smc_bullish_sweep_fvg", _S, 1, "smc_liquidity_sweep_low AND smc_fvg_bullish")
pattern("smc_bearish_sweep_fvg", _S, -1, "smc_liquidity_sweep_high AND smc_fvg_bearish")
define("bull_structure", is_true("swing_high > swing_high_prior AND swing_low > swing_low_prior"))
define("bear_structure", is_true("swing_high < swing_high_prior AND swing_low < swing_low_prior"))
edge("smc_bos_bullish", "bull_structure AND close > swing_high")
edge("smc_bos_bearish", "bear_structure AND close < swing_low")
edge("smc_choch_bullish", "bear_structure AND close > swing_high")
edge("smc_choch_bearish", "bull_structure AND close < swing_low")
for _n, _h in (("smc_bos_bullish", 1), ("smc_bos_bearish", -1), ("smc_choch_bullish", 1), ("smc_choch_bearish", -1)):
    pattern(_n, _S, _h)
pattern("smc_eq_high_sweep", _S, -1, "abs(swing_high - swing_high_prior) <= 0.15 * atr AND high > swing_high AND close < swing_high")
pattern("smc_eq_low_sweep", _S, 1, "abs(swing_low - swing_low_prior) <= 0.15 * atr AND low < swing_low AND close > swing_low")
for _side, _opposite in (("bullish", "bearish"), ("bearish", "bullish")):
    for _x in ("high", "low"):
        define(f"{_opposite}_{_x}", f"CASE WHEN {_opposite} THEN {_x} END")
        define(f"last_{_opposite}_{_x}", known_before(f"{_opposite}_{_x}"))
        define(f"{_side}_block_{_x}_set", f"CASE WHEN smc_bos_{_side} THEN last_{_opposite}_{_x} END")
        define(f"{_side}_block_{_x}", f"LAST_OF({_side}_block_{_x}_set) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    pattern(f"smc_near_{_side}_order_block", _S, 0, f"close >= {_side}_block_low AND close <= {_side}_block_high")
pattern("smc_discount_zone", _S, 0, "range_position_50 < 0.3")
pattern("smc_premium_zone", _S, 0, "range_position_50 > 0.7")

#: Macro flags are joined from releases (see calendar); a query over bars alone has them as false.
MACRO_PATTERNS = [f"fundamental_{x}_{y}" for x in ("cpi", "pce", "nfp", "gdp") for y in ("accelerating", "decelerating")] + [f"fundamental_fomc_{d}" for d in ("hike", "cut", "hold")]
for _n in MACRO_PATTERNS:
    PATTERNS[_n] = ("fundamental", 0)
BAR_PATTERNS = [n for n in PATTERNS if n not in MACRO_PATTERNS]
