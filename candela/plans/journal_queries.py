"""Queries over the trade journal, the signal vote and trade plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.registry import resolve, sql
from ..operators.labels import labels_sql, trade_labels
from ..sources import market, merge
from . import journal as J
from .common import ALL, HOURLY, bars, bars_sql, rounded, rounded_sql
from .mining import BAR_PATTERNS, PATTERNS, dim_sql, fired, fired_sql, pattern_dim

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, f, query: str | None = None, doubles: list[str] | None = None, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
    if query is not None:
        SQL[name] = rounded_sql(query, doubles or [], digits)


def _both(name: str, f, *sql_form, digits: int = 6) -> None:
    """A query f(spark, d, timeframes) at the size that SQL checks, and over all sizes as <name>_all."""
    _query(name, lambda s, d: f(s, d, HOURLY), *sql_form, digits=digits)
    QUERIES[f"{name}_all"] = lambda s, d: rounded(f(s, d, ALL), digits)


_R = f"SELECT *, CASE outcome WHEN 'win' THEN 4.0 ELSE -1.0 END::DOUBLE AS actual_r, CASE outcome WHEN 'win' THEN 4.0 ELSE -1.0 END::DOUBLE - {J.COST} AS actual_r_after_costs FROM ({market.JOURNAL_SQL}) j WHERE outcome IN ('win', 'loss')"
#: Mined win rates by pattern; p5 isn't in the library.
MINED = {"p1": 0.70, "p2": 0.62, "p3": 0.55, "p4": 0.40}
_W = {"w": "count(*) FILTER (outcome = 'win')", "n": "count(*)"}


def library(spark) -> DataFrame:
    rows = [(p, tf, side, rate) for p, rate in MINED.items() for tf in ("15min", "1h", "4h") for side in ("long", "short")]
    return spark.createDataFrame(rows, "pattern string, timeframe string, direction string, mined_win_rate double")


_LIBRARY = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{tf}', '{s}', {r}::DOUBLE)" for p, r in MINED.items() for tf in ("15min", "1h", "4h") for s in ("long", "short")) + ") l(pattern, timeframe, direction, mined_win_rate)"
_query("journal_rows", market.journal, market.JOURNAL_SQL, ["entry", "risk", "volatility_shock_ratio"])
_query("journal_summary", lambda s, d: J.summary(market.journal(s, d)), f"SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'win') / nullif(count(*) FILTER (outcome IN ('win', 'loss')), 0)::DOUBLE AS live_win_rate FROM ({market.JOURNAL_SQL}) j", ["live_win_rate"])
_CARD = f"""
SELECT *, CASE WHEN live_samples < 10 THEN 'UNPROVEN' WHEN hi < mined_win_rate THEN 'DECAYING' WHEN lo >= 0.6 THEN 'CONFIRMED' ELSE 'WATCH' END AS label FROM (
SELECT g.*, mined_win_rate, {stats.wilson_sql('wins', 'live_samples')} AS lo, {stats.wilson_sql('wins', 'live_samples', True)} AS hi FROM (
SELECT pattern, timeframe, direction, count(*) AS live_samples, {_W['w']} AS wins, {_W['w']} / count(*)::DOUBLE AS live_win_rate, sum(actual_r) AS total_r, sum(actual_r_after_costs) AS total_r_after_costs FROM ({_R}) r GROUP BY 1, 2, 3) g
LEFT JOIN ({_LIBRARY}) l USING (pattern, timeframe, direction))
"""
card = lambda s, d: J.scorecard(market.journal(s, d), library(s))
_CARD_DOUBLES = ["live_win_rate", "total_r", "total_r_after_costs", "mined_win_rate", "wilson_low", "wilson_high"]
_query("pattern_scorecard", card, f"SELECT * EXCLUDE (lo, hi), CASE WHEN live_samples >= 10 THEN lo END AS wilson_low, CASE WHEN live_samples >= 10 THEN hi END AS wilson_high FROM ({_CARD}) c", _CARD_DOUBLES)
_query("suspended_patterns", lambda s, d: J.suspended(card(s, d)), f"SELECT pattern, timeframe, direction FROM ({_CARD}) c WHERE label = 'DECAYING'")
_query("detect_drift", lambda s, d: J.drift(card(s, d)), f"SELECT pattern, timeframe, direction, live_win_rate, live_samples, hi AS wilson_high, mined_win_rate, label = 'DECAYING' AS decaying FROM ({_CARD}) c WHERE live_samples >= 10 AND mined_win_rate IS NOT NULL", ["live_win_rate", "wilson_high", "mined_win_rate"])
_query("self_heal", lambda s, d: J.should_self_heal(card(s, d), 0.5), f"SELECT count(*) FILTER (label = 'DECAYING') AS n_decaying, count(*) FILTER (label = 'DECAYING') >= 3 AS rebuild FROM ({_CARD}) c")
_LONG = " UNION ALL ".join(f"SELECT pattern, timeframe, direction, outcome, '{k}' AS dimension, {e} AS bucket FROM ({_R}) r" for k, e in J.CONTEXT.items())
_CONTEXT = f"""
SELECT pattern, timeframe, direction, dimension, bucket, samples, wins, wins / samples::DOUBLE AS win_rate, {stats.wilson_sql('wins', 'samples', True)} AS wilson_high, CASE WHEN rest >= 15 THEN rest_wins / rest::DOUBLE END AS baseline,
       coalesce({stats.wilson_sql('wins', 'samples', True)} < CASE WHEN rest >= 15 THEN rest_wins / rest::DOUBLE END, false) AS decaying
FROM (SELECT *, (sum(samples) OVER w - samples)::BIGINT AS rest, (sum(wins) OVER w - wins)::BIGINT AS rest_wins FROM (SELECT pattern, timeframe, direction, dimension, bucket, count(*) AS samples, {_W['w']} AS wins FROM ({_LONG}) l WHERE bucket IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY pattern, timeframe, direction, dimension)) WHERE samples >= 15
"""
_query("context_scorecard", lambda s, d: J.context_scorecard(market.journal(s, d)), _CONTEXT, ["win_rate", "wilson_high", "baseline"])
_open = lambda s, d: market.journal(s, d).where("status = 'open'").select("signal_id", *J.GROUP, "confluence_count", "session_at_entry")
_query("context_penalty", lambda s, d: J.context_penalty(_open(s, d), J.context_scorecard(market.journal(s, d))), f"""
WITH c AS MATERIALIZED ({_CONTEXT}), o AS (SELECT signal_id, pattern, timeframe, direction, confluence_count, session_at_entry FROM ({market.JOURNAL_SQL}) j WHERE status = 'open')
SELECT o.*, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.decaying AND c.pattern = o.pattern AND c.timeframe = o.timeframe AND c.direction = o.direction AND ((c.dimension = 'confluence_count' AND c.bucket = {J.CONTEXT['confluence_count']}) OR (c.dimension = 'session_at_entry' AND c.bucket = o.session_at_entry))) THEN 0.5 ELSE 1.0 END AS multiplier FROM o""", ["multiplier"])  # fmt: skip
_O = "PARTITION BY timeframe ORDER BY logged_at_utc, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_CURVE = f"SELECT timeframe, logged_at_utc, signal_id, pattern, outcome, actual_r, cumulative_r, cumulative_r_after_costs, max(cumulative_r) OVER ({_O}) AS peak, cumulative_r - max(cumulative_r) OVER ({_O}) AS drawdown FROM (SELECT *, sum(actual_r) OVER ({_O}) AS cumulative_r, sum(actual_r_after_costs) OVER ({_O}) AS cumulative_r_after_costs FROM ({_R}) r) c"
_CURVE_DOUBLES = ["actual_r", "cumulative_r", "cumulative_r_after_costs", "peak", "drawdown"]
_query("equity_curve", lambda s, d: J.equity_curve(market.journal(s, d)), _CURVE, _CURVE_DOUBLES, 4)
_query("drawdown", lambda s, d: J.equity_curve(market.journal(s, d), "pattern").groupBy("pattern").agg(F.min("drawdown").alias("max_drawdown_r")), f"SELECT pattern, min(drawdown) AS max_drawdown_r FROM ({_CURVE.replace('PARTITION BY timeframe', 'PARTITION BY pattern')}) c GROUP BY 1", ["max_drawdown_r"])
_STREAK = f"SELECT timeframe, max(last) AS streak_type, coalesce(min(k) FILTER (outcome <> last) - 1, count(*)) AS streak_length FROM (SELECT timeframe, outcome, row_number() OVER w AS k, first_value(outcome) OVER w AS last FROM ({_R}) r WINDOW w AS (PARTITION BY timeframe ORDER BY logged_at_utc DESC, signal_id DESC)) GROUP BY 1"
_query("current_streak", lambda s, d: J.current_streak(market.journal(s, d)), _STREAK)
_query("circuit_breaker", lambda s, d: J.circuit_breaker(market.journal(s, d)), f"""
SELECT *, losing OR fallen OR crowded AS tripped FROM (SELECT timeframe, open_trades, streak_type, streak_length, coalesce(dd, 0.0) AS max_drawdown_r, coalesce(streak_type = 'loss' AND streak_length >= 8, false) AS losing, coalesce(dd, 0.0) <= -15 AS fallen, open_trades >= 6 AS crowded
FROM (SELECT timeframe, count(*) FILTER (status = 'open') AS open_trades FROM ({market.JOURNAL_SQL}) j GROUP BY 1) LEFT JOIN ({_STREAK}) s USING (timeframe) LEFT JOIN (SELECT timeframe, min(drawdown) AS dd FROM ({_CURVE}) c GROUP BY 1) USING (timeframe))""", ["max_drawdown_r"])  # fmt: skip
_query("overall_scorecard", lambda s, d: J.overall(market.journal(s, d)), f"SELECT count(*) AS resolved, {_W['w']} AS wins, {stats.wilson_sql(_W['w'], 'count(*)')} AS wilson_low, {stats.wilson_sql(_W['w'], 'count(*)', True)} AS wilson_high, sum(actual_r) AS total_r, avg(actual_r) AS avg_r, avg(actual_r_after_costs) AS avg_r_after_costs, max(actual_r) AS best_r, min(actual_r) AS worst_r FROM ({_R}) r", ["wilson_low", "wilson_high", "total_r", "avg_r", "avg_r_after_costs", "best_r", "worst_r"])
_query("suspension_anti_join", lambda s, d: market.journal(s, d).join(J.suspended(card(s, d)), J.GROUP, "left_anti").select("signal_id", *J.GROUP), f"SELECT signal_id, pattern, timeframe, direction FROM ({market.JOURNAL_SQL}) j ANTI JOIN (SELECT * FROM ({_CARD}) c WHERE label = 'DECAYING') x USING (pattern, timeframe, direction)")
_query("journal_append", lambda s, d: J.new_entries(market.journal(s, d), market.journal(s, d).where("status = 'open'"), ("timeframe", "pattern", "logged_at_utc")).select("signal_id", "timeframe", "pattern", "logged_at_utc"), f"SELECT signal_id, timeframe, pattern, logged_at_utc FROM ({market.JOURNAL_SQL}) j WHERE NOT EXISTS (SELECT 1 FROM ({market.JOURNAL_SQL}) o WHERE o.status = 'open' AND o.timeframe = j.timeframe AND o.pattern = j.pattern AND o.logged_at_utc = j.logged_at_utc)")

# the vote over the last bars
LIB_RATE, LIB_N = "0.6 + length(pattern) % 7 / 50.0", "30 + length(pattern) * 10"


def _ballot(spark, d, timeframes: tuple[str, ...] = HOURLY) -> DataFrame:
    """Patterns of the last bar in both directions that their hints allow, with a made-up library."""
    b = bars(spark, d, timeframes)
    last = merge.last_bar(b).select("symbol", "timeframe", F.col("last_ts").alias("ts"))
    flags = fired(b).join(last, ["symbol", "timeframe", "ts"])
    sides = spark.createDataFrame([(1,), (-1,)], "direction int")
    return flags.join(F.broadcast(pattern_dim(spark)), "pattern").crossJoin(F.broadcast(sides)).where("hint = 0 or hint = direction").select("symbol", "timeframe", "pattern", "direction", F.lit(None).cast("boolean").alias("regime_ok"), F.expr("length(pattern) % 3 <> 0").alias("coarse_ok"))


def _vote_library(spark, timeframes: tuple[str, ...] = HOURLY) -> DataFrame:
    rows = [(p, tf, s, 30 + len(p) * 10, 0.6 + len(p) % 7 / 50.0, 0.5 + len(p) % 7 / 50.0) for p in PATTERNS for tf in dict.fromkeys([*timeframes, "1d"]) for s in (1, -1)]
    return spark.createDataFrame(rows, "pattern string, timeframe string, direction int, resolved bigint, win_rate double, wilson_lower double")


def _no_decay(spark) -> DataFrame:
    return spark.createDataFrame([("doji", "1h", 1)], "pattern string, timeframe string, direction int")


_VOTE = f"""
WITH b AS MATERIALIZED ({bars_sql()}),
f AS (SELECT f.* FROM ({fired_sql('SELECT * FROM b')}) f JOIN (SELECT symbol, timeframe, max(ts) AS ts FROM b GROUP BY ALL) l USING (symbol, timeframe, ts)),
q AS (SELECT f.symbol, f.timeframe, pattern, direction, 30 + length(pattern) * 10 AS resolved, 0.5::DOUBLE + (length(pattern) % 7) / 50.0::DOUBLE AS wilson_lower, length(pattern) % 3 <> 0 AS coarse_ok FROM f JOIN ({dim_sql()}) p USING (pattern) CROSS JOIN (VALUES (1), (-1)) s(direction)
      WHERE (hint = 0 OR hint = direction) AND NOT (pattern = 'doji' AND f.timeframe = '1h' AND direction = 1)),
r AS (SELECT *, CASE timeframe WHEN '1h' THEN 1.5 ELSE 2.5 END::DOUBLE * wilson_lower * least(resolved / 200.0::DOUBLE, 1.0) * CASE WHEN coarse_ok THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM q QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, pattern ORDER BY direction) = 1),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, direction ORDER BY weight DESC, pattern) = 1),
v AS (SELECT symbol, coalesce(sum(weight) FILTER (direction = 1), 0.0) AS bull, coalesce(sum(weight) FILTER (direction = -1), 0.0) AS bear FROM u GROUP BY 1),
s AS (SELECT *, CASE WHEN bull > bear THEN 'BUY' WHEN bear > bull THEN 'SELL' ELSE 'HOLD' END AS signal, abs(bull - bear) / nullif(bull + bear, 0) AS agreement FROM v),
t AS (SELECT * FROM u JOIN s USING (symbol) WHERE (signal = 'BUY' AND direction = 1) OR (signal = 'SELL' AND direction = -1) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, timeframe DESC, pattern DESC) = 1)
SELECT s.symbol, s.signal, s.bull, s.bear, coalesce(s.agreement, 0) AS agreement, coalesce(100 * t.wilson_lower * s.agreement, 0) AS confidence, t.pattern AS primary_pattern, t.timeframe AS primary_timeframe FROM s LEFT JOIN t USING (symbol)
"""
_both("weighted_vote", lambda s, d, tf: J.vote(_ballot(s, d, tf), _vote_library(s, tf), _no_decay(s)), _VOTE, ["bull", "bear", "agreement", "confidence"])
_PLAN = f"SELECT symbol, timeframe, ts, direction, close AS entry, close - direction * 1.5 * atr AS stop_loss, close + direction * 4.0 * 1.5 * atr AS take_profit, 1.5 * atr AS risk FROM (SELECT * FROM ({sql(bars_sql(), ['atr'], ('symbol', 'timeframe', 'ts', 'close'))}) p QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) = 1) CROSS JOIN (VALUES (1), (-1)) s(direction) WHERE atr > 0"
_PLAN_DOUBLES = ["entry", "stop_loss", "take_profit", "risk"]
_both("trade_plan", lambda s, d, tf: J.trade_plan(bars(s, d, tf)), _PLAN, _PLAN_DOUBLES, digits=4)
_both("position_size", lambda s, d, tf: J.position_size(J.trade_plan(bars(s, d, tf)), 10_000.0, 1.0), f"SELECT *, 100.0 AS dollar_risk, 100.0 / risk AS units, 100.0 / risk / 100.0 AS lots FROM ({_PLAN}) p", [*_PLAN_DOUBLES, "dollar_risk", "units", "lots"], digits=4)
_both("freshness", lambda s, d, tf: J.freshness(bars(s, d, tf), F.expr(merge.minutes()), "2024-01-31 12:00:00"), f"SELECT *, age_minutes > 3 * m AS stale FROM (SELECT symbol, timeframe, ts, ts + to_minutes(m) AS closed_at, epoch_us(TIMESTAMP '2024-01-31 12:00:00' - (ts + to_minutes(m))) / 60000000.0 AS age_minutes, m FROM (SELECT symbol, timeframe, max(ts) AS ts, CASE timeframe WHEN '1h' THEN 60 ELSE 1440 END AS m FROM ({bars_sql()}) b GROUP BY 1, 2))".replace("SELECT *, age_minutes > 3 * m AS stale", "SELECT symbol, timeframe, ts, closed_at, age_minutes, age_minutes > 3 * m AS stale"), ["age_minutes"], digits=4)
_both("volatility_shock", lambda s, d, tf: J.volatility_shock(trade_labels(bars(s, d, tf)), bars(s, d, tf)).select("symbol", "timeframe", "bar_idx", "direction", "shock_ratio"), f"""
WITH b AS ({sql(bars_sql(), ['bar_idx', 'atr'])}), c AS (SELECT *, sum(coalesce(atr, 0)) OVER (PARTITION BY symbol, timeframe ORDER BY ts) AS total FROM b)
SELECT l.symbol, l.timeframe, l.bar_idx, l.direction, (e.total - s.total) / (bars_to_resolve + 1) / nullif(s.atr, 0) AS shock_ratio FROM ({labels_sql(bars_sql())}) l JOIN c s USING (symbol, timeframe, bar_idx) JOIN c e ON e.symbol = l.symbol AND e.timeframe = l.timeframe AND e.bar_idx = l.bar_idx + 1 + bars_to_resolve""", ["shock_ratio"], digits=4)  # fmt: skip
_scored = lambda s, d: market.journal(s, d).where("outcome is not null").select((F.col("entry") % 1000 / 1000).alias("p"), (F.col("outcome") == "win").alias("won"))
_query("calibration_bins", lambda s, d: J.calibration(_scored(s, d)), f"""
WITH p AS (SELECT entry % 1000 / 1000 AS p, (outcome = 'win')::INT AS won FROM ({market.JOURNAL_SQL}) j WHERE outcome IS NOT NULL), m AS (SELECT min(p) AS lo, (max(p) - min(p)) / 10 AS step FROM p)
SELECT greatest(0, least(9, ceil((p - lo) / step) - 1))::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(won) AS win_rate, (SELECT avg((p - won) ** 2) FROM p) AS brier FROM p, m GROUP BY 1""", ["mean_p", "win_rate", "brier"], 5)  # fmt: skip
_both("backtest_stats", lambda s, d, tf: J.backtest_stats(trade_labels(bars(s, d, tf))), f"SELECT symbol, timeframe, direction, count(*) AS n, sum(greatest(net_r, 0)) / nullif(sum(greatest(-net_r, 0)), 0) AS profit_factor, avg(net_r) AS mean_r, stddev_samp(net_r) AS std_r FROM ({labels_sql(bars_sql())}) l WHERE outcome <> 'unresolved' GROUP BY ALL", ["profit_factor", "mean_r", "std_r"], digits=4)
