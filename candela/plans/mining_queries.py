"""Queries of the mining path: macro events on bars, labels, fired patterns and pairs, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.registry import resolve, select, sql
from ..operators import calendar as C
from ..operators import features as X
from ..operators.labels import labels_sql, trade_labels
from ..sources import market, scratch
from . import mining as M
from .common import ALL, FINE, HOURLY, bars, bars_sql, rounded, rounded_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
_DELTAS = ["value", "prior_value", "change", "pct_change", "vs_trend"]
GRID = (1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)


def _query(name: str, f, query: str | None = None, doubles: list[str] | None = None, digits: int = 6, dates: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
    if query is not None:
        SQL[name] = rounded_sql(query, doubles or [], digits, dates)


def _both(name: str, f, *sql_form, digits: int = 6) -> None:
    """A query f(spark, d, timeframes) at the size that SQL checks, and over all sizes as <name>_all."""
    _query(name, lambda s, d: f(s, d, HOURLY), *sql_form, digits=digits)
    QUERIES[f"{name}_all"] = lambda s, d: rounded(f(s, d, ALL), digits)


# macro events
_query("macro_observations", market.observations, market.OBSERVATIONS_SQL, ["value"], 4, dates=("reference_period",))
_query("asof_forward_releases", lambda s, d: C.align_releases(o := market.observations(s, d), market.release_dates(o)), C.aligned_sql(), ["value"], 4, dates=("reference_period", "release_date"))
_query("asof_forward_releases_compat", lambda s, d: C.align_releases(o := market.observations(s, d), market.release_dates(o), compat=True), C.aligned_sql(True), ["value"], 4, dates=("reference_period", "release_date"))
_query("macro_deltas", lambda s, d: C.macro_deltas(C.align_releases(o := market.observations(s, d), market.release_dates(o))), C.deltas_sql(C.aligned_sql()), _DELTAS, 4, dates=("reference_period", "release_date"))
_query("rate_changes", lambda s, d: C.rate_changes(market.observations(s, d)), C.RATE_CHANGES_SQL, ["value", "prior_value", "change"], 4, dates=("reference_period",))
_query("fundamentals", C.macro_events, C.EVENTS_SQL, ["value", "vs_trend"], 4, dates=("reference_period",))
_both("asof_forward_events", lambda s, d, tf: C.macro_flags(bars(s, d, tf), C.macro_events(s, d)), C.flags_sql(bars_sql()))
_both("surprise_zscores", lambda s, d, tf: C.surprises(bars(s, d, tf), C.macro_events(s, d)).select("symbol", "timeframe", "ts", *[f"{k.lower()}_surprise" for k in C.KINDS]), f"SELECT symbol, timeframe, ts, cpi_surprise, pce_surprise, nfp_surprise, gdp_surprise FROM ({C.surprises_sql(bars_sql())}) q", [f"{k.lower()}_surprise" for k in C.KINDS], digits=4)
_both("asof_backward_context", lambda s, d, tf: C.attach_context(bars(s, d, tf), C.context_series(s, d)).select("symbol", "timeframe", "ts", "dxy", "real_yield_10y"), f"SELECT symbol, timeframe, ts, dxy, real_yield_10y FROM ({C.context_sql(bars_sql())}) q", ["dxy", "real_yield_10y"])
_query("upcoming_calendar", lambda s, d: C.upcoming(market.release_dates(market.observations(s, d)), "2000-01-01"), f"SELECT {C.published_sql('release_date')} AS datetime_utc, event_type, 'high' AS impact FROM ({market.RELEASES_SQL}) r WHERE release_date >= DATE '2000-01-01'")
_query("events_in_window", lambda s, d: C.events_in_window(C.macro_events(s, d), "1997-01-01", "1997-06-30 12:30:00", "high"), f"SELECT * FROM ({C.EVENTS_SQL}) e WHERE datetime_utc BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30 12:30:00'", ["value", "vs_trend"], 4, dates=("reference_period",))


def _vintages(spark, d) -> DataFrame:
    """Order totals of a day as wide vintages: the first is missing on even days, the second is the count, the third the sum."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderdate is not null")
    g = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("k"))
    first = F.when(F.col("n") % 2 == 0, F.lit(".")).otherwise(F.col("n").cast("string"))
    return g.select("date", F.create_map(F.lit("20200101"), first, F.lit("20200201"), F.when(F.col("k") % 5 == 0, F.lit("")).otherwise((F.col("n") + 1).cast("string")), F.lit("20200301"), F.col("k").cast("string")).alias("vintages"))


_query("first_published_vintage", lambda s, d: C.first_published(_vintages(s, d)), "SELECT date, CASE WHEN n % 2 = 1 THEN '20200101' WHEN k % 5 <> 0 THEN '20200201' ELSE '20200301' END AS vintage, (CASE WHEN n % 2 = 1 THEN n WHEN k % 5 <> 0 THEN n + 1 ELSE k END)::DOUBLE AS value FROM (SELECT o_orderdate::DATE AS date, count(*) AS n, max(o_orderkey) AS k FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)", ["value"], dates=("date",))
_query("news_risk", lambda s, d: C.news_risk(market.release_dates(market.observations(s, d)).select(F.col("release_date").cast("timestamp_ntz").alias("now")).distinct().withColumn("median_bars", F.lit(30)).withColumn("minutes", F.lit(60)), C.macro_events(s, d)).select("now", "expected_resolution_utc", "news_in_window", F.coalesce(F.size("high_impact_events"), F.lit(0)).cast("bigint").alias("n_events")), f"SELECT now, now + INTERVAL 30 HOUR AS expected_resolution_utc, count(e.datetime_utc) > 0 AS news_in_window, count(e.datetime_utc) AS n_events FROM (SELECT DISTINCT release_date::TIMESTAMP AS now FROM ({market.RELEASES_SQL}) r) s LEFT JOIN (SELECT DISTINCT datetime_utc, event_type FROM ({C.EVENTS_SQL}) v) e ON e.datetime_utc BETWEEN now AND now + INTERVAL 30 HOUR GROUP BY 1, 2")

# labels
_LABEL = ["entry", "stop", "target", "risk", "net_r"]
_query("trade_labels", lambda s, d: trade_labels(bars(s, d, FINE)), labels_sql(bars_sql(FINE)), _LABEL, 4)
QUERIES["trade_labels_all"] = lambda s, d: rounded(trade_labels(bars(s, d, ALL)), 4)
_both("trade_labels_grid", lambda s, d, tf: trade_labels(bars(s, d, tf), GRID).groupBy("symbol", "timeframe", "direction", "rr", "outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("net_r").alias("net_r")), f"SELECT symbol, timeframe, direction, rr, outcome, count(*) AS n, avg(net_r) AS net_r FROM ({labels_sql(bars_sql(), GRID)}) l GROUP BY ALL", ["net_r"], digits=4)


# fired patterns and pairs
def stored_bars(spark, d, timeframes: tuple[str, ...] = HOURLY) -> DataFrame:
    """The bars, resampled once and written, for plans that read them several times."""
    return scratch.written(bars(spark, d, timeframes), "bars")


def stored_events(spark, d) -> DataFrame:
    """The macro events, a few a month, written, for plans that read them several times."""
    return scratch.written(C.macro_events(spark, d), "events")


def flags(spark, d, timeframes: tuple[str, ...] = HOURLY, b: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Fired flags of all 80 atomic patterns over the bars of the given sizes and the daily series."""
    b = stored_bars(spark, d, timeframes) if b is None else b
    idx = select(b, ["bar_idx"])
    macro = C.macro_flags(b, C.macro_events(spark, d) if events is None else events).join(idx, ["symbol", "timeframe", "ts"])
    return M.fired(b).unionByName(macro)


FLAGS_SQL = f"""
SELECT symbol, timeframe, ts, bar_idx, pattern FROM ({M.fired_sql(bars_sql())}) f0
UNION ALL SELECT f1.symbol, f1.timeframe, f1.ts, bar_idx, pattern FROM ({C.flags_sql(bars_sql())}) f1 JOIN (SELECT symbol, timeframe, ts, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) - 1 AS bar_idx FROM ({bars_sql()}) f2) f3 USING (symbol, timeframe, ts)
"""
_query("pattern_dim", lambda s, d: M.pattern_dim(s), M.dim_sql())
_query("combo_pairs", lambda s, d: M.combo_pairs(M.pattern_dim(s)), M.pairs_sql())
_both("fired_patterns", flags, FLAGS_SQL)
_both("combo_events", lambda s, d, tf: M.combo_events(scratch.written(flags(s, d, tf), "fired"), M.combo_pairs(M.pattern_dim(s))), f"""
WITH f AS MATERIALIZED (SELECT symbol, timeframe, bar_idx, pattern, family_rank, hint FROM ({FLAGS_SQL}) f9 JOIN ({M.dim_sql()}) d9 USING (pattern))
SELECT a.symbol, a.timeframe, a.bar_idx, 'combo__' || a.pattern || '__' || b.pattern AS pattern, CASE WHEN a.hint <> 0 THEN a.hint ELSE b.hint END AS hint
FROM f a JOIN f b ON a.symbol = b.symbol AND a.timeframe = b.timeframe AND a.bar_idx = b.bar_idx AND a.family_rank < b.family_rank WHERE a.hint * b.hint >= 0""")


def trades(spark, d, pairs: bool = False, ratios: tuple[float, ...] = (4.0,), timeframes: tuple[str, ...] = HOURLY, b: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Every occurrence of a pattern (and pair) with its labels. b, events: the stored bars and events, if the query has them already."""
    dim, b = M.pattern_dim(spark), stored_bars(spark, d, timeframes) if b is None else b
    # each is written, so no plan on the driver holds the windows of all patterns and those of the labels
    fired = scratch.written(flags(spark, d, timeframes, b, events), "fired")
    labels = scratch.written(trade_labels(b, ratios).drop("ts"), "labels")
    return M.trades(M.occurrences(fired, dim, M.combo_pairs(dim) if pairs else None), labels)


def trades_sql(pairs: bool = False, ratios: tuple[float, ...] = (4.0,)) -> str:
    events = f"SELECT symbol, timeframe, bar_idx, pattern, hint, 30 AS min_resolved, 10 AS min_oos FROM f JOIN ({M.dim_sql()}) d0 USING (pattern)"
    if pairs:
        events += f" UNION ALL SELECT a.symbol, a.timeframe, a.bar_idx, p.pattern, p.hint, 40, 15 FROM f a JOIN f b USING (symbol, timeframe, bar_idx) JOIN ({M.pairs_sql()}) p ON p.a = a.pattern AND p.b = b.pattern"
    return f"WITH f AS MATERIALIZED ({FLAGS_SQL}), o AS ({events}) SELECT o.*, l.* EXCLUDE (symbol, timeframe, ts, bar_idx) FROM o JOIN ({labels_sql(bars_sql(), ratios)}) l USING (symbol, timeframe, bar_idx) WHERE hint = 0 OR hint = direction"


_MEASURES = ["win_rate", "wilson_lower", "expectancy_r", "expectancy_net_r", "avg_risk", "median_bars"]
_BOTH = [*_MEASURES, *[f"oos_{m}" for m in _MEASURES]]
_both("trade_summary_oos", lambda s, d, tf: M.graded(trades(s, d, timeframes=tf)), M.graded_sql(trades_sql()), _BOTH)
_both("pattern_library", lambda s, d, tf: M.graded(trades(s, d, True, timeframes=tf)), M.graded_sql(trades_sql(True)), _BOTH)
_both("trade_summary", lambda s, d, tf: trades(s, d, timeframes=tf).groupBy("pattern", "direction").agg(*M.summary()), f"SELECT pattern, direction, {M.summary_sql()} FROM ({trades_sql()}) t GROUP BY ALL", _MEASURES)


def with_regime(spark, d, timeframes: tuple[str, ...] = HOURLY, pairs: bool = False, b: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Trades with the regime of their entry bar, the one after the signal."""
    b = stored_bars(spark, d, timeframes) if b is None else b
    at_entry = resolve(b, ["bar_idx", "combined_regime"]).select("symbol", "timeframe", (F.col("bar_idx") - 1).alias("bar_idx"), F.col("combined_regime").alias("regime"))
    return trades(spark, d, pairs, timeframes=timeframes, b=b, events=events).join(at_entry, M.KEY)


_REGIME_SQL = f"""
SELECT t.*, r.combined_regime AS regime FROM ({trades_sql()}) t
JOIN ({sql(bars_sql(), ['bar_idx', 'combined_regime'])}) r ON r.symbol = t.symbol AND r.timeframe = t.timeframe AND r.bar_idx = t.bar_idx + 1
"""
_GROUP = ", ".join(M.GROUP)
_both("by_regime", lambda s, d, tf: M.by_context(with_regime(s, d, tf), "regime"), M.graded_sql(f"SELECT * FROM ({_REGIME_SQL}) t WHERE regime IS NOT NULL", ["regime"]), _BOTH)
QUERIES["library_by_regime_all"] = lambda s, d: rounded(M.by_context(with_regime(s, d, ALL, True), "regime"))
_both("news_in_window", lambda s, d, tf: C.tag_news(trade_labels(b := stored_bars(s, d, tf)), b, stored_events(s, d)).select("symbol", "timeframe", "bar_idx", "direction", "rr", "news"), f"SELECT symbol, timeframe, bar_idx, direction, rr, news FROM ({C.news_sql(labels_sql(bars_sql()), bars_sql())}) q")


def with_news(spark, d, timeframes: tuple[str, ...] = HOURLY, pairs: bool = False) -> DataFrame:
    b, events = stored_bars(spark, d, timeframes), stored_events(spark, d)
    return C.tag_news(trades(spark, d, pairs, timeframes=timeframes, b=b, events=events), b, events)


def with_both(spark, d, timeframes: tuple[str, ...] = HOURLY) -> DataFrame:
    """Trades with the regime of their entry bar and with news."""
    b, events = stored_bars(spark, d, timeframes), stored_events(spark, d)
    return C.tag_news(with_regime(spark, d, timeframes, b=b, events=events), b, events)


_both("by_news", lambda s, d, tf: M.by_context(with_news(s, d, tf), "news"), M.graded_sql(C.news_sql(trades_sql(), bars_sql()), ["news"]), _BOTH)
QUERIES["library_by_news_all"] = lambda s, d: rounded(M.by_context(with_news(s, d, ALL, True), "news"))
_both("grouping_sets_summary", lambda s, d, tf: M.all_grains(with_both(s, d, tf)), f"SELECT {_GROUP}, news, regime, grouping({_GROUP}, news, regime) AS grain, {M.summary_sql()} FROM ({C.news_sql(_REGIME_SQL, bars_sql())}) t GROUP BY GROUPING SETS (({_GROUP}), ({_GROUP}, news), ({_GROUP}, regime))", _MEASURES)
_both("rr_grid_expectancy", lambda s, d, tf: M.reward_grid(trades(s, d, ratios=GRID, timeframes=tf)), f"""
WITH g AS (SELECT {_GROUP}, rr, count(*) FILTER (outcome <> 'unresolved') AS resolved, round(avg(net_r), 6) AS net FROM ({trades_sql(ratios=GRID)}) t GROUP BY ALL)
SELECT {_GROUP}, arg_max(rr, (net, -rr)) AS best_rr, max(net) AS best_net_r, count(*) AS tiers FROM g WHERE resolved >= 10 GROUP BY ALL""", ["best_rr", "best_net_r"], digits=4)  # fmt: skip
_both("era_scores", lambda s, d, tf: M.era_scores(trades(s, d, timeframes=tf)), f"""
WITH t0 AS ({trades_sql()}), t1 AS (SELECT *, floor((max(bar_idx) OVER (PARTITION BY symbol, timeframe) + 1) * 0.75::DOUBLE) AS fin FROM t0),
p AS (SELECT {_GROUP}, least(3, floor(bar_idx * 4 / fin)) AS era, count(*) FILTER (outcome <> 'unresolved') AS resolved, count(*) FILTER (outcome = 'win') AS wins FROM t1 WHERE bar_idx < fin GROUP BY ALL)
SELECT {_GROUP}, round(CASE WHEN count(*) < 4 THEN 0.0 ELSE min(CASE WHEN resolved < 20 THEN 0.0 ELSE {stats.wilson_sql('wins', 'resolved')} END) END, 6) AS worst_era_score, count(*) AS eras, sum(resolved)::BIGINT AS resolved FROM p GROUP BY ALL""", ["worst_era_score"], digits=4)  # fmt: skip
_both("win_rate_buckets", lambda s, d, tf: trades(s, d, timeframes=tf).groupBy(*M.GROUP).agg(*M.summary()).groupBy("timeframe", F.expr("case when win_rate is null then 'none' when win_rate < 0.2 then 'a' when win_rate < 0.4 then 'b' when win_rate < 0.6 then 'c' else 'd' end").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("resolved").alias("resolved")), f"SELECT timeframe, CASE WHEN win_rate IS NULL THEN 'none' WHEN win_rate < 0.2 THEN 'a' WHEN win_rate < 0.4 THEN 'b' WHEN win_rate < 0.6 THEN 'c' ELSE 'd' END AS bucket, count(*) AS n, sum(resolved)::BIGINT AS resolved FROM (SELECT {_GROUP}, {M.summary_sql()} FROM ({trades_sql()}) t GROUP BY {_GROUP}) g GROUP BY 1, 2")
_both("topk_patterns", lambda s, d, tf: trades(s, d, timeframes=tf).groupBy("pattern", "direction").agg(*M.summary()).where("resolved >= 30").orderBy(F.desc("win_rate"), "pattern", "direction").limit(15).select("pattern", "direction", "resolved", "win_rate"), f"SELECT pattern, direction, resolved, win_rate FROM (SELECT pattern, direction, {M.summary_sql()} FROM ({trades_sql()}) t GROUP BY ALL) g WHERE resolved >= 30 ORDER BY win_rate DESC, pattern, direction LIMIT 15", ["win_rate"])
_both("strategy_backtest", lambda s, d, tf: M.graded(trades(s, d, timeframes=tf).where("pattern like 'smc_%' or pattern like 'trend_following%'")), M.graded_sql(f"SELECT * FROM ({trades_sql()}) t9 WHERE pattern LIKE 'smc_%' OR pattern LIKE 'trend_following%'"), _BOTH)


def _p_values(spark, d, timeframes: tuple[str, ...] = ALL) -> DataFrame:
    """Exact one-sided p-values of each pattern or pair, series and direction against the least win rate that qualifies."""
    g = trades(spark, d, True, timeframes=timeframes).groupBy(*M.GROUP).agg(F.count_if(F.col("outcome") != "unresolved").alias("n"), F.count_if(F.col("outcome") == "win").alias("wins"))
    return g.withColumn("p_value", stats.binomial_p(F.col("wins"), F.col("n"), M.MIN_WIN_RATE)).withColumn("name", F.concat_ws("/", "pattern", "direction"))


def trials(spark) -> int:
    """Patterns and pairs in each direction that their hints allow: the trials of one series, whether or not they fire."""
    dim = M.pattern_dim(spark)
    both = dim.select("hint").unionByName(M.combo_pairs(dim).select("hint"))
    return both.agg(F.sum(F.when(F.col("hint") == 0, 2).otherwise(1))).first()[0]


_query("binomial_p", lambda s, d: _p_values(s, d).select("symbol", "timeframe", "name", "n", "wins", "p_value"))
_query("fdr_accept", lambda s, d: stats.bh_accept(_p_values(s, d), n_tested=trials(s), by=("symbol", "timeframe")).select("symbol", "timeframe", "name", "n", "wins", "p_value", "rank", "accepted"))
_query("bh_correction", lambda s, d: stats.bh_accept(spark_p(s, d)).select("name", "p_value", "rank", "threshold", "accepted"), """
WITH p AS (SELECT n_name AS name, n_nationkey * n_nationkey / 4000.0::DOUBLE AS p_value FROM nation),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS rank, count(*) OVER () AS n FROM p), t AS (SELECT *, rank * 0.05::DOUBLE / n AS threshold FROM r)
SELECT name, p_value, rank, threshold, rank <= coalesce((SELECT max(rank) FROM t WHERE p_value <= threshold), 0) AS accepted FROM t""", ["p_value", "threshold"])  # fmt: skip


def spark_p(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * F.col("n_nationkey") / F.lit(4000.0)).alias("p_value"))


# features
_both("feature_table", lambda s, d, tf: X.features(bars(s, d, tf)).drop("bar_idx"), sql(bars_sql(), X.FEATURES), X.FEATURES, digits=9)
_CTX = ["ctx_" + n.removeprefix("f_") for n in X.COARSE]
_query("cross_timeframe_context", lambda s, d: X.coarser(select(market.candles(s, d, ("15min",)), ["close"]), market.candles(s, d, ("1h",)), 60), f"""
SELECT f.symbol, f.timeframe, f.ts, f.close, {', '.join(f'c.{n} AS {x}' for n, x in zip(X.COARSE, _CTX))} FROM ({market.candles_sql(('15min',))}) f
ASOF LEFT JOIN (SELECT * REPLACE (ts + INTERVAL 60 MINUTE AS ts) FROM ({sql(market.candles_sql(('1h',)), X.COARSE)}) c0) c ON f.symbol = c.symbol AND f.ts >= c.ts""", ["close", *_CTX], 4)  # fmt: skip
