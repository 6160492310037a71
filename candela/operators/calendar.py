"""Macro calendar: releases aligned with observations, deltas, flags and surprises on bars, news windows, context series.

Each function that a query uses has its DuckDB SQL beside it, named *_sql or in capitals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import market
from .asof import asof_join

ZONE = "America/New_York"
#: Local minutes of publication, by event type; others are published like CPI.
RELEASE_MINUTES = {"CPI": 510, "PCE": 510, "NFP": 510, "GDP": 510, "FOMC": 840}
HIGH_IMPACT = tuple(RELEASE_MINUTES)
KINDS = ("CPI", "PCE", "NFP", "GDP")
_MINUTES = "CASE WHEN event_type = 'FOMC' THEN 840 ELSE 510 END"


def impact_of(event_type: Column) -> Column:
    return F.when(event_type.isin(*HIGH_IMPACT), "high").otherwise("normal")


def published_at(date: str) -> Column:
    """UTC time of a release on a local date, by event_type; right across DST changes."""
    return F.expr(f"convert_timezone('{ZONE}', 'UTC', cast({date} as timestamp_ntz) + make_dt_interval(0, 0, {_MINUTES}))")


def published_sql(date: str) -> str:
    return f"timezone('UTC', timezone('{ZONE}', {date}::TIMESTAMP + to_minutes({_MINUTES})))"


def align_releases(observations: DataFrame, releases: DataFrame, compat: bool = False) -> DataFrame:
    """Observations with the first release_date after their period ends; compat: on or after the period's first day, which looks ahead.

    Observations without a later release are left out.
    """
    ready = F.col("reference_period") if compat else F.date_add(F.last_day("reference_period"), 1)
    out = asof_join(observations.withColumn("ready", ready), releases, ["event_type"], "ready", "release_date", ["release_date"], "forward")
    return out.where("release_date is not null").drop("ready")


def aligned_sql(compat: bool = False) -> str:
    ready = "o.reference_period" if compat else "(last_day(o.reference_period) + INTERVAL 1 DAY)::DATE"
    return f"SELECT o.event_type, o.reference_period, o.value, r.release_date FROM ({market.OBSERVATIONS_SQL}) o ASOF JOIN ({market.RELEASES_SQL}) r ON o.event_type = r.event_type AND {ready} <= r.release_date"


def macro_deltas(aligned: DataFrame) -> DataFrame:
    """Adds prior_value, change, pct_change (of the absolute prior value), vs_trend (change less the mean of the three before) and datetime_utc."""
    w = Window.partitionBy("event_type").orderBy("reference_period")
    before = w.rowsBetween(-3, -1)
    df = aligned.withColumn("prior_value", F.lag("value").over(w)).withColumn("change", F.expr("value - prior_value")).withColumn("pct_change", F.expr("change / nullif(abs(prior_value), 0)"))
    trend = F.when(F.count("change").over(before) == 3, F.avg("change").over(before))
    return df.withColumn("vs_trend", F.col("change") - trend).withColumn("datetime_utc", published_at("release_date"))


def deltas_sql(aligned: str) -> str:
    w = "PARTITION BY event_type ORDER BY reference_period"
    return f"""
SELECT *, change / nullif(abs(prior_value), 0) AS pct_change, CASE WHEN count(change) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN change - avg(change) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS vs_trend,
       {published_sql('release_date')} AS datetime_utc
FROM (SELECT *, value - prior_value AS change FROM (SELECT *, lag(value) OVER ({w}) AS prior_value FROM ({aligned}) a0) a1) a2
"""


def rate_changes(observations: DataFrame) -> DataFrame:
    """Changes of the policy rate as events: fomc_direction hike or cut, at the announcement on the period's first day."""
    w = Window.partitionBy("event_type").orderBy("reference_period")
    df = observations.where("event_type = 'FOMC'").withColumn("prior_value", F.lag("value").over(w)).withColumn("change", F.round(F.expr("value - prior_value"), 4)).where("change <> 0")
    return df.withColumn("fomc_direction", F.expr("if(change > 0, 'hike', 'cut')")).withColumn("datetime_utc", published_at("reference_period"))


RATE_CHANGES_SQL = f"""
SELECT event_type, reference_period, value, prior_value, round(value - prior_value, 4) AS change, CASE WHEN value > prior_value THEN 'hike' ELSE 'cut' END AS fomc_direction, {published_sql('reference_period')} AS datetime_utc
FROM (SELECT *, lag(value) OVER (ORDER BY reference_period) AS prior_value FROM ({market.OBSERVATIONS_SQL}) o WHERE event_type = 'FOMC') WHERE round(value - prior_value, 4) <> 0
"""


def macro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events: datetime_utc, event_type, reference_period, value, vs_trend, fomc_direction."""
    obs = market.observations(spark, sf_dir)
    macro = macro_deltas(align_releases(obs.where(F.col("event_type").isin(*KINDS)), market.release_dates(obs)))
    return macro.unionByName(rate_changes(obs), allowMissingColumns=True).select("datetime_utc", "event_type", "reference_period", "value", "vs_trend", "fomc_direction")


_KINDS_SQL = ", ".join(f"'{k}'" for k in KINDS)
EVENTS_SQL = f"""
SELECT datetime_utc, event_type, reference_period, value, vs_trend, NULL AS fomc_direction FROM ({deltas_sql(aligned_sql())}) d WHERE event_type IN ({_KINDS_SQL})
UNION ALL SELECT datetime_utc, event_type, reference_period, value, NULL, fomc_direction FROM ({RATE_CHANGES_SQL}) f
"""


def _flag() -> str:
    return "CASE WHEN event_type = 'FOMC' THEN concat('fundamental_fomc_', fomc_direction) WHEN vs_trend > 0 THEN concat('fundamental_', lower(event_type), '_accelerating') WHEN vs_trend < 0 THEN concat('fundamental_', lower(event_type), '_decelerating') END"


def macro_flags(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Macro patterns in long form, on the first bar at or after each event: symbol, timeframe, ts, pattern."""
    e = events.withColumn("pattern", F.expr(_flag())).where("pattern is not null")
    series = bars.select("symbol", "timeframe").distinct()
    # one row per event and series: the right side is a calendar, a few rows a month
    spread = series.crossJoin((e.select("datetime_utc", "pattern").distinct()))
    hit = asof_join(spread, bars.select("symbol", "timeframe", "ts"), ["symbol", "timeframe"], "datetime_utc", "ts", ["ts"], "forward")
    return hit.where("ts is not null").select("symbol", "timeframe", "ts", "pattern").distinct()


def flags_sql(bars: str) -> str:
    return f"""
SELECT DISTINCT b.symbol, b.timeframe, b.ts, e.pattern FROM (SELECT DISTINCT s.symbol, s.timeframe, v.datetime_utc, {_flag()} AS pattern FROM (SELECT DISTINCT symbol, timeframe FROM ({bars}) b0) s CROSS JOIN ({EVENTS_SQL}) v) e
ASOF JOIN ({bars}) b ON e.symbol = b.symbol AND e.timeframe = b.timeframe AND e.datetime_utc <= b.ts WHERE e.pattern IS NOT NULL
"""


def surprises(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars with {cpi,pce,nfp,gdp}_surprise: vs_trend of the last release over the deviation of the eight before it (three at least)."""
    w = Window.partitionBy("event_type").orderBy("datetime_utc", "reference_period").rowsBetween(-8, -1)
    spread = F.when(F.count("vs_trend").over(w) >= 3, F.stddev_samp("vs_trend").over(w))
    z = events.where(F.col("event_type").isin(*KINDS)).withColumn("surprise", F.col("vs_trend") / F.nullif(spread, F.lit(0.0)))
    # one calendar with the last release of each kind at every time, so the bars are sorted once
    names = {f"{kind.lower()}_surprise": kind for kind in KINDS}
    of = lambda kind, c: F.when(F.col("event_type") == kind, c)
    at = z.groupBy("datetime_utc").agg(*[F.max_by(of(kind, F.struct("surprise")), of(kind, F.col("reference_period"))).alias(n) for n, kind in names.items()])
    upto = Window.partitionBy(F.lit(1)).orderBy("datetime_utc").rowsBetween(Window.unboundedPreceding, 0)
    known = at.select("datetime_utc", *[F.last(n, ignorenulls=True).over(upto)["surprise"].alias(n) for n in names])
    return asof_join(bars, bars.select("symbol", "timeframe").distinct().crossJoin(known), ["symbol", "timeframe"], "ts", "datetime_utc", list(names))


def surprises_sql(bars: str) -> str:
    w = "PARTITION BY event_type ORDER BY datetime_utc, reference_period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING"
    out = f"({bars}) b"
    columns = []
    for kind in KINDS:
        k = kind.lower()
        out += f" ASOF LEFT JOIN (SELECT datetime_utc, arg_max(surprise, reference_period) AS {k}_surprise FROM z WHERE event_type = '{kind}' GROUP BY 1) {k} ON b.ts >= {k}.datetime_utc"
        columns.append(f"{k}_surprise")
    return f"""
WITH z AS (SELECT event_type, datetime_utc, reference_period, vs_trend / nullif(CASE WHEN count(vs_trend) OVER ({w}) >= 3 THEN stddev_samp(vs_trend) OVER ({w}) END, 0) AS surprise FROM ({EVENTS_SQL}) e WHERE event_type IN ({_KINDS_SQL}))
SELECT b.*, {', '.join(columns)} FROM {out}
"""


def context_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily stand-ins of the dollar index and the real yield: date, dxy, real_yield_10y."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderdate is not null")
    return o.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("date")).agg(F.round(F.avg("o_totalprice") / 1000, 3).alias("dxy"), F.round(F.avg(F.col("o_custkey") % 7), 3).alias("real_yield_10y"))


CONTEXT_SQL = "SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS date, round(avg(o_totalprice) / 1000, 3) AS dxy, round(avg(o_custkey % 7), 3) AS real_yield_10y FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"


def attach_context(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Bars with the last context values at or before them; the one series is repeated for each bar series."""
    series = bars.select("symbol", "timeframe").distinct()
    spread = context.crossJoin(series)
    return asof_join(bars, spread, ["symbol", "timeframe"], "ts", "date", ["dxy", "real_yield_10y"])


def context_sql(bars: str) -> str:
    return f"SELECT b.*, c.dxy, c.real_yield_10y FROM ({bars}) b ASOF LEFT JOIN ({CONTEXT_SQL}) c ON b.ts >= c.date"


def tag_news(trades: DataFrame, bars: DataFrame, events: DataFrame, lookahead: int = 60) -> DataFrame:
    """Trades with news: whether a high-impact event lies between the entry bar and the resolution (or lookahead) bar, both included.

    Counted as the difference of two running counts over the bars, so no event is joined to a span.
    """
    high = events.where(impact_of(F.col("event_type")) == "high").groupBy("datetime_utc").agg(F.count(F.lit(1)).alias("k"))
    before = high.withColumn("upto", F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("datetime_utc"))).withColumn("below", F.col("upto") - F.col("k"))
    series = bars.select("symbol", "timeframe").distinct()
    spread = series.crossJoin(before)
    w = Window.partitionBy("symbol", "timeframe").orderBy("ts")
    b = bars.select("symbol", "timeframe", "ts").withColumn("bar_idx", F.row_number().over(w) - 1)
    upto = asof_join(b, spread, ["symbol", "timeframe"], "ts", "datetime_utc", ["upto"])
    # events strictly before a bar: those up to it less those at its very time
    at = spread.select("symbol", "timeframe", F.col("datetime_utc").alias("ts"), F.col("k").alias("here"))
    counted = upto.join(at, ["symbol", "timeframe", "ts"], "left").select("symbol", "timeframe", "bar_idx", F.coalesce("upto", F.lit(0)).alias("upto"), (F.coalesce("upto", F.lit(0)) - F.coalesce("here", F.lit(0))).alias("below"), F.max("bar_idx").over(Window.partitionBy("symbol", "timeframe")).alias("last_idx"))
    first = counted.select("symbol", "timeframe", F.col("bar_idx").alias("entry_idx"), F.col("below").alias("n0"), "last_idx")
    last = counted.select("symbol", "timeframe", F.col("bar_idx").alias("end_idx"), F.col("upto").alias("n1"))
    t = trades.withColumn("entry_idx", F.col("bar_idx") + 1).join(first, ["symbol", "timeframe", "entry_idx"])
    t = t.withColumn("end_idx", F.least("last_idx", F.col("entry_idx") + F.coalesce("bars_to_resolve", F.lit(lookahead))))
    return t.join(last, ["symbol", "timeframe", "end_idx"]).withColumn("news", F.expr("n1 > n0")).drop("entry_idx", "end_idx", "last_idx", "n0", "n1")


def news_sql(trades: str, bars: str, lookahead: int = 60) -> str:
    return f"""
WITH nb AS (SELECT symbol, timeframe, ts, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) - 1 AS idx FROM ({bars}) b0),
nl AS (SELECT symbol, timeframe, max(idx) AS last_idx FROM nb GROUP BY ALL),
ev AS (SELECT DISTINCT datetime_utc FROM ({EVENTS_SQL}) e0)
SELECT t.*, EXISTS (SELECT 1 FROM ev WHERE ev.datetime_utc BETWEEN s.ts AND e.ts) AS news
FROM ({trades}) t JOIN nl USING (symbol, timeframe) JOIN nb s ON s.symbol = t.symbol AND s.timeframe = t.timeframe AND s.idx = t.bar_idx + 1
JOIN nb e ON e.symbol = t.symbol AND e.timeframe = t.timeframe AND e.idx = least(nl.last_idx, t.bar_idx + 1 + coalesce(t.bars_to_resolve, {lookahead}))
"""


def upcoming(releases: DataFrame, now: str) -> DataFrame:
    """Releases on or after the day of ``now``: datetime_utc, event_type, impact."""
    return releases.where(F.col("release_date") >= F.lit(now).cast("date")).select(published_at("release_date").alias("datetime_utc"), "event_type", impact_of(F.col("event_type")).alias("impact"))


def events_in_window(events: DataFrame, start: str, end: str, impact: str | None = None) -> DataFrame:
    """Events from start to end, both included; of one impact if given."""
    out = events.where(F.col("datetime_utc").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return out if impact is None else out.where(impact_of(F.col("event_type")) == impact)


def news_risk(signals: DataFrame, events: DataFrame) -> DataFrame:
    """Signals (now, median_bars, minutes) with expected_resolution_utc and the high-impact events up to it; all null or empty for an unknown median."""
    high = events.where(impact_of(F.col("event_type")) == "high").select("datetime_utc", "event_type").distinct()
    s = signals.withColumn("expected_resolution_utc", F.expr("now + make_dt_interval(0, 0, 0, median_bars * minutes * 60)")).withColumn("signal_row", F.monotonically_increasing_id())
    inside = F.expr("datetime_utc between now and expected_resolution_utc")
    hits = s.join(high, inside).groupBy("signal_row").agg(F.array_sort(F.collect_list(F.struct("datetime_utc", "event_type"))).alias("high_impact_events"))
    return s.join(hits, "signal_row", "left").withColumn("news_in_window", F.expr("case when expected_resolution_utc is not null then high_impact_events is not null end")).drop("signal_row")


def first_published(observations: DataFrame) -> DataFrame:
    """The earliest value that isn't missing ('.' or '') of each date: from (date, vintages map of yyyymmdd to text) to date, vintage, value."""
    v = observations.select("date", F.explode("vintages").alias("vintage", "text")).where("text is not null and text not in ('.', '')")
    return v.groupBy("date").agg(F.min("vintage").alias("vintage"), F.min_by(F.expr("try_cast(text as double)"), "vintage").alias("value"))
