"""Market tables derived from the event, lineitem and order tables: ticks, candles, macro releases, journal.

Every function has a DuckDB counterpart, named *_SQL or *_sql, for the checks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bar sizes as (Spark window, DuckDB interval, minutes); 4h and 1d align with midnight UTC.
TIMEFRAMES = {"1min": 1, "5min": 5, "15min": 15, "1h": 60, "4h": 240, "1d": 1440}
CANDLE = ["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "ask_volume", "bid_volume", "tick_count", "source"]


def ticks_of(events: DataFrame) -> DataFrame:
    """Ticks of symbol ALL and of one symbol per event type: symbol, ts, ask, bid, ask_volume, bid_volume, mid. Without a time or value there is none."""
    return _with_all(_own_ticks(events))


def _own_ticks(events: DataFrame) -> DataFrame:
    """The ticks without symbol ALL."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.where("ts is not null and value is not null").select(
        F.col("event_type").alias("symbol"), "ts", (F.col("value") + 0.05).alias("ask"), (F.col("value") - 0.05).alias("bid"),
        k.alias("ask_volume"), (F.lit(100.0) - k).alias("bid_volume"), F.col("value").alias("mid"),
    )


def _with_all(rows: DataFrame) -> DataFrame:
    return rows.withColumn("symbol", F.explode(F.array(F.lit("ALL"), "symbol")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


TICKS_SQL = """
SELECT unnest(['ALL', event_type]) AS symbol, ts, value + 0.05 AS ask, value - 0.05 AS bid, CAST(json_extract(props, '$.k') AS DOUBLE) AS ask_volume,
       100.0 - CAST(json_extract(props, '$.k') AS DOUBLE) AS bid_volume, value AS mid FROM events WHERE ts IS NOT NULL AND value IS NOT NULL
"""


def resample(t: DataFrame, timeframe: str, source: str = "ticks") -> DataFrame:
    """Tumbling candles of one bar size: first, extreme and last mid, summed volumes, tick count; empty bins give no bar. Ticks of equal time open and close by price."""
    w = F.window("ts", f"{TIMEFRAMES[timeframe]} minutes")
    order = F.struct("ts", "mid")
    total = F.col("ask_volume") + F.col("bid_volume")
    g = t.groupBy("symbol", w.alias("w")).agg(
        F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"),
        F.sum(total).alias("volume"), F.sum("ask_volume").alias("ask_volume"), F.sum("bid_volume").alias("bid_volume"), F.count(F.lit(1)).alias("tick_count"),
    )
    return g.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").cast("timestamp_ntz").alias("ts"), *CANDLE[3:11], F.lit(source).alias("source"))


def candles(spark: SparkSession, sf_dir: str, timeframes: tuple[str, ...] = ("1h",), symbols: tuple[str, ...] | None = None) -> DataFrame:
    """What resample gives for each size. The ticks are read once, for bins of the greatest size that divides all; symbol ALL and the candles are made of the bins."""
    minutes = {tf: TIMEFRAMES[tf] for tf in timeframes}
    total, at = F.col("ask_volume") + F.col("bid_volume"), F.struct("ts", "mid")
    sums = ("volume", "ask_volume", "bid_volume", "tick_count")
    bins = _own_ticks(spark.read.parquet(f"{sf_dir}/events.parquet")).groupBy("symbol", F.window("ts", f"{math.gcd(*minutes.values())} minutes").alias("w")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.max("mid").alias("high"), F.min("mid").alias("low"),
        F.sum(total).alias("volume"), F.sum("ask_volume").alias("ask_volume"), F.sum("bid_volume").alias("bid_volume"), F.count(F.lit(1)).alias("tick_count"),
    )
    bins = _with_all(bins)
    if symbols:
        bins = bins.where(F.col("symbol").isin(*symbols))
    each = bins.withColumn("start", F.col("w.start")).drop("w").withColumn("size", F.explode(F.array(*[F.struct(F.lit(tf).alias("timeframe"), F.lit(m).alias("minutes")) for tf, m in minutes.items()])))
    g = each.groupBy("symbol", F.col("size.timeframe").alias("timeframe"), _bin("start", "size.minutes", dict(each.dtypes)["start"]).alias("ts")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), *[F.sum(x).alias(x) for x in sums]
    )
    prices = {"open": F.col("first.mid"), "close": F.col("last.mid")}
    return g.select(*[prices.get(x, F.col(x)).alias(x) for x in CANDLE[:11]], F.lit("ticks").alias("source"))


def _bin(start: str, minutes: str, kind: str) -> Column:
    """The start of the bin of so many minutes, a divisor of a day, in which a whole minute lies; as F.window has it."""
    if kind == "timestamp":
        at = F.unix_micros(start)
        return F.timestamp_micros(at - F.pmod(at, F.col(minutes) * F.lit(60_000_000).cast("bigint"))).cast("timestamp_ntz")
    return F.expr(f"{start} - make_dt_interval(0, 0, pmod(hour({start}) * 60 + minute({start}), {minutes}), 0)")


def resample_sql(timeframe: str, ticks_sql: str = TICKS_SQL) -> str:
    return f"""
SELECT symbol, '{timeframe}' AS timeframe, time_bucket(INTERVAL '{TIMEFRAMES[timeframe]} minutes', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(mid, (ts, mid)) AS open, max(mid) AS high, min(mid) AS low,
       arg_max(mid, (ts, mid)) AS close, sum(ask_volume + bid_volume) AS volume, sum(ask_volume) AS ask_volume, sum(bid_volume) AS bid_volume, count(*) AS tick_count, 'ticks' AS source
FROM ({ticks_sql}) t GROUP BY 1, 3
"""


def candles_sql(timeframes: tuple[str, ...] = ("1h",), symbols: tuple[str, ...] | None = None) -> str:
    t = TICKS_SQL if not symbols else f"SELECT * FROM ({TICKS_SQL}) s WHERE symbol IN ({', '.join(map(repr, symbols))})"
    return " UNION ALL ".join(f"({resample_sql(tf, t)})" for tf in timeframes)


def daily_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of unit prices of shipped lines, the longest series; equal dates are ordered by order and line."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    order = F.struct("l_orderkey", "l_linenumber")
    g = l.where("l_quantity > 0").withColumn("p", price).groupBy(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("tick_count")
    )
    return g.select(F.lit("SHIP").alias("symbol"), F.lit("1d").alias("timeframe"), "ts", "open", "high", "low", "close", "volume", F.lit(None).cast("double").alias("ask_volume"), F.lit(None).cast("double").alias("bid_volume"), "tick_count", F.lit("lines").alias("source"))


DAILY_SQL = """
SELECT 'SHIP' AS symbol, '1d' AS timeframe, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, arg_min(p, (l_orderkey, l_linenumber)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (l_orderkey, l_linenumber)) AS close,
       sum(l_quantity) AS volume, NULL::DOUBLE AS ask_volume, NULL::DOUBLE AS bid_volume, count(*) AS tick_count, 'lines' AS source
FROM (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS p FROM lineitem WHERE l_quantity > 0) GROUP BY 3
"""

#: Macro series stand-ins by order priority.
MACRO = {"1-URGENT": "CPI", "2-HIGH": "PCE", "3-MEDIUM": "NFP", "4-NOT SPECIFIED": "GDP", "5-LOW": "FOMC"}
_MACRO_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MACRO.items()) + " END"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly macro observations: event_type, reference_period (first of month), value; FOMC values are whole steps of a quarter."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    g = o.where("o_orderdate is not null").groupBy(F.expr(_MACRO_CASE).alias("event_type"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("reference_period")).agg(F.avg("o_totalprice").alias("value"))
    return g.where("event_type is not null").withColumn("value", F.expr("if(event_type = 'FOMC', floor(value / 40000) * 0.25D, round(value, 4))"))


OBSERVATIONS_SQL = f"""
SELECT event_type, reference_period, CASE WHEN event_type = 'FOMC' THEN floor(value / 40000) * 0.25 ELSE round(value, 4) END AS value
FROM (SELECT {_MACRO_CASE} AS event_type, date_trunc('month', o_orderdate)::DATE AS reference_period, avg(o_totalprice) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2) WHERE event_type IS NOT NULL
"""


def release_dates(obs: DataFrame, lag_days: int = 14) -> DataFrame:
    """The publication calendar of the observations: event_type, release_date, ``lag_days`` after the end of each period."""
    return obs.select("event_type", F.date_add(F.last_day("reference_period"), lag_days).alias("release_date")).distinct()


RELEASES_SQL = f"SELECT DISTINCT event_type, (last_day(reference_period) + INTERVAL 14 DAY)::DATE AS release_date FROM ({OBSERVATIONS_SQL}) o"


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade journal of the orders: F has won (even total) or lost, P lost, O is open."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(*[F.expr(e).alias(n) for n, e in _JOURNAL.items()])


_JOURNAL = {
    "signal_id": "cast(o_orderkey as string)",
    "logged_at_utc": "o_orderdate",
    "timeframe": "CASE o_custkey % 3 WHEN 0 THEN '15min' WHEN 1 THEN '1h' ELSE '4h' END",
    "pattern": "concat('p', substr(o_orderpriority, 1, 1))",
    "direction": "CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END",
    "status": "CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END",
    "outcome": "CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'P' THEN 'loss' WHEN (o_orderkey + o_custkey) % 5 < 3 THEN 'win' ELSE 'loss' END",
    "entry": "o_totalprice",
    "risk": "o_totalprice / 100",
    "confluence_count": "o_custkey % 6",
    "regime_at_entry": "CASE o_custkey % 4 WHEN 0 THEN 'HIGH_TRENDING' WHEN 1 THEN 'LOW_RANGING' WHEN 2 THEN 'NORMAL_TRENDING' END",
    "session_at_entry": "CASE o_orderkey % 3 WHEN 0 THEN 'london' WHEN 1 THEN 'new_york' ELSE 'off_hours' END",
    "volatility_shock_ratio": "CAST(o_custkey % 30 AS double) / 10",
}
JOURNAL_SQL = "SELECT " + ", ".join(f"{e.replace('cast(o_orderkey as string)', 'o_orderkey::VARCHAR')} AS {n}" for n, e in _JOURNAL.items()) + " FROM orders"
