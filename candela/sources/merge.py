"""Merging and checking bars: upsert by source priority, partial updates, gaps, coverage, tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .market import TIMEFRAMES

KEY = ["symbol", "timeframe", "ts"]
PRIORITY = {"dukascopy": 2, "mt_broker": 1}


def upsert(rows: DataFrame, ingested: str | None = None) -> DataFrame:
    """One row per bar: that of the highest source priority, then of the latest ``ingested`` time, then the least by its other values.

    A null or unknown source ranks last.
    """
    rank = F.when(F.col("source") == "dukascopy", 2).when(F.col("source") == "mt_broker", 1).otherwise(0)
    later = [F.col(ingested).desc_nulls_last()] if ingested else []
    rest = [F.col(c) for c in rows.columns if c not in (*KEY, "source", ingested)]
    w = Window.partitionBy(*KEY).orderBy(rank.desc(), *later, *rest)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def update_columns(rows: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the non-null values of new in the given columns, by bar; new has one row per bar at most."""
    n = new.select(*KEY, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(n, KEY, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*rows.columns)


def minutes(timeframe: str = "timeframe") -> str:
    return f"CASE {timeframe} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TIMEFRAMES.items()) + " END"


def gaps(bars: DataFrame, hours: float = 56.0) -> DataFrame:
    """Neighbouring bars more than max(hours, three bars) apart: gap_from, gap_to, gap_hours."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("ts")
    df = bars.select("symbol", "timeframe", F.lag("ts").over(w).alias("gap_from"), F.col("ts").alias("gap_to"))
    df = df.withColumn("gap_hours", F.expr("timestampdiff(MICROSECOND, gap_from, gap_to) / 3600000000.0D"))
    return df.where(f"gap_hours > greatest({hours}D, 3.0D * {minutes()} / 60)")


def coverage(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of each series in [start, end) and whether they are 40 % or more of what five days a week would have."""
    span = F.expr(f"timestampdiff(HOUR, timestamp_ntz'{start}', timestamp_ntz'{end}')")
    inside = bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return inside.groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("n_bars")).withColumn("covered", F.col("n_bars") >= span * F.lit(0.4 * 5 / 7) * (F.lit(60.0) / F.expr(minutes())))


def sanity(ticks: DataFrame, low: float = 200.0, high: float = 20_000.0, most: float = 0.01) -> DataFrame:
    """Share of ticks outside [low, high] in each hour, and whether that is too many."""
    bad = F.avg(F.when((F.col("mid") < low) | (F.col("mid") > high), 1.0).otherwise(0.0))
    return ticks.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n_ticks"), bad.alias("bad_share")).withColumn("rejected", F.col("bad_share") > most)


def dedup_ticks(ticks: DataFrame) -> DataFrame:
    """One tick per symbol and time, the one with the least mid, whole; ties by the other columns in their order."""
    others = [c for c in ticks.columns if c not in ("symbol", "ts", "mid")]
    return ticks.groupBy("symbol", "ts").agg(F.min(F.struct("mid", *others)).alias("t")).select("symbol", "ts", "t.*")


def last_bar(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "timeframe").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_bars"))


def storage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("timeframe", "source").agg(F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series."""
    w = Window.partitionBy("symbol", "timeframe").orderBy(F.col("ts").desc())
    return bars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
