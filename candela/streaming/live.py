"""Structured Streaming: candles from a tick stream, and open trades that resolve as bars arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.labels import LOOKAHEAD
from ..sources import market, scratch

LATE = "6 hours"


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks of market.ticks as a stream over the event files of a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return market.ticks_of(e)


def resample_stream(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Candles in update mode; bars older than the latest tick by LATE are closed and their state is dropped."""
    return market.resample(ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE), timeframe)


def upsert_sink(stream: DataFrame, path: str, checkpoint: str):
    """Appends every micro-batch with its number to a table; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/part={n}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every row that upsert_sink wrote."""
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return spark.read.parquet(path).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "batch", "part")


def streaming_resample(spark: SparkSession, sf_dir: str, timeframe: str = "15min") -> DataFrame:
    at = scratch.path(spark, "stream")
    upsert_sink(resample_stream(tick_stream(spark, sf_dir), timeframe), f"{at}/out", f"{at}/check").awaitTermination()
    return latest(spark, f"{at}/out", ["symbol", "timeframe", "ts"])


EVENT = "symbol string, timeframe string, ts timestamp_ntz, kind string, signal_id string, direction int, entry double, stop double, target double, high double, low double"
_RESOLVED = "symbol string, timeframe string, signal_id string, status string, bars_to_resolve int, resolved_at timestamp_ntz"
_STATE = "trades array<struct<signal_id: string, direction: int, stop: double, target: double, seen: int>>"


def resolve_open(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Trades of one series: each bar from the entry on is looked at once; both levels in a bar is a loss; after LOOKAHEAD bars a trade has expired."""
    opened = [list(t) for t in state.get[0]] if state.exists else []
    rows = pd.concat(list(batches)).sort_values(["ts", "kind"], ascending=[True, False], kind="stable")  # plans before the bar of their time
    done = []
    for r in rows.itertuples(index=False):
        if r.kind == "plan":
            opened.append([r.signal_id, int(r.direction), float(r.stop), float(r.target), 0])
            continue
        left = []
        for t in opened:
            sid, side, stop, target, seen = t
            lost = r.low <= stop if side > 0 else r.high >= stop
            won = r.high >= target if side > 0 else r.low <= target
            status = "loss" if lost else "win" if won else "expired" if seen + 1 >= LOOKAHEAD else None
            if status:
                done.append((*key, sid, status, seen, r.ts))
            else:
                left.append([sid, side, stop, target, seen + 1])
        opened = left
    state.update(([tuple(t) for t in opened],))
    yield pd.DataFrame(done, columns=["symbol", "timeframe", "signal_id", "status", "bars_to_resolve", "resolved_at"])


def journal_stream(events: DataFrame) -> DataFrame:
    """Resolutions of a stream of plans and bars (EVENT), which arrive in the order of time within a series."""
    return events.groupBy("symbol", "timeframe").applyInPandasWithState(resolve_open, _RESOLVED, _STATE, "append", GroupStateTimeout.NoTimeout)


def events_of(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Bars, and a plan at the entry bar of every label, as EVENT rows."""
    none = lambda t: F.lit(None).cast(t)
    b = bars.select("symbol", "timeframe", "ts", F.lit("bar").alias("kind"), none("string").alias("signal_id"), none("int").alias("direction"), *[none("double").alias(c) for c in ("entry", "stop", "target")], "high", "low")
    w = Window.partitionBy("symbol", "timeframe").orderBy("ts")
    at = bars.select("symbol", "timeframe", F.col("ts").alias("entry_ts"), (F.row_number().over(w) - 2).alias("bar_idx"))
    plans = labels.join(at, ["symbol", "timeframe", "bar_idx"]).select("symbol", "timeframe", F.col("entry_ts").alias("ts"), F.lit("plan").alias("kind"), F.concat_ws("/", F.col("bar_idx").cast("string"), F.col("direction").cast("string")).alias("signal_id"), F.col("direction").cast("int").alias("direction"), "entry", "stop", "target", none("double").alias("high"), none("double").alias("low"))
    return b.unionByName(plans)


def streaming_journal(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Writes the events as files, streams them and gives the resolutions."""
    spark = bars.sparkSession
    at = scratch.path(spark, "journal")
    events_of(bars, labels).coalesce(1).write.parquet(f"{at}/in")
    out = journal_stream(spark.readStream.schema(EVENT).parquet(f"{at}/in"))
    out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/check").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_RESOLVED).parquet(f"{at}/out")
