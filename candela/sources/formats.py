"""Files in and out: tick records, broker CSV, macro JSON; tables, CSV and JSON of results."""

from __future__ import annotations

import lzma
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import upsert

#: Milliseconds of the hour, ask, bid (both in thousandths), volumes; big-endian.
_TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
TICKS = "symbol string, ts timestamp_ntz, ask double, bid double, ask_volume double, bid_volume double, mid double"
_HOUR = re.compile(r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$")


def cache_path(symbol: str, hour: pd.Timestamp) -> str:
    """Where the ticks of an hour lie below a cache folder; months count from one."""
    return f"{symbol}/{hour:%Y/%m/%d/%H}h_ticks.bi5"


def url_path(symbol: str, hour: pd.Timestamp) -> str:
    """The same on the feed's server, where months count from zero."""
    return f"{symbol}/{hour.year}/{hour.month - 1:02d}/{hour:%d/%H}h_ticks.bi5"


def hours(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every hour of [start, end)."""
    span = F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - interval 1 hour, interval 1 hour)")
    return spark.range(1).where(f"timestamp_ntz'{start}' < timestamp_ntz'{end}'").select(F.explode(span).alias("hour"))


def decode_hour(path: str, content: bytes) -> pd.DataFrame:
    """Ticks of one compressed file; an empty one has none. Content that isn't whole records is an error."""
    m = _HOUR.search(path)
    if not m:
        raise ValueError(f"not a tick file: {path}")
    raw = lzma.decompress(content) if content else b""
    if len(raw) % _TICK.itemsize:
        raise ValueError(f"{path}: {len(raw)} bytes are no whole number of records")
    r = np.frombuffer(raw, _TICK)
    ask, bid = r["ask"].astype(float) / 1000, r["bid"].astype(float) / 1000
    start = pd.Timestamp(int(m[2]), int(m[3]), int(m[4]), int(m[5]))
    return pd.DataFrame({"symbol": m[1], "ts": start + pd.to_timedelta(r["ms"].astype(np.int64), "ms"), "ask": ask, "bid": bid, "ask_volume": r["ask_volume"].astype(float), "bid_volume": r["bid_volume"].astype(float), "mid": (ask + bid) / 2})


def read_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks of all cached hours below a folder, a task for a number of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield decode_hour(path, content)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bi5").load(folder)
    return files.select("path", "content").mapInPandas(run, TICKS)


def read_broker_csv(spark: SparkSession, path: str, symbol: str, timeframe: str) -> DataFrame:
    """Candles of one broker export: its first line gives the server's offset from UTC; rows with a bad time or price are dropped."""
    first = spark.read.text(path).where("value like '# gmt_offset_seconds=%'").select(F.split("value", "=")[1].cast("int").alias("offset")).limit(1)
    schema = "timestamp_server string, open string, high string, low string, close string, volume string"
    rows = spark.read.csv(path, header=True, comment="#", schema=schema).crossJoin(F.broadcast(first))  # one row
    at = F.expr("cast(try_to_timestamp(timestamp_server, 'yyyy.MM.dd HH:mm:ss') as timestamp_ntz) - make_dt_interval(0, 0, 0, offset)")
    number = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    none = F.lit(None)
    return rows.select(
        F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), at.alias("ts"), *map(number, ("open", "high", "low", "close", "volume")),
        none.cast("double").alias("ask_volume"), none.cast("double").alias("bid_volume"), none.cast("bigint").alias("tick_count"), F.lit("mt_broker").alias("source"),
    ).dropna(subset=["ts", "open", "high", "low", "close"])


def import_broker(spark: SparkSession, paths: list[str], symbol: str, timeframe: str, existing: DataFrame | None = None) -> DataFrame:
    """Exports, the later path winning on equal times, under existing bars of higher priority."""
    out = None
    for i, p in enumerate(paths):
        c = read_broker_csv(spark, p, symbol, timeframe).withColumn("_n", F.lit(i))
        out = c if out is None else out.unionByName(c)
    if existing is not None:
        out = out.unionByName(existing.withColumn("_n", F.lit(-1)), allowMissingColumns=True)
    return upsert(out, "_n").drop("_n")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """date, value of saved API pages ({"observations": [{"date", "value"}]}); missing values are dropped."""
    pages = spark.read.schema("observations array<struct<date: string, value: string>>").json(path, multiLine=True)
    return pages.select(F.explode("observations").alias("o")).select(F.expr("try_cast(o.date as date)").alias("date"), F.expr("try_cast(o.value as double)").alias("value")).dropna()


def find_releases(releases: DataFrame, keyword: str) -> DataFrame:
    """Rows (id, name) whose name contains the keyword, whatever the case."""
    return releases.where(F.contains(F.lower("name"), F.lit(keyword.lower())))


def write_candles(bars: DataFrame, path: str) -> None:
    """Replaces the partitions (symbol, timeframe) that bars has, whole and at once per partition, and leaves the others."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe").parquet(path)


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_library(stats: DataFrame, path: str) -> None:
    """Pattern statistics as JSON, one folder per timeframe, a row a pattern with its directions nested."""
    body = [c for c in stats.columns if c not in ("symbol", "timeframe", "pattern")]
    nested = stats.groupBy("symbol", "timeframe", "pattern").agg(F.array_sort(F.collect_list(F.struct(*body))).alias("directions"))
    nested.write.mode("overwrite").partitionBy("timeframe").json(path)


def merged_library(base: DataFrame, discovered: DataFrame, keys: list[str]) -> DataFrame:
    """Both libraries; on equal keys the discovered entry wins."""
    return discovered.unionByName(base.join(discovered.select(*keys), keys, "left_anti"), allowMissingColumns=True)
