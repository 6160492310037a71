"""What queries share: the bars that they run over, and equal rounding on both sides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import market

FINE = ("15min", "1h")
#: The size at which SQL checks a query, and all sizes, at which its whole form (named *_all, without SQL) runs.
HOURLY, ALL = ("1h",), tuple(market.TIMEFRAMES)


def bars(spark: SparkSession, sf_dir: str, timeframes: tuple[str, ...] = ("1h",)) -> DataFrame:
    """Candles of all symbols at the given sizes, and the daily series of shipped lines."""
    return market.candles(spark, sf_dir, timeframes).unionByName(market.daily_candles(spark, sf_dir))


def bars_sql(timeframes: tuple[str, ...] = ("1h",)) -> str:
    return f"{market.candles_sql(timeframes)} UNION ALL BY NAME ({market.DAILY_SQL})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places, without negative zeros; dates as times. Means of few values often lie just between two places, so all are moved a little before."""
    kinds = {"double": lambda c: F.round(F.col(c) + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0), "date": lambda c: F.col(c).cast("timestamp_ntz")}
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def rounded_sql(query: str, doubles: Iterable[str], digits: int = 6, dates: Iterable[str] = ()) -> str:
    listed = ", ".join([*[f"round({c}::DOUBLE + {10.0 ** -(digits + 3)!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles], *[f"{c}::TIMESTAMP AS {c}" for c in dates]])
    return f"SELECT * REPLACE ({listed}) FROM ({query}) r0" if listed else query
