"""Statistics over aggregated rows: Wilson bounds, binomial tails, Benjamini-Hochberg, Mann-Whitney."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z = 1.96


def _wilson(wins: Column, n: Column, sign: int) -> Column:
    p, z2 = wins / n, Z * Z
    return (p + z2 / (2 * n) + sign * Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def wilson_lower(wins: Column, n: Column) -> Column:
    """Lower 95 % Wilson bound; 0 without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), _wilson(wins, n, -1)), F.lit(0.0))


def wilson_upper(wins: Column, n: Column) -> Column:
    """Upper bound; 1 without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), _wilson(wins, n, 1)), F.lit(1.0))


def wilson_sql(wins: str, n: str, upper: bool = False) -> str:
    p, m = f"({wins})::DOUBLE / nullif({n}, 0)", f"nullif({n}, 0)::DOUBLE"
    value = f"({p} + {Z * Z} / (2 * {m}) {'+' if upper else '-'} {Z} * sqrt({p} * (1 - {p}) / {m} + {Z * Z} / (4 * {m} * {m}))) / (1 + {Z * Z} / {m})"
    return f"coalesce(least(1.0, {value}), 1.0)" if upper else f"coalesce(greatest(0.0, {value}), 0.0)"


def binomial_tail(wins: int, n: int, p0: float) -> float:
    """P(X >= wins) of n trials; 1 for no trials."""
    if n <= 0 or wins <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p0) + (n - k) * math.log1p(-p0) for k in range(wins, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


@F.pandas_udf(DoubleType())
def _binomial(wins: pd.Series, n: pd.Series, p0: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(p)) for a, b, p in zip(wins, n, p0)])


def binomial_p(wins: Column, n: Column, p0: float = 0.6) -> Column:
    """Exact one-sided p-value; over aggregated rows only."""
    return _binomial(wins, n, F.lit(p0))


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal score; null for null."""
    return _two_sided(z.cast("double"))


def bh_accept(df: DataFrame, p: str = "p_value", name: str = "name", alpha: float = 0.05, n_tested: int | Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Step-up false-discovery control: adds rank, threshold and accepted. n_tested may exceed the rows, and may be a column; ties go by name."""
    w = Window.partitionBy(*by)
    n = n_tested if isinstance(n_tested, Column) else F.lit(n_tested) if n_tested is not None else F.count(F.lit(1)).over(w)
    df = df.withColumn("rank", F.row_number().over(w.orderBy(p, name))).withColumn("threshold", F.col("rank") * F.lit(alpha) / n)
    last = F.max(F.when(F.col(p) <= F.col("threshold"), F.col("rank"))).over(w)
    return df.withColumn("accepted", F.coalesce(F.col("rank") <= last, F.lit(False)))
