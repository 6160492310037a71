"""Queries of streaming and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators.labels import labels_sql, trade_labels
from ..sources import market, scratch
from ..streaming import live
from . import learning as L
from .common import rounded, rounded_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
_PRICES = ["open", "high", "low", "close", "volume", "ask_volume", "bid_volume"]
QUERIES["streaming_resample"] = lambda s, d: rounded(live.streaming_resample(s, d), 4)
SQL["streaming_resample"] = rounded_sql(market.resample_sql("15min"), _PRICES, 4)


def streaming_journal(spark, d) -> DataFrame:
    b = market.daily_candles(spark, d)
    return live.streaming_journal(b, trade_labels(b)).drop("resolved_at")


QUERIES["streaming_journal"] = streaming_journal
SQL["streaming_journal"] = f"""
SELECT symbol, timeframe, bar_idx || '/' || direction AS signal_id, CASE outcome WHEN 'unresolved' THEN 'expired' ELSE outcome END AS status, coalesce(bars_to_resolve, 59)::INT AS bars_to_resolve
FROM ({labels_sql(market.DAILY_SQL)}) l JOIN (SELECT count(*) AS n FROM ({market.DAILY_SQL}) b) ON outcome <> 'unresolved' OR bar_idx + 60 < n
"""
NAMES = ["f_body_ratio", "f_rsi_14", "f_return_5_atr_norm", "f_donchian_position", "f_volatility_ratio", "f_dist_sma_20_atr_norm", "f_range_vs_atr", "f_volume_ratio"]
RR = 1.25


def training_data(spark, d) -> tuple[DataFrame, int]:
    b = market.daily_candles(spark, d)
    data = scratch.written(L.dataset(X.features(b, NAMES), trade_labels(b, (RR,)), 1), "training")
    return data, b.count()


def purged_cv_gbt(spark, d) -> DataFrame:
    """No rows where no fold could be trained."""
    data, n = training_data(spark, d)
    folds = L.out_of_fold(data, n, NAMES, L.Tree(2, 5), 3)
    return rounded(L.validation_rows(data).where("false") if folds is None else folds)


def distilled_rules(spark, d) -> DataFrame:
    """No rows where no model could be trained: without resolved trades, or with one outcome only there is nothing to tell apart."""
    data, _ = training_data(spark, d)
    known = L.usable(data, NAMES)
    model = L.fit(data, known, L.Tree(2, 5)) if known else None
    text, agree = L.distilled(model, data, known) if model else ("", 0.0)
    return spark.createDataFrame([(i, line, float(agree)) for i, line in enumerate(text.splitlines())], "line int, rule string, fidelity double")


QUERIES["purged_cv_gbt"] = purged_cv_gbt
QUERIES["distilled_rules"] = distilled_rules
QUERIES["label_balance"] = lambda s, d: L.dataset(X.features(market.daily_candles(s, d), NAMES[:1]), trade_labels(market.daily_candles(s, d), (RR,)), 1).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("wins"))
SQL["label_balance"] = f"SELECT outcome, count(*) AS n, sum((outcome = 'win')::INT)::DOUBLE AS wins FROM ({labels_sql(market.DAILY_SQL, (RR,))}) l WHERE direction = 1 AND outcome <> 'unresolved' GROUP BY 1"
