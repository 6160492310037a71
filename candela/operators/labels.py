"""Trade labels: for every bar, direction and reward ratio, the first hit of stop or target after the next open.

The outcome depends on the bar alone, not on a pattern, so the label table is made once and joined to what fired. The
60 bars ahead are a window frame, so there is no join and nothing is looked at twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import W, resolve, sql

LOOKAHEAD, STOP_ATR, RR, SPREAD = 60, 1.5, 4.0, 0.30


def trade_labels(bars: DataFrame, ratios: tuple[float, ...] = (RR,), spread: float = SPREAD) -> DataFrame:
    """One row per bar, direction (1, -1) and ratio with a next open and a positive risk: entry, stop, target, outcome, bars_to_resolve, net_r.

    A bar that touches both levels is a loss. The spread's cost is in units of risk.
    """
    df = resolve(bars, ["bar_idx", "atr"]).withColumns({
        "entry": F.expr(f"lead(open) OVER ({W})"),
        "ahead": F.expr(f"collect_list(struct(bar_idx, high, low)) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {LOOKAHEAD} FOLLOWING)"),
    }).withColumn("risk", F.col("atr") * STOP_ATR)
    sides = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(float(r)).alias("rr")) for d in (1, -1) for r in ratios])
    df = df.where("entry is not null and risk > 0").withColumn("side", F.explode(sides)).select("*", "side.direction", "side.rr")
    df = df.withColumn("stop", F.expr("entry - direction * risk")).withColumn("target", F.expr("entry + direction * rr * risk"))
    hit = "get(filter(ahead, x -> if(direction > 0, x.low <= stop or x.high >= target, x.high >= stop or x.low <= target)), 0)"
    df = df.withColumn("hit", F.expr(hit))
    df = df.withColumn("outcome", F.expr("case when hit is null then 'unresolved' when if(direction > 0, hit.low <= stop, hit.high >= stop) then 'loss' else 'win' end"))
    net = F.expr(f"case outcome when 'win' then rr when 'loss' then -1.0D end - {spread}D / risk")
    return df.select("symbol", "timeframe", "ts", "bar_idx", "direction", "rr", "entry", "stop", "target", "risk", "outcome", F.expr("hit.bar_idx - bar_idx - 1").cast("bigint").alias("bars_to_resolve"), net.alias("net_r"))


def labels_sql(base: str, ratios: tuple[float, ...] = (RR,), spread: float = SPREAD) -> str:
    """The same by a range join."""
    sides = ", ".join(f"({d}, {float(r)}::DOUBLE)" for d in (1, -1) for r in ratios)
    return f"""
WITH b AS ({sql(base, ["bar_idx", "atr"], ("symbol", "timeframe", "ts", "open", "high", "low"))}),
t AS (SELECT b.symbol, b.timeframe, b.ts, b.bar_idx, direction, rr, n.open AS entry, n.open - direction * 1.5 * b.atr AS stop, n.open + direction * rr * 1.5 * b.atr AS target, b.atr * 1.5 AS risk
      FROM b JOIN b n ON n.symbol = b.symbol AND n.timeframe = b.timeframe AND n.bar_idx = b.bar_idx + 1 CROSS JOIN (VALUES {sides}) s(direction, rr) WHERE b.atr > 0),
h AS (SELECT t.symbol, t.timeframe, t.bar_idx, t.direction, t.rr, f.bar_idx - t.bar_idx - 1 AS k,
      CASE WHEN (t.direction > 0 AND f.low <= t.stop) OR (t.direction < 0 AND f.high >= t.stop) THEN 'loss' ELSE 'win' END AS outcome
      FROM t JOIN b f ON f.symbol = t.symbol AND f.timeframe = t.timeframe AND f.bar_idx > t.bar_idx AND f.bar_idx <= t.bar_idx + {LOOKAHEAD}
      WHERE (t.direction > 0 AND (f.low <= t.stop OR f.high >= t.target)) OR (t.direction < 0 AND (f.high >= t.stop OR f.low <= t.target))),
r AS (SELECT symbol, timeframe, bar_idx, direction, rr, min(k) AS bars_to_resolve, arg_min(outcome, k) AS outcome FROM h GROUP BY ALL)
SELECT t.symbol, t.timeframe, t.ts, t.bar_idx, t.direction, t.rr, t.entry, t.stop, t.target, t.risk, coalesce(r.outcome, 'unresolved') AS outcome, r.bars_to_resolve,
       CASE r.outcome WHEN 'win' THEN t.rr WHEN 'loss' THEN -1.0 END - {spread} / t.risk AS net_r
FROM t LEFT JOIN r USING (symbol, timeframe, bar_idx, direction, rr)
"""
