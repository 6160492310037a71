"""Mining: fired patterns and pairs of patterns, joined to trade labels and graded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.registry import resolve, sql
from ..operators.bars import BAR_PATTERNS, PATTERNS

FAMILIES = ["candlestick", "indicator", "session", "fundamental", "support_resistance", "smc"]
MIN_WIN_RATE, OOS_SHARE = 0.60, 0.30
#: (resolved trades, resolved out-of-sample trades) that a qualifying pattern has at least.
GATES, COMBO_GATES = (30, 10), (40, 15)
KEY = ["symbol", "timeframe", "bar_idx"]


def pattern_dim(spark: SparkSession) -> DataFrame:
    """pattern, family, family_rank, hint of the 80 atomic patterns."""
    return spark.createDataFrame([(n, f, FAMILIES.index(f), h) for n, (f, h) in PATTERNS.items()], "pattern string, family string, family_rank int, hint int")


def combo_pairs(dim: DataFrame) -> DataFrame:
    """Cross-family pairs whose hints don't contradict: a, b, pattern (combo__a__b), hint."""
    a, b = dim.alias("a"), dim.alias("b")
    return a.join(F.broadcast(b), F.expr("a.family_rank < b.family_rank AND a.hint * b.hint >= 0")).select(
        F.col("a.pattern").alias("a"), F.col("b.pattern").alias("b"), F.concat(F.lit("combo__"), "a.pattern", F.lit("__"), "b.pattern").alias("pattern"), F.expr("if(a.hint <> 0, a.hint, b.hint)").alias("hint")
    )


def dim_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', {FAMILIES.index(f)}, {h})" for n, (f, h) in PATTERNS.items()) + ") d(pattern, family, family_rank, hint)"


def pairs_sql() -> str:
    return f"SELECT a.pattern AS a, b.pattern AS b, 'combo__' || a.pattern || '__' || b.pattern AS pattern, CASE WHEN a.hint <> 0 THEN a.hint ELSE b.hint END AS hint FROM ({dim_sql()}) a JOIN ({dim_sql()}) b ON a.family_rank < b.family_rank AND NOT (a.hint * b.hint < 0)"


def fired(bars: DataFrame, names: list[str] | None = None, macro: list[str] | None = None) -> DataFrame:
    """Fired flags in long form: symbol, timeframe, ts, bar_idx, pattern. macro: flag columns that bars has already."""
    names = names if names is not None else BAR_PATTERNS
    df = resolve(bars, ["bar_idx", *names])
    flags = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in [*names, *(macro or [])]]))
    return df.select("symbol", "timeframe", "ts", "bar_idx", F.explode(flags).alias("pattern"))


def fired_sql(base: str, names: list[str] | None = None) -> str:
    names = names if names is not None else BAR_PATTERNS
    wide = sql(base, ["bar_idx", *names])
    listed = ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in names)
    return f"SELECT symbol, timeframe, ts, bar_idx, pattern FROM (SELECT symbol, timeframe, ts, bar_idx, unnest([{listed}]) AS pattern FROM ({wide}) w) u WHERE pattern IS NOT NULL"


def combo_events(flags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that fired on one bar, from fired rows only: symbol, timeframe, bar_idx, pattern, hint. The pair list is the product of the catalog with itself, so it is small by construction."""
    a, b = flags.select(*KEY, F.col("pattern").alias("a")), flags.select(*KEY, F.col("pattern").alias("b"))
    return a.join(b, KEY).join(F.broadcast(pairs), ["a", "b"]).select(*KEY, "pattern", "hint")


def occurrences(flags: DataFrame, dim: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Fired atomic patterns, and pairs if given, with hint and gates."""
    gates = lambda g: [F.lit(g[0]).alias("min_resolved"), F.lit(g[1]).alias("min_oos")]
    out = flags.join(F.broadcast(dim), "pattern").select(*KEY, "pattern", "hint", *gates(GATES))
    if pairs is not None:
        out = out.unionByName(combo_events(flags, pairs).select("*", *gates(COMBO_GATES)))
    return out


def trades(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Every occurrence with the label of each direction that its hint allows."""
    return events.join(labels, KEY).where("hint = 0 or hint = direction")


def _places(c: Column) -> Column:
    """Six places; moved a little, so that a mean between two places goes the same way in every engine."""
    return F.round(c + F.lit(1e-9), 6)


def summary(prefix: str = "", only: Column | None = None) -> list[Column]:
    """Aggregates of a trade table: samples, resolved, wins, win_rate, ..., over the rows where ``only`` holds."""
    on = F.lit(True) if only is None else only
    done, won = on & (F.col("outcome") != "unresolved"), on & (F.col("outcome") == "win")
    n, wins = F.count_if(done), F.count_if(won)
    rate = wins / F.nullif(n, F.lit(0))
    name = lambda c, x: c.alias(prefix + x)
    return [
        name(F.count_if(on), "samples"), name(n, "resolved"), name(wins, "wins"), name(_places(rate), "win_rate"), name(_places(stats.wilson_lower(wins, n)), "wilson_lower"),
        name(_places(rate * F.max("rr") - (1 - rate)), "expectancy_r"), name(_places(F.avg(F.when(done, F.col("net_r")))), "expectancy_net_r"),
        name(_places(F.avg(F.when(done, F.col("risk")))), "avg_risk"), name(F.percentile(F.when(done, F.col("bars_to_resolve")), F.lit(0.5)), "median_bars"),
    ]


def summary_sql(prefix: str = "", only: str = "true") -> str:
    done, won = f"({only} AND outcome <> 'unresolved')", f"({only} AND outcome = 'win')"
    n, wins = f"count(*) FILTER ({done})", f"count(*) FILTER ({won})"
    rate = f"({wins})::DOUBLE / nullif({n}, 0)"
    return (
        f"count(*) FILTER ({only}) AS {prefix}samples, {n} AS {prefix}resolved, {wins} AS {prefix}wins, round({rate} + 1e-9, 6) AS {prefix}win_rate, round({stats.wilson_sql(wins, n)} + 1e-9, 6) AS {prefix}wilson_lower, "
        f"round({rate} * max(rr) - (1 - {rate}) + 1e-9, 6) AS {prefix}expectancy_r, round(avg(net_r) FILTER ({done}) + 1e-9, 6) AS {prefix}expectancy_net_r, round(avg(risk) FILTER ({done}) + 1e-9, 6) AS {prefix}avg_risk, "
        f"quantile_cont(bars_to_resolve, 0.5) FILTER ({done}) AS {prefix}median_bars"
    )


GROUP = ["symbol", "timeframe", "pattern", "direction"]


def graded(t: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Statistics of each pattern and direction (and extra keys), whole and for the last 30 % of its occurrences, and whether it qualifies in both."""
    keys = [*GROUP, *(extra or [])]
    w = Window.partitionBy(*keys)
    t = t.withColumn("place", F.row_number().over(w.orderBy("bar_idx")) - 1).withColumn("oos", F.col("place") >= F.floor(F.count(F.lit(1)).over(w) * (1 - F.lit(OOS_SHARE))))
    g = t.groupBy(*keys).agg(*summary(), *summary("oos_", F.col("oos")), F.max("min_resolved").alias("min_resolved"), F.max("min_oos").alias("min_oos"))
    q = F.expr(f"resolved >= min_resolved and wins / nullif(resolved, 0) >= {MIN_WIN_RATE}D and oos_resolved >= min_oos and oos_wins / nullif(oos_resolved, 0) >= {MIN_WIN_RATE}D")
    return g.withColumn("qualifies", F.coalesce(q, F.lit(False))).drop("min_resolved", "min_oos")


def graded_sql(trades_sql: str, extra: list[str] | None = None) -> str:
    keys = ", ".join([*GROUP, *(extra or [])])
    return f"""
WITH t0 AS ({trades_sql}),
t AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bar_idx) - 1 >= floor(count(*) OVER (PARTITION BY {keys}) * (1 - {OOS_SHARE}::DOUBLE)) AS oos FROM t0),
g AS (SELECT {keys}, {summary_sql()}, {summary_sql("oos_", "oos")}, max(min_resolved) AS mr, max(min_oos) AS mo FROM t GROUP BY {keys})
SELECT * EXCLUDE (mr, mo), coalesce(resolved >= mr AND wins::DOUBLE / nullif(resolved, 0) >= {MIN_WIN_RATE} AND oos_resolved >= mo AND oos_wins::DOUBLE / nullif(oos_resolved, 0) >= {MIN_WIN_RATE}, false) AS qualifies FROM g
"""


def by_context(t: DataFrame, context: str) -> DataFrame:
    """graded per value of a context column, each value with its own out-of-sample part and gates; unknown values are left out."""
    return graded(t.where(F.col(context).isNotNull()), [context])


def all_grains(t: DataFrame) -> DataFrame:
    """Overall, per news and per regime grains in one pass over the trades."""
    return t.groupingSets([[F.col(c) for c in GROUP], [F.col(c) for c in [*GROUP, "news"]], [F.col(c) for c in [*GROUP, "regime"]]], *[F.col(c) for c in [*GROUP, "news", "regime"]]).agg(F.grouping_id().cast("bigint").alias("grain"), *summary())


def reward_grid(t: DataFrame, least: int = 10) -> DataFrame:
    """For each pattern and direction the reward ratio of the best net expectancy among those with ``least`` resolved trades or more; ties go to the lower ratio."""
    g = t.groupBy(*GROUP, "rr").agg(F.count_if(F.col("outcome") != "unresolved").alias("resolved"), F.round(F.avg("net_r"), 6).alias("net"))
    ok = g.where(F.col("resolved") >= least)
    return ok.groupBy(*GROUP).agg(F.max_by("rr", F.struct("net", -F.col("rr"))).alias("best_rr"), F.max("net").alias("best_net_r"), F.count(F.lit(1)).alias("tiers"))


def era_scores(t: DataFrame, eras: int = 4, least: int = 20, sizes: DataFrame | None = None, wins: bool = False) -> DataFrame:
    """Wilson lower bound per era of the discovery part (first three quarters of the bars), and the worst; an era below ``least`` resolved trades scores 0."""
    if sizes is not None:  # symbol, timeframe, n_bars; else the last bar of any trade ends the series
        t, size = t.join(sizes, ["symbol", "timeframe"]), F.col("n_bars")
    else:
        size = F.max("bar_idx").over(Window.partitionBy("symbol", "timeframe")) + 1
    t = t.withColumn("end", F.floor(size * 0.75)).where("bar_idx < end").withColumn("era", F.least(F.lit(eras - 1), F.floor(F.col("bar_idx") * eras / F.col("end"))).cast("int"))
    done, won = F.count_if(F.col("outcome") != "unresolved"), F.count_if(F.col("outcome") == "win")
    per = t.groupBy(*GROUP, "era").agg(done.alias("resolved"), won.alias("wins")).withColumn("score", F.when(F.col("resolved") < least, 0.0).otherwise(stats.wilson_lower(F.col("wins"), F.col("resolved"))))
    return per.groupBy(*GROUP).agg(F.round(F.when(F.count(F.lit(1)) < eras, 0.0).otherwise(F.min("score")), 6).alias("worst_era_score"), F.count(F.lit(1)).alias("eras"), F.sum("resolved").alias("resolved"), *([F.sum("wins").alias("wins")] if wins else []))


