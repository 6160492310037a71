"""Discovery: beam search over conjunctions of primitives, synthesised conditions and features, autopsies of what wins.

Searches are loops on the driver over a few depths or generations. Each is one batched job over all series and trials; between them
the occurrences are written to the shared folder, so plans stay short and nothing is collected but names and scores of survivors.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.registry import W, define, resolve, rolling
from ..operators.primitives import PRIMITIVES, column
from ..sources import scratch
from ..sources.market import TIMEFRAMES
from . import mining as M

SERIES = ["symbol", "timeframe"]


def primitive_dim(spark: SparkSession, names: Iterable[str] | None = None) -> DataFrame:
    names = list(PRIMITIVES) if names is None else list(names)
    return spark.createDataFrame([(n, *PRIMITIVES[n]) for n in names], "primitive string, family string, hint int")


def fired_primitives(bars: DataFrame, names: list[str], synthesized: list[str] | None = None) -> DataFrame:
    """Primitives that hold, in long form: symbol, timeframe, bar_idx, primitive. synthesized: names of defined conditions."""
    of = {n: column(n) for n in names} | {n: n for n in synthesized or []}
    df = resolve(bars, ["bar_idx", *of.values()])
    flags = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in of.items()]))
    return df.select(*M.KEY, F.explode(flags).alias("primitive"))


def _scored(occurred: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    t = occurred.join(labels, [*M.KEY, "direction"])
    return M.era_scores(t, sizes=sizes, wins=True).select(*M.GROUP, "worst_era_score", "resolved", "wins")


def beam_search(flags: DataFrame, dim: DataFrame, labels: DataFrame, sizes: DataFrame, **settings) -> DataFrame:
    """The conjunctions that searched finds: symbol, timeframe, pattern (names joined by &), direction, worst_era_score, resolved, depth."""
    return searched(flags, dim, labels, sizes, **settings).found.drop("wins")


@dataclass(frozen=True)
class Search:
    """found: the survivors of two primitives or more. tested: symbol, timeframe, n_tested, every set that was tried, whether it fired, passed or not.
    occurred: where each set that was tried and fired holds, of all depths (KEY, direction, pattern, depth)."""

    found: DataFrame
    tested: DataFrame
    occurred: DataFrame


def searched(flags: DataFrame, dim: DataFrame, labels: DataFrame, sizes: DataFrame, width: int = 5, depth: int = 4, least: float = 0.45, better: float = 0.01, seeds: DataFrame | None = None) -> Search:
    """Beam search for conjunctions of two primitives or more, all series at once.

    In each series the best ``width`` of a depth are extended by a primitive of a new family whose hint doesn't contradict; an extension stays if its worst era is
    ``better`` than its parent's. A set of names counts once; ties go by name. seeds: a part of dim; only its primitives may start a set.
    Every depth is written to the shared folder. Empty tables give no row.
    """
    spark = flags.sparkSession
    series = sizes.select(*SERIES)
    starts = dim if seeds is None else seeds
    trials = starts.agg(F.coalesce(F.sum(F.when(F.col("hint") == 0, 2).otherwise(1)), F.lit(0)).cast("bigint")).first()[0]
    tested = series.withColumn("n", F.lit(trials))
    everywhere = None
    sides = F.when(F.col("hint") == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.col("hint")))
    sided = flags.join(F.broadcast(starts), "primitive").withColumn("direction", F.explode(sides))
    occurred = scratch.written(sided.select(*M.KEY, "direction", F.array("primitive").alias("names"), F.array("family").alias("families"), F.lit(None).cast("double").alias("bar")), "beam")
    best = Window.partitionBy(*SERIES).orderBy(F.desc("worst_era_score"), "pattern", "direction")
    found = None
    for level in range(1, depth + 1):
        named = occurred.withColumn("pattern", F.concat_ws("&", "names"))
        here = named.select(*M.KEY, "direction", "pattern", F.lit(level).alias("depth"))
        everywhere = here if everywhere is None else everywhere.unionByName(here)
        bars_needed = named.groupBy(*M.GROUP).agg(F.min("bar").alias("bar"))
        score = _scored(named.select(*M.KEY, "pattern", "direction"), labels, sizes).join(bars_needed, M.GROUP)
        passing = score.where(F.col("worst_era_score") >= F.coalesce(F.col("bar"), F.lit(least)))
        beam = scratch.written(passing.withColumn("k", F.row_number().over(best)).where(F.col("k") <= width).select(*M.GROUP, "worst_era_score", "resolved", "wins", F.lit(level).alias("depth")), "beam")
        if level > 1:
            found = beam if found is None else found.unionByName(beam)
        if level == depth:
            break
        # every compatible extension of a parent is a trial, also one that never fires; at most width parents a series
        families = named.select(*M.GROUP, "names", "families").distinct()
        tried = beam.select(*M.GROUP).join(families, M.GROUP).join(F.broadcast(dim), F.expr("not array_contains(families, family) and (hint = 0 or hint = direction)"))
        tested = tested.unionByName(tried.select(*SERIES, "direction", F.array_sort(F.array_append("names", F.col("primitive"))).alias("names")).distinct().groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")))
        parents = named.join(beam.select(*M.GROUP, "worst_era_score"), M.GROUP)
        more = parents.join(flags, M.KEY).join(F.broadcast(dim), "primitive").where("not array_contains(families, family) and (hint = 0 or hint = direction)")
        grown = more.select(*M.KEY, "direction", F.array_sort(F.array_append("names", F.col("primitive"))).alias("names"), F.array_sort(F.array_append("families", F.col("family"))).alias("families"), (F.col("worst_era_score") + better).alias("bar"))
        occurred = scratch.written(grown.groupBy(*M.KEY, "direction", "names", "families").agg(F.min("bar").alias("bar")), "beam")
    if found is None:
        found = spark.createDataFrame([], beam.schema)
    tested = scratch.written(tested.groupBy(*SERIES).agg(F.sum("n").alias("n_tested")), "tested")
    return Search(found, tested, everywhere)


NEXT = dict(zip(TIMEFRAMES, list(TIMEFRAMES)[1:]))


def holds(patterns: DataFrame, flags: DataFrame) -> DataFrame:
    """Where all primitives of each pattern hold: the columns of patterns and bar_idx. patterns: symbol, timeframe, pattern (names joined by &), direction, one row each."""
    names = F.array_distinct(F.split("pattern", "&"))
    wanted = patterns.select(*M.GROUP, F.size(names).alias("k"), F.explode(names).alias("primitive"))
    hit = wanted.join(flags, [*SERIES, "primitive"]).groupBy(*M.GROUP, "k", "bar_idx").agg(F.count(F.lit(1)).alias("n")).where("n = k")
    return hit.select(*M.GROUP, "bar_idx")


def discover(flags: DataFrame, dim: DataFrame, labels: DataFrame, sizes: DataFrame, n_synthesis: int = 0, alpha: float = 0.05, coarse: tuple[int, int] = (20, 10), **settings) -> DataFrame:
    """The whole search, its false-discovery control and its confirmation: one row for each conjunction found, with what became of it.

    1. Beam search over the first three quarters of each series. 2. Exact binomial p-values of the survivors against the least win rate that qualifies, accepted by step-up
    control over all trials of the series: those of the search and n_synthesis, the conditions tried before it. 3. The last quarter must qualify by itself. 4. So must the whole history, by the gates of any pattern.
    5. The same primitives on the next coarser candles of the symbol: coarse_* are null where that series isn't there, and no condition.

    Columns: symbol, timeframe, pattern, direction, name, depth, worst_era_score, resolved, wins, n_tested, p_value, rank, threshold, accepted, confirm_*, full_*, coarse_*, discovered (accepted, confirmed and qualified).
    Empty tables give no row.
    """
    s = searched(flags, dim, labels, sizes, **settings)
    found = s.found.join(s.tested, SERIES).withColumn("n_tested", F.col("n_tested") + F.lit(n_synthesis))
    found = found.withColumn("p_value", stats.binomial_p(F.col("wins"), F.col("resolved"), M.MIN_WIN_RATE)).withColumn("name", pattern_name(F.split("pattern", "&"), F.col("direction")))
    found = scratch.written(stats.bh_accept(found, name="pattern", alpha=alpha, n_tested=F.col("n_tested"), by=tuple(SERIES)), "found")
    t = scratch.written(holds(found, flags).join(labels, [*M.KEY, "direction"]), "found-trades")
    measures = ["resolved", "win_rate", "oos_resolved", "oos_win_rate", "qualifies"]

    def part(g: DataFrame, prefix: str) -> DataFrame:
        return g.select(*M.GROUP, *[F.col(m).alias(f"{prefix}_{m}") for m in measures])

    def gated(df: DataFrame, gates: tuple[int, int]) -> DataFrame:
        return df.withColumn("min_resolved", F.lit(gates[0])).withColumn("min_oos", F.lit(gates[1]))

    confirmed, full = part(confirmation(gated(t, (0, 0)), sizes), "confirm"), part(M.graded(gated(t, M.GATES)), "full")
    following = F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair])
    above = found.withColumn("fine", F.col("timeframe")).withColumn("timeframe", following[F.col("timeframe")]).where("timeframe is not null").select(*M.GROUP, "fine").join(sizes.select(*SERIES), SERIES)
    upper = holds(above.select(*M.GROUP).distinct(), flags).join(labels, [*M.KEY, "direction"])
    checked = above.join(part(M.graded(gated(upper, coarse)), "coarse"), M.GROUP, "left").withColumn("coarse_resolved", F.coalesce("coarse_resolved", F.lit(0))).withColumn("coarse_qualifies", F.coalesce("coarse_qualifies", F.lit(False)))
    checked = checked.withColumnRenamed("timeframe", "coarse_timeframe").withColumnRenamed("fine", "timeframe")
    out = found.join(confirmed, M.GROUP, "left").join(full, M.GROUP, "left").join(checked, M.GROUP, "left")
    return out.withColumn("discovered", F.expr("accepted and coalesce(confirm_qualifies, false) and coalesce(full_qualifies, false)"))


def active_on_last_bar(patterns: DataFrame, flags: DataFrame, sizes: DataFrame) -> DataFrame:
    """Those patterns (see holds) whose primitives all hold on the last bar of their series. flags may be of a tail of the bars, sizes of the same."""
    return holds(patterns, flags).join(sizes, SERIES).where("bar_idx = n_bars - 1").select(*M.GROUP)


def explored(s: Search, labels: DataFrame, least: int = 30) -> DataFrame:
    """Every set of two primitives or more that a search tried, at each reward ratio of labels (rr; leave out trades with news before): the ratio of the best net expectancy among those with ``least`` resolved trades.

    Columns: symbol, timeframe, pattern, direction, best_rr, best_net_r, tiers. Sets without such a ratio have no row.
    """
    return M.reward_grid(s.occurred.where("depth > 1").drop("depth").join(labels, [*M.KEY, "direction"]), least)


def merge_explored(batches: list[DataFrame]) -> DataFrame:
    """Batches of explored sets (searches with different seeds) as one: a set that several have counts once, with its best net expectancy; ties go to the lower ratio."""
    both = batches[0]
    for b in batches[1:]:
        both = both.unionByName(b)
    best = F.max(F.struct("best_net_r", (-F.col("best_rr")).alias("r"), "tiers"))
    return both.groupBy(*M.GROUP).agg(best.alias("b")).select(*M.GROUP, (-F.col("b.r")).alias("best_rr"), "b.best_net_r", "b.tiers")


def pattern_name(names: Column, direction: Column) -> Column:
    """A stable name of a set of primitives."""
    return F.concat(F.lit("discovered__"), F.substring(F.sha1(F.concat_ws("|", F.array_sort(names), direction.cast("string"))), 1, 10))


def confirmation(t: DataFrame, sizes: DataFrame, share: float = 0.75, least: tuple[int, int] = (20, 10)) -> DataFrame:
    """Statistics of what lies after the discovery part of each series."""
    t = t.join(sizes, SERIES).where(F.col("bar_idx") >= F.floor(F.col("n_bars") * share))
    return M.graded(t.drop("n_bars", "min_resolved", "min_oos").withColumns({"min_resolved": F.lit(least[0]), "min_oos": F.lit(least[1])}))


# synthesised conditions


@dataclass(frozen=True)
class Expression:
    """base -> transform over window -> compared with its own quantile of the 200 bars before."""

    base: str
    transform: str
    window: int
    above: bool
    share: float

    @property
    def name(self) -> str:
        return f"synth_{self.base}_{self.transform}{self.window}_{'gt' if self.above else 'lt'}{int(self.share * 100)}"

    @property
    def family(self) -> str:
        return f"synthesized_{self.transform}"

    def defined(self) -> str:
        """Defines the columns and gives the flag's name."""
        x, n = f"base_{self.base}", self.window
        define(x, _BASES[self.base])
        v = f"{x}_{self.transform}{n}"
        define(v, _TRANSFORMS[self.transform](x, n))
        q = self.share if self.above else round(1 - self.share, 2)
        frame = f"({W} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"
        define(f"{v}_q{int(q * 100)}", f"CASE WHEN count({v}) OVER {frame} >= 30 THEN QUANTILE({v}, {q}) OVER {frame} END")
        return define(self.name, f"coalesce({v} {'>' if self.above else '<'} {v}_q{int(q * 100)}, false)")


def _pct_rank(x: str, n: int) -> str:
    listed = define(f"{x}_before_{n}", f"CASE WHEN count({x}) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN LIST({x}) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END")
    return f"CAST(COUNT_BELOW({listed}, {x}) AS DOUBLE) / {n}"


def _slope(x: str, n: int) -> str:
    f = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN regr_slope({x}, bar_idx) OVER {f} END"


_BASES = {"close": "close * 1", "hl2": "(high + low) / 2", "returns": "return_1 * 1", "rangepct": "(high - low) / nullif(close, 0)"}
_TRANSFORMS = {
    "raw": lambda x, n: f"{x} * 1",
    "mean": lambda x, n: rolling("avg", x, n),
    "std": lambda x, n: rolling("stddev_samp", x, n),
    "slope": _slope,
    "pctrank": _pct_rank,
    "zscore": lambda x, n: f"({x} - {rolling('avg', x, n)}) / nullif({rolling('stddev_samp', x, n)}, 0)",
}
_CHOICES = {"base": list(_BASES), "transform": list(_TRANSFORMS), "window": [5, 10, 20, 50], "above": [True, False], "share": [0.6, 0.7, 0.8, 0.9]}


def _canonical(e: Expression) -> Expression:
    return replace(e, window=5) if e.transform == "raw" else e


def _drawn(rng: random.Random) -> Expression:
    return _canonical(Expression(**{k: rng.choice(v) for k, v in _CHOICES.items()}))


def _mutant(e: Expression, rng: random.Random) -> Expression:
    k = rng.choice(list(_CHOICES))
    return _canonical(replace(e, **{k: rng.choice(_CHOICES[k])}))


def synthesize(bars: DataFrame, labels: DataFrame, sizes: DataFrame, seed: int = 0, size: int = 60, generations: int = 3, survivors: int = 12, least: float = 0.45, most: int = 15) -> tuple[list[tuple[Expression, int, float]], int]:
    """Conditions found by mutation and selection, best first, as (expression, direction, worst era score over all series), and how many were tried.

    Both directions of a condition count as trials. A generation is one job; its scores, at most 2 * size rows, come to the driver.
    """
    rng, tried, best = random.Random(seed), 0, {}
    population = [_drawn(rng) for _ in range(size)]
    for _ in range(generations):
        fresh = {e.name: e for e in population if e.name not in best}
        tried += 2 * len(fresh)
        if fresh:
            names = [e.defined() for e in fresh.values()]
            flags = resolve(bars, ["bar_idx", *names]).select(*M.KEY, F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("pattern"))
            scores = M.era_scores(flags.join(labels, M.KEY), sizes=sizes).groupBy("pattern", "direction").agg(F.min("worst_era_score").alias("score"))
            for e in fresh.values():
                best[e.name] = (e, 1, 0.0)
            for r in scores.collect():
                if r.score > best[r.pattern][2]:
                    best[r.pattern] = (fresh[r.pattern], r.direction, r.score)
        top = sorted((best[n] for n in fresh), key=lambda t: (-t[2], t[0].name))[:survivors]
        if not top:
            break
        population = [_mutant(e, rng) for e, _, _ in top for _ in range(max(1, size // (2 * len(top))))] + [_drawn(rng) for _ in range(size // 4)]
    out = sorted((t for t in best.values() if t[2] >= least), key=lambda t: (-t[2], t[0].name))
    return out[:most], tried


# autopsies


def long_features(features: DataFrame, names: list[str]) -> DataFrame:
    """One row per bar and known feature: KEY, feature, value."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])
    return features.select(*M.KEY, F.explode(pairs).alias("p")).select(*M.KEY, "p.*").where("value is not null")


def mann_whitney(trades: DataFrame, long: DataFrame, least: int = 15) -> DataFrame:
    """For each pattern, direction and feature: sizes and medians of the won and lost trades, U and its tie-corrected normal score (z).

    Groups with fewer than ``least`` of either, or of one value only, are left out.
    """
    keys = ["pattern", "direction", "feature"]
    t = trades.where("outcome <> 'unresolved'").select(*M.KEY, "pattern", "direction", (F.col("outcome") == "win").alias("won")).join(long, M.KEY)
    # equal values are one row with counts from here on, so ranks need no window over all rows of a tie
    v = t.groupBy(*keys, "value").agg(F.count_if("won").alias("w"), F.count_if(~F.col("won")).alias("l")).withColumn("t", F.col("w") + F.col("l"))
    middles = lambda c: F.percentile("value", F.lit(0.5), F.col(c))
    below = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("rank", F.coalesce(F.sum("t").over(below), F.lit(0)) + (F.col("t") + 1) / 2)
    g = v.groupBy(*keys).agg(F.sum("w").alias("win_n"), F.sum("l").alias("loss_n"), F.sum(F.col("rank") * F.col("w")).alias("rank_sum"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties"), middles("w").alias("win_median"), middles("l").alias("loss_median"))
    g = g.where(f"win_n >= {least} and loss_n >= {least}").withColumn("n", F.col("win_n") + F.col("loss_n"))
    g = g.withColumn("u", F.expr("rank_sum - win_n * (win_n + 1) / 2")).withColumn("deviation", F.expr("sqrt(cast(win_n as double) * loss_n / 12 * (n + 1 - ties / (cast(n as double) * (n - 1))))"))
    middle = F.expr("cast(win_n as double) * loss_n / 2")
    z = F.expr("greatest(abs(u - cast(win_n as double) * loss_n / 2) - 0.5D, 0) / nullif(deviation, 0)")
    return g.withColumn("z", z * F.signum(F.col("u") - middle)).where("z is not null").select(*keys, "win_n", "loss_n", "win_median", "loss_median", "u", "z")


def autopsy(trades: DataFrame, long: DataFrame, alpha: float = 0.05, top: int = 10) -> DataFrame:
    """The significant features of each pattern and direction after false-discovery control, most significant first, ``top`` at most."""
    f = mann_whitney(trades, long).withColumn("p_value", stats.normal_p(F.col("z")))
    return stats.bh_accept(f, name="feature", alpha=alpha, by=("pattern", "direction")).where(F.col("accepted") & (F.col("rank") <= top))


def spearman_by_era(long: DataFrame, labels: DataFrame, sizes: DataFrame, eras: int = 4, least: int = 20) -> DataFrame:
    """Per series, direction and feature: the least absolute rank correlation with winning over the eras of the discovery part; 0 for short or constant eras."""
    keys = [*SERIES, "direction", "feature", "era"]
    t = labels.where("outcome <> 'unresolved'").select(*M.KEY, "direction", (F.col("outcome") == "win").cast("double").alias("y")).join(long, M.KEY).join(sizes, SERIES)
    t = t.withColumn("end", F.floor(F.col("n_bars") * 0.75)).where("bar_idx < end").withColumn("era", F.least(F.lit(eras - 1), F.floor(F.col("bar_idx") * eras / F.col("end"))).cast("int"))

    def averaged(x: str) -> Column:
        own = Window.partitionBy(*keys)
        return F.rank().over(own.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2

    r = t.withColumn("rx", averaged("value")).withColumn("ry", averaged("y")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.covar_pop("rx", "ry").alias("c"))
    rho = F.when((F.col("n") < least) | (F.col("sx") < 1e-9) | (F.col("sy") < 1e-9), 0.0).otherwise(F.abs(F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))))
    return r.withColumn("rho", F.coalesce(rho, F.lit(0.0))).groupBy(*SERIES, "direction", "feature").agg(F.when(F.count(F.lit(1)) < eras, 0.0).otherwise(F.min("rho")).alias("worst_rho"))


# synthesised features

BINARY = {"add": "{a} + {b}", "sub": "{a} - {b}", "mul": "{a} * {b}", "safe_div": "{a} / nullif({b}, 0)", "max": "greatest({a}, {b})", "min": "least({a}, {b})"}
UNARY = {"none": "{x}", "abs": "abs({x})", "neg": "-({x})"}


@dataclass(frozen=True)
class Feature:
    """binary(a, b) under a unary; commutative operators hold their leaves in order."""

    a: str
    b: str
    binary: str
    unary: str = "none"

    def __post_init__(self) -> None:
        if self.binary not in ("sub", "safe_div") and self.b < self.a:
            a, b = self.b, self.a
            object.__setattr__(self, "a", a)
            object.__setattr__(self, "b", b)

    @property
    def name(self) -> str:
        return f"s_{self.unary}_{self.binary}_{self.a}_{self.b}"

    @property
    def degenerate(self) -> bool:
        return self.a == self.b and self.binary != "mul"

    def column(self, known: Iterable[str]) -> Column:
        """Null where a leaf isn't among the known columns."""
        if self.a not in known or self.b not in known:
            return F.lit(None).cast("double").alias(self.name)
        return F.expr(UNARY[self.unary].format(x="(" + BINARY[self.binary].format(a=f"`{self.a}`", b=f"`{self.b}`") + ")")).alias(self.name)


def synthesize_features(features: DataFrame, names: list[str], labels: DataFrame, sizes: DataFrame, seed: int = 0, size: int = 60, generations: int = 3, survivors: int = 12) -> list[tuple[Feature, float]]:
    """Features by mutation and selection on the mean of the series' worst-era rank correlations, best first; one job a generation."""
    rng, best = random.Random(seed), {}

    def draw() -> Feature:
        return Feature(rng.choice(names), rng.choice(names), rng.choice(list(BINARY)), rng.choice(list(UNARY)))

    population = [draw() for _ in range(size)]
    for _ in range(generations):
        fresh = {f.name: f for f in population if f.name not in best and not f.degenerate}
        if not fresh:
            break
        wide = features.select(*M.KEY, *[f.column(names) for f in fresh.values()])
        scores = spearman_by_era(long_features(wide, list(fresh)), labels, sizes).groupBy("feature").agg(F.avg("worst_rho").alias("s"))
        for r in scores.collect():  # at most ``size`` rows
            best[r.feature] = (fresh[r.feature], r.s)
        top = sorted((best[n] for n in fresh if n in best), key=lambda t: (-t[1], t[0].name))[:survivors]
        population = [replace(f, **{k: rng.choice(names if k in "ab" else list(BINARY if k == "binary" else UNARY))}) for f, _ in top for k in ("a", "b", "binary", "unary")] + [draw() for _ in range(size // 4)]
    return sorted(best.values(), key=lambda t: (-t[1], t[0].name))
