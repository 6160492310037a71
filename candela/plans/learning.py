"""Learning: purged walk-forward validation of boosted trees, selection, a registry of models, distilled rules.

The trees are pyspark.ml's; missing values are set to the training part's medians. Scores therefore aren't those of other boosting libraries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..sources import scratch
from . import mining as M

LABEL_WINDOW, EMBARGO = 61, 10


@dataclass(frozen=True)
class Tree:
    depth: int = 3
    rounds: int = 10
    step: float = 0.1


CHOICES = (Tree(2, 10), Tree(3, 10), Tree(4, 8))


def purged_splits(n: int, window: int = LABEL_WINDOW, splits: int = 5, embargo: int = EMBARGO) -> Iterator[tuple[int, int, int]]:
    """(train end, validation start, validation end) of each block of bars; training ends before any label could see the block.

    The first n // (splits + 1) bars are for training alone; blocks without training bars are skipped.
    """
    first = n // (splits + 1)
    size = (n - first) // max(1, splits)
    for i in range(splits if size > 0 else 0):
        start, stop = first + i * size, n if i == splits - 1 else first + (i + 1) * size
        end = start - window - embargo
        if end > 0 and stop > start:
            yield end, start, stop


def dataset(features: DataFrame, labels: DataFrame, direction: int) -> DataFrame:
    """Bars with a resolved label: features, y (1 for a win), outcome, net_r."""
    lab = labels.where((F.col("direction") == direction) & (F.col("outcome") != "unresolved")).select(*M.KEY, "outcome", "net_r", F.when(F.col("outcome") == "win", 1.0).otherwise(0.0).alias("y"))
    return features.join(lab, M.KEY)


def usable(train: DataFrame, names: list[str]) -> list[str]:
    """Names of columns that have a value and vary in the training rows."""
    row = train.agg(*[(F.min(n) < F.max(n)).alias(n) for n in names]).first()
    return [n for n in names if row[n]]


def fit(train: DataFrame, names: list[str], tree: Tree = Tree()) -> PipelineModel | None:
    """A model of y, or None if the rows have one class only."""
    classes = train.agg(F.count_distinct("y")).first()[0]
    if classes < 2:
        return None
    filled = [f"{n}_filled" for n in names]
    stages = [Imputer(inputCols=names, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", maxDepth=tree.depth, maxIter=tree.rounds, stepSize=tree.step, seed=7)]
    return Pipeline(stages=stages).fit(train.select("y", *names))


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def validation_rows(scored: DataFrame) -> DataFrame:
    """The columns of out_of_fold; p is null in rows that aren't scored."""
    p = F.col("p") if "p" in scored.columns else F.lit(None).cast("double").alias("p")
    return scored.select(*M.KEY, p, "y", "outcome", "net_r")


def out_of_fold(data: DataFrame, n_bars: int, names: list[str], tree: Tree = Tree(), splits: int = 5) -> DataFrame | None:
    """Validation rows of all folds with p, written to the shared folder; None where no fold could be trained. One series; data should be a written table."""
    out = None
    for end, start, stop in purged_splits(n_bars, splits=splits):
        train = data.where(F.col("bar_idx") < end)
        known = usable(train, names)
        model = fit(train, known, tree) if known else None
        if model is None:
            continue
        val = validation_rows(scored(model, data.where(F.col("bar_idx").between(start, stop - 1))))
        out = val if out is None else out.unionByName(val)
    return None if out is None else scratch.written(out, "folds")


def quality(oof: DataFrame, threshold: float = 0.5) -> dict:
    """Trades at or over the threshold: n, wins, win rate, Wilson bound, mean net result."""
    t = oof.where(F.col("p") >= threshold)
    n, wins = F.count(F.lit(1)), F.sum("y")
    row = t.agg(n.alias("n"), F.coalesce(wins, F.lit(0.0)).alias("wins"), stats.wilson_lower(F.coalesce(wins, F.lit(0.0)), n).alias("wilson_lower"), F.avg("net_r").alias("mean_r")).first()
    return row.asDict()


def ensemble(parts: list[DataFrame]) -> DataFrame:
    """Mean probability of several models' rows."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*M.KEY, "y", "outcome", "net_r").agg(F.avg("p").alias("p"))


def select_model(data: DataFrame, n_bars: int, names: list[str], choices: tuple[Tree, ...] = CHOICES) -> tuple[str, DataFrame] | None:
    """The choice, or the mean of all, with the best (Wilson bound, trades)."""
    found = [(f"depth{c.depth}", o) for c in choices if (o := out_of_fold(data, n_bars, names, c)) is not None]
    if not found:
        return None
    if len(found) > 1:
        found.append(("ensemble", ensemble([o for _, o in found])))

    def rank(item: tuple[str, DataFrame]) -> tuple:
        q = quality(item[1])
        return q["wilson_lower"], q["n"]

    return max(found, key=rank)


def distilled(model: PipelineModel, rows: DataFrame, names: list[str], depth: int = 4) -> tuple[str, float]:
    """Rules of a small tree that imitates the model, and the share of rows on which both agree."""
    p = scored(model, rows).withColumn("says", F.col("prediction")).drop("prediction", "rawPrediction", "probability")
    small = DecisionTreeClassifier(featuresCol="x", labelCol="says", maxDepth=depth, seed=7).fit(p)
    agree = small.transform(p).agg(F.avg((F.col("prediction") == F.col("says")).cast("double"))).first()[0]
    text = small.toDebugString
    used = model.stages[1].getInputCols()
    for i in range(len(used) - 1, -1, -1):
        text = text.replace(f"feature {i} ", f"{used[i].removesuffix('_filled')} ")
    return text, agree


class Registry:
    """Models below <root>/<symbol>/<timeframe>/<direction>/rr_<ratio>/<version>, with their results; active.json names the one in use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _folder(self, symbol: str, timeframe: str, direction: int, rr: float) -> str:
        return f"{self.root}/{symbol}/{timeframe}/{'long' if direction > 0 else 'short'}/rr_{rr:g}"

    def _meta(self, path: str) -> dict | None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.json(path).first().asDict()

    def _write(self, row: dict, path: str) -> None:
        self.spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(path)

    def save(self, model: PipelineModel, symbol: str, timeframe: str, direction: int, rr: float, results: dict) -> str:
        version = uuid.uuid4().hex[:12]
        at = f"{self._folder(symbol, timeframe, direction, rr)}/{version}"
        model.write().overwrite().save(f"{at}/model")
        self._write({k: float(v or 0.0) for k, v in results.items()} | {"version": version}, f"{at}/meta.json")
        return version

    def active(self, symbol: str, timeframe: str, direction: int, rr: float) -> tuple[PipelineModel, dict] | None:
        folder = self._folder(symbol, timeframe, direction, rr)
        named = self._meta(f"{folder}/active.json")
        if named is None:
            return None
        at = f"{folder}/{named['version']}"
        return PipelineModel.load(f"{at}/model"), self._meta(f"{at}/meta.json")

    def promote(self, version: str, symbol: str, timeframe: str, direction: int, rr: float, least: float = M.MIN_WIN_RATE, trades: int = 30) -> bool:
        """Makes the version active if it qualifies and its Wilson bound is no worse than the active one's."""
        folder = self._folder(symbol, timeframe, direction, rr)
        new = self._meta(f"{folder}/{version}/meta.json")
        if new is None or new["n"] < trades or new["wins"] < least * new["n"]:
            return False
        now = self._meta(f"{folder}/active.json")
        if now is not None and new["wilson_lower"] < self._meta(f"{folder}/{now['version']}/meta.json")["wilson_lower"]:
            return False
        self._write({"version": version}, f"{folder}/active.json")
        return True
