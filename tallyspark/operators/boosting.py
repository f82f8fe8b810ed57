"""Boosting round by round: one Spark ML regression tree a round, fitted to what the margin so far leaves.

The rows carry their margin as a column, so a round costs one tree and one update, however many came before. Squared loss fits the residual; Poisson loss
makes Newton steps: the working response (y - mu) / mu with weight mu, mu = exp(margin), and steps of at most STEP. The margin of validation rows is
kept in the same way, so every round's error is known at once and boosting ends when `patience` rounds brought nothing better.
"""

import json
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import batched

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.files import delete_path, scratch_path

#: Learning rate, the largest Newton step, rounds after which lineage is cut, trees that are applied in one projection.
RATE, STEP, CUT, TOGETHER = 0.1, 0.7, 10, 25
LOSSES = ("squared", "poisson")


@dataclass
class Boosted:
    """A fitted ensemble. errors: the validation error after each round, if there were validation rows."""

    prepare: PipelineModel
    base: float
    loss: str
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def first(self, rounds: int) -> "Boosted":
        """The ensemble as it was after so many rounds."""
        return Boosted(self.prepare, self.base, self.loss, self.trees[:rounds], self.errors[:rounds], self.losses[:rounds])

    def transform(self, rows: DataFrame, column: str = "forecast") -> DataFrame:
        """rows with the forecast."""
        out = self.prepare.transform(rows).withColumn("_margin", F.lit(self.base))
        for some in batched(self.trees, TOGETHER):
            for i, tree in enumerate(some):
                out = tree.copy().setFeaturesCol("_features").setPredictionCol(f"_tree{i}").transform(out)
            steps = F.array(*(step(F.col(f"_tree{i}"), self.loss) for i in range(len(some))))
            out = out.select(*rows.columns, "_features", (F.col("_margin") + F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).alias("_margin"))
        return out.select(*rows.columns, mean(F.col("_margin"), self.loss).alias(column))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.prepare.write().overwrite().save(f"{path}/prepare")
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/trees/{i}")
        facts = json.dumps({"base": self.base, "loss": self.loss, "trees": len(self.trees), "errors": self.errors, "losses": self.losses})
        spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @staticmethod
    def load(path: str) -> "Boosted":
        facts = json.loads(SparkSession.active().read.text(f"{path}/facts").first()[0])
        trees = [DecisionTreeRegressionModel.load(f"{path}/trees/{i}") for i in range(facts["trees"])]
        return Boosted(PipelineModel.load(f"{path}/prepare"), facts["base"], facts["loss"], trees, facts["errors"], facts["losses"])


def mean(margin: Column, loss: str) -> Column:
    """The expected value that goes with a margin."""
    return F.exp(margin) if loss == "poisson" else margin


def step(tree: Column, loss: str) -> Column:
    """What a tree's value adds to the margin."""
    return F.lit(RATE) * (F.greatest(F.least(tree, F.lit(STEP)), F.lit(-STEP)) if loss == "poisson" else tree)


def preparation(train: DataFrame, categories: tuple, features: tuple) -> PipelineModel:
    """Categories as indices, all features as one vector. Nulls raise."""
    index = [StringIndexer(inputCol=c, outputCol=f"_index_{c}", handleInvalid="keep") for c in categories]
    vector = VectorAssembler(inputCols=[*(f"_index_{c}" for c in categories), *features], outputCol="_features", handleInvalid="error")
    return Pipeline(stages=[*index, vector]).fit(train)


class _Rows:
    """(_features, _y, _margin) of some rows, whose margin grows round by round. Each round's table is persisted; every CUT rounds it is written."""

    def __init__(self, rows: DataFrame, base: float):
        self.loose: list[DataFrame] = []
        self.path: str | None = None
        self.rounds, self.now = 0, rows.withColumn("_margin", F.lit(base))
        self._keep(self.now)

    def _keep(self, df: DataFrame) -> None:
        self.rounds += 1
        if self.rounds % CUT == 1:
            before, loose = self.path, self.loose
            self.path = scratch_path(df.sparkSession)
            df.write.parquet(self.path)
            self.now, self.loose = df.sparkSession.read.schema(df.schema).parquet(self.path).persist(), []
            for x in loose:
                x.unpersist()
            if before:
                delete_path(df.sparkSession, before)
        else:
            self.now = df.persist()
        self.loose.append(self.now)

    def add(self, tree: DecisionTreeRegressionModel, loss: str) -> None:
        applied = tree.transform(self.now)
        self._keep(applied.select("_features", "_y", (F.col("_margin") + step(F.col(tree.getPredictionCol()), loss)).alias("_margin")))

    def close(self) -> None:
        for x in self.loose:
            x.unpersist()
        if self.path:
            delete_path(self.now.sparkSession, self.path)


@contextmanager
def _growing(rows: DataFrame, base: float) -> Iterator[_Rows]:
    held = _Rows(rows, base)
    try:
        yield held
    finally:
        held.close()


def boost(
    train: DataFrame, target: str, categories: tuple, features: tuple, rounds: int, loss: str = "squared", params: dict | None = None, seed: int = 42,
    validation: DataFrame | None = None, patience: int | None = None, prepared: PipelineModel | None = None,
) -> Boosted:
    """Fits up to `rounds` trees. With validation rows, errors holds the mean absolute error of their forecasts, clipped at 0, after each round, and
    no more trees are fitted once `patience` rounds brought nothing better; the ensemble keeps all trees (first() cuts it).

    params go to the tree learner (maxDepth, minInstancesPerNode, subsamplingRate, featureSubsetStrategy). losses holds the training loss before each round (mean
    squared error, or mean of mu - y log mu). Rows must have a target; Poisson targets must not be negative, and not all 0.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    prepare = prepared or preparation(train, categories, features)
    y = F.col(target).cast("double").alias("_y")
    seen = train.agg(F.avg(y).alias("mean"), F.min(y).alias("least"), *(F.countDistinct(c).alias(c) for c in categories)).first()
    if seen["mean"] is None or loss == "poisson" and (seen["least"] < 0 or seen["mean"] <= 0):
        raise ValueError("no rows, or targets that the loss can't have")
    base = math.log(seen["mean"]) if loss == "poisson" else float(seen["mean"])
    bins = max([32, *(seen[c] + 2 for c in categories)])
    margin, mu = F.col("_margin"), mean(F.col("_margin"), loss)
    left, weight = (F.col("_y") - mu, F.lit(1.0)) if loss == "squared" else ((F.col("_y") - mu) / mu, mu)
    each = (F.col("_y") - mu) ** 2 if loss == "squared" else mu - F.col("_y") * margin
    out = Boosted(prepare, base, loss)
    best, at = float("inf"), 0
    with _growing(prepare.transform(train).select("_features", y), base) as rows, _growing((validation if validation is not None else train.limit(0)).transform(prepare.transform).select("_features", y), base) as held:
        for i in range(rounds):
            learner = RandomForestRegressor(numTrees=1, bootstrap=False, featuresCol="_features", labelCol="_left", weightCol="_weight", predictionCol="_tree", maxBins=bins, seed=seed + i, **(params or {}))
            tree = learner.fit(rows.now.select("_features", left.alias("_left"), weight.alias("_weight"))).trees[0].setFeaturesCol("_features").setPredictionCol("_tree")
            out.losses.append(rows.now.agg(F.avg(each)).first()[0])
            out.trees.append(tree)
            rows.add(tree, loss)
            if validation is None:
                continue
            held.add(tree, loss)
            error = held.now.agg(F.avg(F.abs(F.greatest(mu, F.lit(0.0)) - F.col("_y")))).first()[0]
            out.errors.append(error)
            if error < best:
                best, at = error, i
            elif patience is not None and i - at >= patience:
                break
    return out

