"""The demand model: one gradient-boosted tree ensemble over all zones (Spark ML trees), chosen on validation, tested once."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators import boosting
from tallyspark.operators.boosting import Boosted
from tallyspark.operators.evaluate import clip
from tallyspark.operators.features import LAGS, ROLLING

TARGET, BASELINE = "trips_total", "lag_168"
CATEGORIES = ("zone_id",)
CALENDAR = ("hour_of_day", "day_of_week", "is_holiday")
HISTORY = (*(f"lag_{k}" for k in LAGS), f"roll_mean_{ROLLING}")
RECENT = ("lag_1", "lag_2", "lag_3", f"roll_mean_{ROLLING}")
PATIENCE, MOST_ROUNDS = 30, 600

#: Candidates of the search, six at most: settings of the tree learner, and the loss.
GRID = (
    {"maxDepth": 4}, {"maxDepth": 6}, {"maxDepth": 8}, {"maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    {"maxDepth": 6, "minInstancesPerNode": 20}, {"maxDepth": 6, "loss": "poisson"},
)


def _settings(params: dict) -> dict:
    return {"loss": params.get("loss", "squared"), "params": {k: v for k, v in params.items() if k != "loss"}}


def fit(train: DataFrame, features: tuple, params: dict, rounds: int, seed: int = 42) -> Boosted:
    """An ensemble of so many rounds. Nulls raise: training starts where the longest lag exists."""
    return boosting.boost(train, TARGET, CATEGORIES, features, rounds, seed=seed, **_settings(params))


def validation_mae(model: Boosted, rows: DataFrame) -> float:
    return RegressionEvaluator(labelCol=TARGET, predictionCol="forecast", metricName="mae").evaluate(clip(model.transform(rows), "forecast"))


def fit_stopping(train: DataFrame, validation: DataFrame, features: tuple, params: dict, rounds: int = MOST_ROUNDS, seed: int = 42, patience: int = PATIENCE, prepared=None) -> tuple[Boosted, int, float]:
    """(ensemble, rounds, MAE) at its lowest validation error: at most `rounds`, none once `patience` rounds brought nothing better."""
    found = boosting.boost(train, TARGET, CATEGORIES, features, rounds, seed=seed, validation=validation, patience=patience, prepared=prepared, **_settings(params))
    error = min(found.errors)
    used = found.errors.index(error) + 1
    return found.first(used), used, error


def side_by_side(spark: SparkSession, jobs: list[Callable], width: int) -> list:
    """Results of jobs that run at the same time, each in a scheduler pool of its own (with spark.scheduler.mode FAIR they share the executors evenly)."""

    def run(i: int, job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"candidate-{i}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(width, len(jobs)))) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(run), i, job) for i, job in enumerate(jobs)]]


def search(train: DataFrame, validation: DataFrame, features: tuple, grid: tuple = GRID, rounds: int = MOST_ROUNDS, seed: int = 42, patience: int = PATIENCE, width: int = 6) -> list[dict]:
    """Candidates by validation MAE, best first: {params, rounds, mae, hit_limit, model}. Test rows are never seen.

    Candidates are independent, so up to `width` of them are fitted at the same time over the same prepared rows; one after the other gives the same.
    """
    train, validation = train.persist(), validation.persist()
    prepared = boosting.preparation(train, CATEGORIES, features)

    def one(params: dict) -> dict:
        model, used, error = fit_stopping(train, validation, features, params, rounds, seed, patience, prepared)
        return {"params": params, "rounds": used, "mae": float(error), "hit_limit": used >= rounds, "model": model}

    try:
        out = side_by_side(train.sparkSession, [lambda p=p: one(p) for p in grid[:6]], width)
    finally:
        train.unpersist()
        validation.unpersist()
    return sorted(out, key=lambda x: x["mae"])


def ablation(train: DataFrame, validation: DataFrame, base: tuple, extra: tuple, params: dict, rounds: int = MOST_ROUNDS, seed: int = 42, patience: int = PATIENCE) -> dict:
    """Lowest validation MAE with and without extra features, each with early stopping; the extra ones are kept only if the error falls."""
    train, validation = train.persist(), validation.persist()
    try:
        errors = side_by_side(train.sparkSession, [lambda f=f: fit_stopping(train, validation, f, params, rounds, seed, patience)[2] for f in (base, (*base, *extra))], 2)
    finally:
        train.unpersist()
        validation.unpersist()
    return {"mae_without": errors[0], "mae_with": errors[1], "kept": errors[1] < errors[0]}


def backtest(history: DataFrame, test: DataFrame, features: tuple, params: dict, rounds: int, seed: int = 42) -> DataFrame:
    """Test rows with the column forecast, from a model fitted on training and validation rows together."""
    return clip(fit(history, features, params, rounds, seed).transform(test), "forecast")
