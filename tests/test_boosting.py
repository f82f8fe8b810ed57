"""Boosting round by round against plain Python, early stopping, saving, and candidates side by side."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import boosting, model

SCHEMA = "id int, zone int, a double, b double, y double"


def rows(n=240, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        zone, a, b = r.randrange(4), float(r.randrange(6)), float(r.randrange(5))
        out.append((i, zone, a, b, float(max(0, round(3 + 4 * (zone == 2) + a * (b > 2) + r.gauss(0, 1))))))
    return out


def best_split(some, weights, left):
    """(gain, feature, threshold) of the largest fall of the weighted squared error, over features a and b."""

    def error(x):
        w = sum(weights[i] for i in x)
        mean = sum(weights[i] * left[i] for i in x) / w
        return sum(weights[i] * (left[i] - mean) ** 2 for i in x)

    found = (0.0, None, None)
    for f in (2, 3):
        values = sorted({r[f] for r in some.values()})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            parts = [[i for i, r in some.items() if (r[f] <= cut) == side] for side in (True, False)]
            gain = error(list(some)) - sum(map(error, parts))
            if gain > found[0] + 1e-9:
                found = (gain, f, cut)
    return found


def plain(train, loss, rounds, depth):
    """Margins of the rows after each round, and the loss before each."""
    y = {r[0]: r[4] for r in train}
    mean = sum(y.values()) / len(y)
    margin = dict.fromkeys(y, math.log(mean) if loss == "poisson" else mean)
    losses, steps = [], []
    for _ in range(rounds):
        mu = {i: math.exp(m) if loss == "poisson" else m for i, m in margin.items()}
        losses.append(sum(mu[i] - y[i] * margin[i] if loss == "poisson" else (y[i] - mu[i]) ** 2 for i in y) / len(y))
        weights = mu if loss == "poisson" else dict.fromkeys(y, 1.0)
        left = {i: (y[i] - mu[i]) / weights[i] for i in y}
        leaves = [({r[0]: r for r in train}, 0)]
        while leaves:
            some, level = leaves.pop()
            _, f, cut = best_split(some, weights, left) if level < depth else (0, None, None)
            if f is None:
                value = sum(weights[i] * left[i] for i in some) / sum(weights[i] for i in some)
                if loss == "poisson":
                    value = max(-boosting.STEP, min(boosting.STEP, value))
                for i in some:
                    margin[i] += boosting.RATE * value
            else:
                leaves += [({i: r for i, r in some.items() if (r[f] <= cut) == side}, level + 1) for side in (True, False)]
        steps.append(dict(margin))
    return steps, losses


@pytest.mark.parametrize("loss", boosting.LOSSES)
def test_boosting_equals_plain_python(spark, loss):
    some = rows()
    train = spark.createDataFrame(some, SCHEMA)
    fitted = boosting.boost(train, "y", (), ("a", "b"), 13, loss, {"maxDepth": 2})
    steps, losses = plain(some, loss, 13, 2)
    assert fitted.losses == pytest.approx(losses) and all(x > z for x, z in zip(losses, losses[1:]))
    for n in (1, 5, 13):
        got = {r.id: r.forecast for r in fitted.first(n).transform(train).collect()}
        assert got == pytest.approx({i: math.exp(m) if loss == "poisson" else m for i, m in steps[n - 1].items()})


def test_errors_are_those_of_ensembles_of_that_size(spark):
    train, validation = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame(rows(90, 2), SCHEMA)
    found = boosting.boost(train, "y", ("zone",), ("a", "b"), 12, "poisson", {"maxDepth": 3}, validation=validation)
    for n in (1, 11, 12):
        alone = boosting.boost(train, "y", ("zone",), ("a", "b"), n, "poisson", {"maxDepth": 3})
        one, two = (x.transform(validation).agg(F.avg(F.abs(F.greatest("forecast", F.lit(0.0)) - F.col("y")))).first()[0] for x in (alone, found.first(n)))
        assert one == pytest.approx(found.errors[n - 1]) and two == pytest.approx(one)


def test_stops_when_patience_runs_out(spark):
    r = random.Random(5)
    noise = spark.createDataFrame([(i, 0, float(r.randrange(40)), 0.0, r.random()) for i in range(80)], SCHEMA)
    other = spark.createDataFrame([(i, 0, float(r.randrange(40)), 0.0, r.random()) for i in range(60)], SCHEMA)
    found = boosting.boost(noise, "y", (), ("a",), 40, "squared", {"maxDepth": 4}, validation=other, patience=3)
    best = found.errors.index(min(found.errors))
    assert len(found.trees) == len(found.errors) == best + 4 < 40
    train = noise.withColumn("zone_id", F.lit(1)).withColumn("trips_total", F.col("y"))
    test = other.withColumn("zone_id", F.lit(1)).withColumn("trips_total", F.col("y"))
    chosen, used, error = model.fit_stopping(train, test, ("a",), {"maxDepth": 4}, 40, patience=3)
    assert used == len(chosen.trees) == best + 1 and error == pytest.approx(min(found.errors))
    assert model.validation_mae(chosen, test) == pytest.approx(error)


def test_poisson_refuses_negative_targets(spark):
    with pytest.raises(ValueError):
        boosting.boost(spark.createDataFrame([(1, 1, 0.0, 0.0, -1.0)], SCHEMA), "y", (), ("a",), 1, "poisson")
    with pytest.raises(ValueError):
        boosting.boost(spark.createDataFrame([], SCHEMA), "y", (), ("a",), 1)
    with pytest.raises(ValueError):
        boosting.boost(spark.createDataFrame(rows(5), SCHEMA), "y", (), ("a",), 1, "other")


def test_saved_ensemble_scores_alike(spark, tmp_path):
    train = spark.createDataFrame(rows(), SCHEMA)
    fitted = boosting.boost(train, "y", ("zone",), ("a", "b"), 3, "poisson", {"maxDepth": 2})
    fitted.save(f"file://{tmp_path}/model")
    back = boosting.Boosted.load(f"file://{tmp_path}/model")
    score = lambda m: sorted((r.id, r.forecast) for r in m.transform(train).collect())
    assert score(back) == score(fitted) and (back.base, back.loss, back.losses) == (fitted.base, fitted.loss, fitted.losses)
    assert set(fitted.transform(train).columns) == {*train.columns, "forecast"}


def test_candidates_side_by_side_equal_one_after_the_other(spark):
    table = lambda seed, n: spark.createDataFrame(rows(n, seed), SCHEMA).select("id", F.col("zone").alias("zone_id"), "a", "b", F.col("y").alias("trips_total"))
    train, validation = table(1, 240), table(2, 90)
    grid = ({"maxDepth": 2}, {"maxDepth": 3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}, {"maxDepth": 2, "loss": "poisson"}, {"maxDepth": 3, "minInstancesPerNode": 20})
    one, two = (model.search(train, validation, ("a", "b"), grid, rounds=6, patience=3, width=w) for w in (1, 4))
    facts = lambda found: [(x["params"], x["rounds"], x["mae"], x["hit_limit"]) for x in found]
    assert facts(one) == facts(two) and [x["mae"] for x in one] == sorted(x["mae"] for x in one) and len(one) == 4
    with pytest.raises(ZeroDivisionError):
        model.side_by_side(spark, [lambda: 1, lambda: 1 // 0], 2)
