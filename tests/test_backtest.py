"""The backtest refits what the search chose."""

from tallyspark.operators import model
from tallyspark.plans import queries


def test_backtest_refits_the_chosen_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model, "search", lambda *a, **k: [{"params": {"maxDepth": 2}, "rounds": 2, "mae": 0.0}])
    monkeypatch.setattr(model, "backtest", lambda history, test, features, params, rounds: seen.append((params, rounds)) or test.selectExpr("*", "1.0D AS forecast"))
    queries.QUERIES["backtest_scored"](spark, "/root/testdata/sf0.001")
    assert seen == [({"maxDepth": 2}, 2)]
