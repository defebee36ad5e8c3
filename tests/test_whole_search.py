"""``model_comparison`` searches the whole space: the reference's grids, settings, folds and repeats."""

from __future__ import annotations

import inspect

from sensor_yield import config
from sensor_yield.operators.models import build_candidates
from sensor_yield.plans import queries_ml, training


def test_model_comparison_searches_the_whole_space(spark, monkeypatch):
    table = spark.createDataFrame([(i, i % 2, float(i)) for i in range(6)], "row_id long, Pass_Fail int, feature_000 double")
    calls, run = [], inspect.signature(training.run_training)

    def recorded(*args, **kwargs):
        call = run.bind(*args, **kwargs)
        call.apply_defaults()
        calls.append(call.arguments)
        return {"comparison": table}

    monkeypatch.setattr(training, "run_training", recorded)
    monkeypatch.setattr(queries_ml.D, "embedding_sensors", lambda spark, sf_dir: table)
    queries_ml.q_model_comparison(spark, "nowhere")
    (call,) = calls
    assert call["df"] is table and call["feature_cols"] is None
    assert (call["n_iter"], call["k"], call["importance_repeats"]) == (20, 5, 10)
    candidates = call["candidates"] or build_candidates(call["seed"])
    assert {c.name: c.grid for c in candidates} == {
        config.MODEL_LOGISTIC: {"C": [0.01, 0.1, 1.0, 10.0]},
        **{name: {"n_estimators": [200, 300, 400], "max_depth": [None, 8, 12], "min_samples_leaf": [1, 2, 4]}
           for name in (config.MODEL_FOREST_SMOTE, config.MODEL_FOREST_WEIGHTS)},
        config.MODEL_BOOSTING: {"n_estimators": [200, 300, 400], "max_depth": [3, 4, 5, 6], "learning_rate": [0.01, 0.05, 0.1],
                                "subsample": [0.7, 0.85, 1.0]}}
    assert [len(c.settings(call["n_iter"], call["seed"])) for c in candidates] == [4, 20, 20, 20]
