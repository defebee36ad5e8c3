"""End-to-end: load -> EDA summary -> training run -> marts -> dashboard reads."""

from __future__ import annotations

import os

import numpy as np
import pytest
from conftest import make_sensor_matrix, write_two_file_layout

from sensor_yield import config
from sensor_yield.operators import dashboard as db
from sensor_yield.operators.models import build_candidates
from sensor_yield.plans import exports
from sensor_yield.plans.eda import eda_summary
from sensor_yield.plans.training import run_training, score_rows
from sensor_yield.sources import marts
from sensor_yield.sources.raw_files import load_raw

SMALL = {
    config.MODEL_LOGISTIC: {"C": [0.1, 1.0]},
    config.MODEL_FOREST_SMOTE: {"n_estimators": [10], "max_depth": [4], "min_samples_leaf": [1]},
    config.MODEL_FOREST_WEIGHTS: {"n_estimators": [10], "max_depth": [4], "min_samples_leaf": [2]},
    config.MODEL_BOOSTING: {"n_estimators": [5], "max_depth": [3], "learning_rate": [0.1], "subsample": [1.0]},
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("raw"))
    x, y = make_sensor_matrix(300, 12)
    write_two_file_layout(d, x, y)
    return load_raw(spark, d).cache()


def test_eda_summary(loaded):
    doc = eda_summary(loaded)
    assert doc["n_rows"] == 300 and doc["n_features"] == 12 and doc["n_columns"] == 17
    assert doc["column_type_counts"]["double"] == 12
    assert doc["class_counts"] == {"Pass": 240, "Fail": 60}
    assert doc["n_low_variance_features"] == 1
    assert doc["n_high_correlation_pairs"] >= 1
    assert doc["n_duplicate_feature_rows"] == 0
    comp = {c["threshold"]: c["n_dropped"] for c in doc["missing_threshold_comparison"]}
    assert comp[0.5] == 1
    assert len(doc["pca_explained_variance"]) == 2
    assert doc["time_structure"]["is_monotonic_time"] is True  # fixture times increase with the row


def test_training_marts_dashboard(spark, loaded, tmp_path):
    out = run_training(loaded, candidates=build_candidates(grids=SMALL), k=3, importance_repeats=2)
    comp = out["comparison"].toPandas()
    assert len(comp) == 4 and set(comp["Model"]) == set(SMALL)
    assert out["report"]["n_train"] + out["report"]["n_test"] == 300
    assert out["report"]["n_test"] == 60
    thresholds = out["thresholds"].toPandas()
    assert (thresholds.groupby("model").size() == 19).all()
    assert ((thresholds.false_positives + thresholds.false_negatives + thresholds.true_positives
             + thresholds.true_negatives) == 60).all()
    imp = out["importance"].toPandas()
    assert sorted(imp["rank"]) == list(range(1, 13))

    best = out["best_model"]
    best_model = {r.name: r.model for r in out["results"]}[best]
    feats = [c for c in loaded.columns if c.startswith("feature_")]
    top = imp.sort_values("rank")["feature_name"].head(config.TOP_N_FEATURES).tolist()
    master = db.build_master(score_rows(best_model, out["split"]), best, top)
    root = str(tmp_path / "marts")
    exports.write_master(master, root)
    exports.write_feature_summary(db.feature_summary(loaded, feats, out["importance"]), root)
    exports.write_model_performance(out["comparison"], root)
    exports.write_thresholds(out["thresholds"], root)
    exports.write_importance(out["importance"], root)
    exports.write_json(spark, out["report"], os.path.join(root, "final_metrics.json"))
    assert marts.data_is_available(spark, root)
    m = marts.load_master_table(spark, root)
    assert m.count() == 300 and m.columns[:4] == ["row_id", "Time", "Pass_Fail", "Pass_Fail_Label"]
    th = marts.load_thresholds(spark, root, best).toPandas()
    assert len(th) == 19 and list(th["threshold"]) == sorted(th["threshold"])
    doc = exports.load_json(spark, os.path.join(root, "final_metrics.json"))
    assert doc["best_model"] == best
    m = db.with_error_type(m)
    k = db.kpis(m, split="test").first()
    assert k["total_samples"] == 60 and k["fail_count"] == 12 and k["selected_threshold"] == 0.5
    cm = {(r["actual"], r["predicted"]): r["n"] for r in db.confusion_text(m).collect()}
    assert sum(cm.values()) == 300 and len(cm) == 4
    hist = db.probability_histogram(m).toPandas()
    assert len(hist) == 2 * 25 and hist["n"].sum() == 300
    box = db.box_stats(m, top[0]).toPandas()
    assert set(box["class"]) == {"Pass", "Fail"}
    det = db.detail_table(db.detail_filter(m, actual="Fail"), top[:2])
    assert det.count() == 60
    sm = db.scatter_matrix_rows(m, top[:5]).toPandas()
    assert len(sm) == 60 and set(sm["prediction_match"]) <= {"Correct", "Incorrect"}
    mis = db.misclassified(m).toPandas()
    assert (mis.groupby("slice").size() <= 150).all()
    models_root = str(tmp_path / "models")
    exports.save_models({r.name: r.model for r in out["results"]}, models_root, best)
    from pyspark.ml import PipelineModel
    reloaded = PipelineModel.load(os.path.join(models_root, "models", "final_model"))
    assert reloaded.transform(loaded).count() == 300
    with pytest.raises(marts.DashboardDataError):
        marts.load_master_table(spark, str(tmp_path / "nothing"))
    assert np.isfinite(comp["PR_AUC"]).all()


def test_command_line_entries(spark, tmp_path):
    from sensor_yield.plans.run import main, run_train
    raw = tmp_path / "raw"
    raw.mkdir()
    x, y = make_sensor_matrix(150, 8, seed=3)
    write_two_file_layout(str(raw), x, y)
    out = str(tmp_path / "out")
    main(["eda", "--raw-dir", str(raw), "--out", out])
    assert exports.load_json(spark, os.path.join(out, "eda_summary.json"))["n_rows"] == 150
    rep = run_train(spark, str(raw), out, n_iter=1, folds=2, grids=SMALL, importance_repeats=1)
    assert rep["n_test"] == 30
    assert marts.data_is_available(spark, out)
    assert marts.load_master_table(spark, out).count() == 150
    assert marts.load_feature_summary(spark, out).count() == 8
    assert marts.load_model_performance(spark, out).count() == 4
