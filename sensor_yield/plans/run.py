"""Command-line runs of the two entries.

    python -m sensor_yield.plans.run eda   --raw-dir <dir> --out <dir>
    python -m sensor_yield.plans.run train --raw-dir <dir> --out <dir> [--n-iter 20] [--folds 5]

``eda`` writes the EDA summary document; ``train`` loads and normalises the raw
layout, runs the search / evaluation / selection / importance plan and writes every
mart (master table, feature summary, model performance, threshold sweeps,
importance, final report, fitted models). Paths may be any cluster file system.
"""

from __future__ import annotations

import argparse
import time

from sensor_yield import config
from sensor_yield.operators import dashboard as db
from sensor_yield.operators.models import build_candidates
from sensor_yield.plans import exports
from sensor_yield.plans.eda import eda_summary
from sensor_yield.plans.training import run_training, score_rows
from sensor_yield.session import get_spark
from sensor_yield.sources.raw_files import load_raw


def run_eda(spark, raw_dir: str, out: str) -> dict:
    df = load_raw(spark, raw_dir)
    doc = eda_summary(df)
    exports.write_json(spark, doc, f"{out.rstrip('/')}/eda_summary.json")
    return doc


def run_train(spark, raw_dir: str, out: str, n_iter: int = config.N_RANDOM_SEARCH_ITER,
              folds: int = config.CV_FOLDS, select_on: str = "test", grids: dict | None = None,
              importance_repeats: int = config.PERMUTATION_REPEATS) -> dict:
    start = time.time()
    df = load_raw(spark, raw_dir).cache()
    feats = [c for c in df.columns if c.startswith(config.FEATURE_PREFIX)]
    res = run_training(df, feature_cols=feats, candidates=build_candidates(grids=grids), n_iter=n_iter, k=folds,
                       select_on=select_on, importance_repeats=importance_repeats)
    best = res["best_model"]
    model = {r.name: r.model for r in res["results"]}[best]
    top = [r["feature_name"] for r in
           res["importance"].orderBy("rank").limit(config.TOP_N_FEATURES).select("feature_name").collect()]
    master = db.build_master(score_rows(model, res["split"]), best, top)
    exports.write_master(master, out)
    exports.write_feature_summary(db.feature_summary(df, feats, res["importance"]), out)
    exports.write_model_performance(res["comparison"], out)
    exports.write_thresholds(res["thresholds"], out)
    exports.write_importance(res["importance"], out)
    exports.write_json(spark, res["report"], f"{out.rstrip('/')}/final_metrics.json")
    exports.save_models({r.name: r.model for r in res["results"]}, out, best)
    res["report"]["elapsed_seconds"] = time.time() - start
    return res["report"]


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="sensor_yield")
    ap.add_argument("entry", choices=["eda", "train"])
    ap.add_argument("--raw-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--n-iter", type=int, default=config.N_RANDOM_SEARCH_ITER)
    ap.add_argument("--folds", type=int, default=config.CV_FOLDS)
    ap.add_argument("--select-on", choices=["test", "cv"], default="test")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = get_spark(a.master)
    if a.entry == "eda":
        doc = run_eda(spark, a.raw_dir, a.out)
        print({k: doc[k] for k in ("n_rows", "n_features", "fail_rate")})
    else:
        rep = run_train(spark, a.raw_dir, a.out, a.n_iter, a.folds, a.select_on)
        print({"best_model": rep["best_model"], "elapsed_seconds": round(rep["elapsed_seconds"], 1)})


if __name__ == "__main__":
    main()

