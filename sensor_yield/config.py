"""Project constants.

The block marked FIXED VALUES holds the values that results depend on (names,
thresholds, grids, candidate lists). They are stated once, here, in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (results depend on these; keep them as stated)
# ---------------------------------------------------------------------------
# Known single-file (combined CSV) names, tried in this order.
COMBINED_CSV_CANDIDATES: tuple[str, ...] = ("uci-secom.csv", "secom.csv", "uci-semcom.csv")
# Canonical two-file layout names.
FEATURES_FILE_CANDIDATES: tuple[str, ...] = ("secom.data",)
LABELS_FILE_CANDIDATES: tuple[str, ...] = ("secom_labels.data",)
# Normalised (strip + lower) header names accepted as the label column.
LABEL_NAME_CANDIDATES: tuple[str, ...] = (
    "pass/fail",
    "pass_fail",
    "passfail",
    "response",
    "target",
    "label",
)
# Timestamp formats tried for the whole column, in order (Spark pattern letters):
# day-first, then ISO-like.
TIME_FORMATS: tuple[str, ...] = ("dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
# A format wins for the whole column when its parsed share is strictly above this.
TIME_FORMAT_WIN_SHARE: float = 0.9

SEED: int = 42
FEATURE_PREFIX: str = "feature_"
FEATURE_NAME_DIGITS: int = 3

ROW_ID_COL: str = "row_id"
TIME_COL: str = "Time"
LABEL_RAW_COL: str = "Pass_Fail_Raw"
LABEL_COL: str = "Pass_Fail"
LABEL_TEXT_COL: str = "Pass_Fail_Label"
RAW_LABEL_PASS: int = -1
RAW_LABEL_FAIL: int = 1
PASS_TEXT: str = "Pass"
FAIL_TEXT: str = "Fail"

MISSING_RATIO_THRESHOLDS: tuple[float, ...] = (0.4, 0.5, 0.7)
LOW_VARIANCE_THRESHOLD: float = 1e-6
HIGH_CORR_THRESHOLD: float = 0.95
MODELING_MISSING_THRESHOLD: float = 0.5

TEST_SIZE: float = 0.2
CV_FOLDS: int = 5
N_RANDOM_SEARCH_ITER: int = 20
TOP_N_FEATURES: int = 30
# Decision-threshold grid 0.05, 0.10, ..., 0.95 (19 points).
THRESHOLD_GRID: tuple[float, ...] = tuple(round(i / 100, 2) for i in range(5, 100, 5))
DEFAULT_DECISION_THRESHOLD: float = 0.5

# Threshold recommendation rules.
MIN_PRECISION_FOR_RECALL_RULE: float = 0.2
MIN_RECALL_FOR_PRECISION_RULE: float = 0.5
RECOMMENDATION_KEYS: tuple[str, ...] = (
    "max_f1",
    "high_recall_min_precision_0.2",
    "high_precision_min_recall_0.5",
)

# Dashboard / report caps (these limits are the feature: bounded report tables).
DETAIL_TABLE_ROWS: int = 500
MISCLASSIFIED_ROWS_PER_TYPE: int = 150
SCATTER_SAMPLE_ROWS: int = 500
ATTRIBUTION_SAMPLE_ROWS: int = 200
PROBABILITY_HIST_BINS: int = 25
MISSING_HIST_BINS: int = 40
TOP_IMPORTANCE_CHART: int = 20
TOP_DISTRIBUTION_SENSORS: int = 8
TOP_SCATTER_SENSORS: int = 5
DEFAULT_SELECTED_SENSORS: int = 2
PERMUTATION_REPEATS: int = 10
SMOTE_NEIGHBOURS: int = 5

# Dashboard display values.
ERROR_TYPES: tuple[str, ...] = ("TP", "TN", "FP", "FN")
ERROR_TYPE_OTHER: str = "NA"
MATCH_TEXT: str = "Correct"
MISMATCH_TEXT: str = "Incorrect"
ALL_SLICE: str = "All"
THRESHOLD_KPI_FORMAT: str = "Threshold=%.2f  |  Recall=%.3f  |  Precision=%.3f  |  F1=%.3f  |  FP=%d  |  FN=%d"
CV_TEXT_FORMAT: str = "%.3f ± %.3f"

# Candidate model names and their descriptive columns.
MODEL_LOGISTIC: str = "Baseline_LogisticRegression"
MODEL_FOREST_SMOTE: str = "RandomForest_SMOTE"
MODEL_FOREST_WEIGHTS: str = "RandomForest_ClassWeight"
MODEL_BOOSTING: str = "XGBoost_ScalePosWeight"
MODEL_DESCRIPTIONS: dict[str, tuple[str, str]] = {
    MODEL_LOGISTIC: ("median_impute+variance_threshold+scale", "none"),
    MODEL_FOREST_SMOTE: ("median_impute+variance_threshold", "SMOTE (train fold only)"),
    MODEL_FOREST_WEIGHTS: ("median_impute+variance_threshold", "class_weight=balanced"),
    MODEL_BOOSTING: (
        "variance_threshold_only (native missing handling, no imputation)",
        "scale_pos_weight (from train class ratio)",
    ),
}
# Search spaces.
LOGISTIC_C_GRID: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
FOREST_TREES_GRID: tuple[int, ...] = (200, 300, 400)
FOREST_DEPTH_GRID: tuple[int | None, ...] = (None, 8, 12)
FOREST_MIN_LEAF_GRID: tuple[int, ...] = (1, 2, 4)
BOOST_ROUNDS_GRID: tuple[int, ...] = (200, 300, 400)
BOOST_DEPTH_GRID: tuple[int, ...] = (3, 4, 5, 6)
BOOST_RATE_GRID: tuple[float, ...] = (0.01, 0.05, 0.1)
BOOST_SUBSAMPLE_GRID: tuple[float, ...] = (0.7, 0.85, 1.0)
LOGISTIC_MAX_ITER: int = 2000
# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

# Spark's maximum tree depth stands in for "unbounded depth".
SPARK_MAX_TREE_DEPTH: int = 30
