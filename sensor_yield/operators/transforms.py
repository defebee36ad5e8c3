"""Leakage-safe learned transforms as ``pyspark.ml`` stages.

Each estimator learns its state with ONE aggregate over the rows it is fitted on
(the training split or a CV fold's training part) and its model applies that state
with plain column expressions, so ``transform`` stays inside whole-stage codegen.
The stages work on one DOUBLE column per feature (``feature_XXX``); the last stage
assembles whatever feature columns survived into a vector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators.profile import column_stats, feature_profile
from sensor_yield.operators.quantiles import approximate_medians, exact_medians


def _feature_cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    if cols:
        return [c for c in cols if c in df.columns]
    return [c for c in df.columns if c.startswith(config.FEATURE_PREFIX)]


class _FeatureStage(HasInputCols):
    """Shared ``inputCols`` handling: default = every ``feature_`` column."""

    def _inputs(self, df: DataFrame) -> list[str]:
        cols = self.getOrDefault(self.inputCols) if self.isDefined(self.inputCols) else None
        return _feature_cols(df, cols)


class ColumnSelectorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the learned feature columns (input order) and every non-feature column."""

    keptCols = Param(Params._dummy(), "keptCols", "feature columns to keep", TypeConverters.toListString)
    droppedCols = Param(Params._dummy(), "droppedCols", "feature columns to drop", TypeConverters.toListString)

    def __init__(self, keptCols: list[str] | None = None, droppedCols: list[str] | None = None):
        super().__init__()
        self._set(keptCols=keptCols or [], droppedCols=droppedCols or [])

    def get_feature_names_out(self) -> list[str]:
        return list(self.getOrDefault(self.keptCols))

    def _transform(self, df: DataFrame) -> DataFrame:
        drop = set(self.getOrDefault(self.droppedCols))
        return df.select(*[c for c in df.columns if c not in drop])


class MissingRatioDropper(Estimator, _FeatureStage, DefaultParamsReadable, DefaultParamsWritable):
    """Keep columns whose missing ratio on the fit rows is ``<= threshold``."""

    threshold = Param(Params._dummy(), "threshold", "max missing ratio kept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, threshold: float = config.MODELING_MISSING_THRESHOLD, inputCols: list[str] | None = None):
        super().__init__()
        self._setDefault(threshold=config.MODELING_MISSING_THRESHOLD)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ColumnSelectorModel:
        cols = self._inputs(df)
        t = self.getOrDefault(self.threshold)
        ratios = {r["feature_name"]: r["missing_ratio"] for r in
                  feature_profile(df, cols).select("feature_name", "missing_ratio").collect()}
        kept = [c for c in cols if ratios.get(c) is not None and ratios[c] <= t]
        return ColumnSelectorModel(keptCols=kept, droppedCols=[c for c in cols if c not in kept])


class VarianceFilter(Estimator, _FeatureStage, DefaultParamsReadable, DefaultParamsWritable):
    """Variance rule learned on the fit rows.

    * ``ddof=1, inclusive=True``: NaN-tolerant sample variance, keep ``var >= t``
      (undefined variance dropped) -- the low-variance dropper (T02);
    * ``ddof=0, inclusive=False``: population variance, keep ``var > t`` -- the
      variance threshold applied after imputation (T03).
    """

    threshold = Param(Params._dummy(), "threshold", "variance threshold", TypeConverters.toFloat)
    ddof = Param(Params._dummy(), "ddof", "1 sample, 0 population", TypeConverters.toInt)
    inclusive = Param(Params._dummy(), "inclusive", "keep var >= t (else > t)", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, threshold: float = config.LOW_VARIANCE_THRESHOLD, ddof: int = 1, inclusive: bool = True,
                 inputCols: list[str] | None = None):
        super().__init__()
        self._setDefault(threshold=config.LOW_VARIANCE_THRESHOLD, ddof=1, inclusive=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ColumnSelectorModel:
        cols = self._inputs(df)
        t = self.getOrDefault(self.threshold)
        incl = self.getOrDefault(self.inclusive)
        var = {r["feature_name"]: r["variance"] for r in
               feature_profile(df, cols, ddof=self.getOrDefault(self.ddof)).select("feature_name", "variance").collect()}
        kept = [c for c in cols if var.get(c) is not None and (var[c] >= t if incl else var[c] > t)]
        return ColumnSelectorModel(keptCols=kept, droppedCols=[c for c in cols if c not in kept])


class FillModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces NULL by a learned per-column value; columns without a value are dropped."""

    cols = Param(Params._dummy(), "cols", "columns", TypeConverters.toListString)
    values = Param(Params._dummy(), "values", "fill values", TypeConverters.toListFloat)
    droppedCols = Param(Params._dummy(), "droppedCols", "columns without a value", TypeConverters.toListString)
    indicator = Param(Params._dummy(), "indicator", "also emit missing indicators", TypeConverters.toBoolean)

    def __init__(self, cols=None, values=None, droppedCols=None, indicator=False):
        super().__init__()
        self._set(cols=cols or [], values=values or [], droppedCols=droppedCols or [], indicator=indicator)

    def _transform(self, df: DataFrame) -> DataFrame:
        fill = dict(zip(self.getOrDefault(self.cols), self.getOrDefault(self.values)))
        drop = set(self.getOrDefault(self.droppedCols))
        ind = self.getOrDefault(self.indicator)
        out = []
        for c in df.columns:
            if c in drop:
                continue
            if c in fill:
                out.append(F.coalesce(F.col(c), F.lit(float(fill[c]))).alias(c))
            else:
                out.append(F.col(c))
        if ind:
            out += [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in fill if c in df.columns]
        return df.select(*out)


class MedianImputer(Estimator, _FeatureStage, DefaultParamsReadable, DefaultParamsWritable):
    """Exact median per column on the fit rows (mean of the middle pair for
    even counts), or with ``approximate`` the median of a bounded sketch, in one scan;
    a column with no values is dropped."""

    approximate = Param(Params._dummy(), "approximate", "median of a bounded sketch", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, approximate: bool = False):
        super().__init__()
        self._setDefault(approximate=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FillModel:
        cols = self._inputs(df)
        medians = approximate_medians if self.getOrDefault(self.approximate) else exact_medians
        med = {r["feature_name"]: r["median"] for r in medians(df, cols).collect()}
        have = [c for c in cols if med.get(c) is not None]
        return FillModel(cols=have, values=[float(med[c]) for c in have],
                         droppedCols=[c for c in cols if c not in have])


class MissingIndicatorFiller(Estimator, _FeatureStage, DefaultParamsReadable, DefaultParamsWritable):
    """For learners that cannot take missing values: add ``<c>_missing``
    indicators and fill NULL below the fit-rows minimum (``min - 1``), so a split
    can still route missing values to their own side."""

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FillModel:
        cols = self._inputs(df)
        mins = column_stats(df, cols, {"min": "min"})
        have = [c for c in cols if mins[c]["min"] is not None]
        return FillModel(cols=have, values=[float(mins[c]["min"]) - 1.0 for c in have],
                         droppedCols=[c for c in cols if c not in have], indicator=True)


class ScalerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    cols = Param(Params._dummy(), "cols", "columns", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "scales", TypeConverters.toListFloat)

    def __init__(self, cols=None, means=None, scales=None):
        super().__init__()
        self._set(cols=cols or [], means=means or [], scales=scales or [])

    def _transform(self, df: DataFrame) -> DataFrame:
        stats = {c: (m, s) for c, m, s in zip(self.getOrDefault(self.cols), self.getOrDefault(self.means),
                                               self.getOrDefault(self.scales))}
        return df.select(*[((F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c) if c in stats
                           else F.col(c) for c in df.columns])


class StandardScaler(Estimator, _FeatureStage, DefaultParamsReadable, DefaultParamsWritable):
    """Centre by the mean and divide by the population std; a zero std is
    treated as 1. (ML's StandardScaler divides by the sample std.)"""

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ScalerModel:
        cols = self._inputs(df)
        st = column_stats(df, cols, {"mean": "avg", "std": "stddev_pop"})
        means, scales = [], []
        for c in cols:
            m, s = st[c]["mean"], st[c]["std"]
            means.append(0.0 if m is None else float(m))
            scales.append(1.0 if (s is None or s == 0.0) else float(s))
        return ScalerModel(cols=cols, means=means, scales=scales)


class FeatureAssembler(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Assembles every surviving ``feature_`` column (and missing indicators) into
    a vector; the set is fixed by the fitted stages before it. Missing values are an error,
    or NaN with ``keepMissing``."""

    keepMissing = Param(Params._dummy(), "keepMissing", "missing values become NaN", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, outputCol: str = "features", keepMissing: bool = False):
        super().__init__()
        self._setDefault(outputCol="features", keepMissing=False)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c.startswith(config.FEATURE_PREFIX)]
        return VectorAssembler(inputCols=cols, outputCol=self.getOutputCol(),
                               handleInvalid="keep" if self.getOrDefault(self.keepMissing) else "error").transform(df)


def base_stages(missing_threshold: float = config.MODELING_MISSING_THRESHOLD, use_scaler: bool = False) -> list:
    """Missing-ratio drop -> median imputation -> population-variance filter
    (-> scaler); then the vector assembly."""
    stages = [MissingRatioDropper(threshold=missing_threshold), MedianImputer(),
              VarianceFilter(threshold=config.LOW_VARIANCE_THRESHOLD, ddof=0, inclusive=False)]
    if use_scaler:
        stages.append(StandardScaler())
    stages.append(FeatureAssembler())
    return stages


def native_missing_stages(missing_threshold: float = config.MODELING_MISSING_THRESHOLD) -> list:
    """Boosting path: missing-ratio drop -> NaN-tolerant sample-variance dropper -> assembly with
    missing values left in (no imputation; the trees learn a side for them)."""
    return [MissingRatioDropper(threshold=missing_threshold),
            VarianceFilter(threshold=config.LOW_VARIANCE_THRESHOLD, ddof=1, inclusive=True),
            FeatureAssembler(keepMissing=True)]
