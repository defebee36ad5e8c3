"""sensor_yield: a PySpark engine for wide, sparsely filled sensor tables with a
rare failure label -- loading, profiling, exact stratified splits, leakage-safe
preprocessing, imbalance-aware classifiers, evaluation and BI marts, all as
DataFrame plans and ``pyspark.ml`` stages."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.2.0"

# Functions of this package travel to the executors by value, so a job works from any
# directory without installing the package on every machine.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
