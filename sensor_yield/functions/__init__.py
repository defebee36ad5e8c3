"""Column-level helpers: names, keys, labels, timestamps, formatting."""

from sensor_yield.functions.columns import feature_columns, generate_feature_names
from sensor_yield.functions.keys import random_key, uniform01
from sensor_yield.functions.labels import convert_labels, label_text

__all__ = [
    "convert_labels",
    "feature_columns",
    "generate_feature_names",
    "label_text",
    "random_key",
    "uniform01",
]
