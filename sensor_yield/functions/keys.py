"""Deterministic random keys.

``rand(seed)`` depends on partitioning, so every seeded choice (splits, folds,
samples, permutations, synthetic rows) is driven by an md5 of ``seed:id``. The key
orders rows identically in Spark and in SQL engines that have ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensor_yield import config

TWO_POW_52 = float(1 << 52)


def random_key(id_col: Column | str, seed: int | str = config.SEED, salt: str | None = None) -> Column:
    """md5 hex string of ``seed:id`` (or ``seed:salt:id``)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    prefix = f"{seed}:" if salt is None else f"{seed}:{salt}:"
    return F.md5(F.concat(F.lit(prefix), c.cast("string")))


def uniform01(key: Column) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of an md5 key: 52 bits, all that a
    double holds, so a pick among any number of rows can fall on each of them."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(TWO_POW_52)
