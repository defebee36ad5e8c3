"""Exact grouped quantiles without gathering a group into one task.

``percentile`` / ``median`` keep a value->count map per group and merge all of a
group's values in a single task. Here quantiles (linear interpolation between the
two nearest ranks, as numpy's default) are found in two scans, the same way for
groups of every size:

1. ``percentile_approx`` (a bounded sketch, partially aggregated) gives, per group
   and probability, a bracket of values around the wanted ranks, plus the count;
2. one more scan tells for every value and probability whether it lies below,
   inside or above the bracket; a grouped count keeps one row for all below, one
   for all above (with their nearest value) and one per distinct value inside.

Running counts over that table are exact ranks, in two steps: a bracket is cut into
``CELLS`` cells of equal width, whose counts say which cell holds a rank, and only that
cell's values are put in order. So no task orders a bracket (about ``4 n / accuracy`` values
of a group of n), only its cells and the values of one. Ranks that a bracket misses (beyond its neighbours) are counted, and only then are the
brackets widened, at last to the whole range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensor_yield.session import cut_lineage, settled

DEFAULT_ACCURACY = 10000
#: Half widths of the brackets tried in turn, in sketch errors; the last is the whole range.
WIDENINGS = (2.0, 16.0, None)
BELOW, INSIDE, ABOVE = 0, 1, 2
CELLS = 1024


def exact_quantiles(df: DataFrame, value_col: str, group_cols: Sequence[str], probs: Sequence[float],
                    accuracy: int = DEFAULT_ACCURACY, prefix: str = "q") -> DataFrame:
    """Per group: ``n`` and one column ``{prefix}{i}`` per probability (NULL for a
    group without values). NULL / NaN values are ignored; a NULL group is a group."""
    group_cols, probs = list(group_cols), [float(p) for p in probs]
    key = F.struct(*group_cols) if group_cols else F.struct(F.lit(0).alias("all"))
    vals = df.select(key.alias("g"), F.col(value_col).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v"))
    for width in WIDENINGS:
        found = cut_lineage(_quantiles(vals, probs, accuracy, None if width is None else width / accuracy))
        if width is None or found.where(F.exists("q", lambda x: x.isNull())).isEmpty():
            break
    return found.select(*[F.col(f"g.{c}").alias(c) for c in group_cols], "n",
                        *[F.element_at("q", i + 1).alias(f"{prefix}{i}") for i in range(len(probs))])


def _quantiles(vals: DataFrame, probs: list[float], accuracy: int, band: float | None) -> DataFrame:
    """g, n, q (array in the order of ``probs``, NULL where a bracket missed a rank)."""
    ends = [x for p in probs for x in ((0.0, 1.0) if band is None else (max(0.0, p - band), min(1.0, p + band)))]
    sketch = vals.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, accuracy).alias("e"))
    brackets = sketch.select(F.col("g").alias("bg"), "n", F.array(*[
        F.struct(F.lit(i).alias("i"), F.element_at("e", 2 * i + 1).alias("lo"), F.element_at("e", 2 * i + 2).alias("hi"),
                 ((F.col("n") - 1) * F.lit(p)).alias("h")) for i, p in enumerate(probs)]).alias("b"))
    # one row per group: sent to the rows, which would else meet by group, few groups in as few tasks
    placed = (vals.join(settled(brackets), F.col("g").eqNullSafe(F.col("bg"))).select("g", "v", "n", F.explode("b").alias("b"))
              .select("g", "v", "n", "b.*"))
    side = F.when(F.col("v") < F.col("lo"), BELOW).when(F.col("v") > F.col("hi"), ABOVE).otherwise(INSIDE)
    width = F.col("hi") - F.col("lo")
    cell = F.when((F.col("side") == INSIDE) & (width > 0) & (width < float("inf")),
                  F.floor((F.col("v") - F.col("lo")) / width * CELLS)).otherwise(F.lit(0).cast("bigint"))
    rank_of = ["g", "n", "i", "h"]
    place = ["side", "cell"]
    table = (placed.withColumn("side", side).withColumn("cell", cell)
             .groupBy(*rank_of, *place, F.when(F.col("side") == INSIDE, F.col("v")).alias("inside"))
             .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most")))
    up_to = lambda part, order: F.sum("c").over(
        Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cells = (table.groupBy(*rank_of, *place).agg(F.sum("c").alias("c")).withColumn("stop", up_to(rank_of, place))
             .withColumn("before", F.col("stop") - F.col("c")))
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("stop"))
    wanted = cells.where(holds(F.floor("h")) | holds(F.ceil("h"))).select(
        *[F.col(c).alias(f"w_{c}") for c in ("g", "i", *place)], "before")
    ranked = (table.join(wanted, F.col("g").eqNullSafe(F.col("w_g")) & (F.col("i") == F.col("w_i"))
                         & (F.col("side") == F.col("w_side")) & (F.col("cell") == F.col("w_cell")))
              .repartition("g", "n")  # few rows by now: all further steps share this partitioning
              .withColumn("end", F.col("before") + up_to([*rank_of, *place], ["inside"]))
              .withColumn("start", F.col("end") - F.col("c")))

    def at(rank):
        """The value at a 0-based rank: inside the bracket, or its neighbour on either side."""
        return F.max(F.when((F.col("side") == INSIDE) & (F.col("start") <= rank) & (rank < F.col("end")), F.col("inside"))
                     .when((F.col("side") == BELOW) & (rank == F.col("end") - 1), F.col("most"))
                     .when((F.col("side") == ABOVE) & (rank == F.col("start")), F.col("least")))

    picks = ranked.groupBy(*rank_of).agg(at(F.floor("h")).alias("a"), at(F.ceil("h")).alias("b"))
    q = picks.select("g", "n", "i", (F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a"))).alias("q"))
    return q.groupBy("g", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


def exact_medians(df: DataFrame, cols: Sequence[str], accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """``feature_name, median`` per column (NULL for a column without values)."""
    cols = list(cols)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature_name", "v")
    q = exact_quantiles(long, "v", ["feature_name"], [0.5], accuracy)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature_name string")
    return names.join(q.select("feature_name", F.col("q0").alias("median")), "feature_name", "left")


#: Size of the sketches: their ranks are off by about 2.3 / SKETCH of the rows.
SKETCH = 4096


def median_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A19 in one scan: ``*by, feature_name, sketch``, a mergeable quantile sketch of every column's values
    per group (a fold, a day, a file), of bounded size whatever the rows."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "feature_name", "v")
    return (long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*by, "feature_name")
            .agg(F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("sketch")))


def sketched_medians(sketches: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``*by, feature_name, median`` (approximate) from sketches, merged over whatever ``by`` leaves out."""
    merged = sketches.where(F.col("feature_name").isin(list(names))).groupBy(*by, "feature_name").agg(
        F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select(*by, "feature_name", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("median"))


def training_medians(sketches: DataFrame, fold_col: str, names: Sequence[str], folds: int) -> DataFrame:
    """``fold, feature_name, median`` of the rows outside each fold, from one sketch per (fold, feature): what a
    cross-validation needs, without another scan."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold_col))
    outside = sketches.select(F.explode(others).alias("__outside"), "feature_name", "sketch")
    return sketched_medians(outside, names, ["__outside"]).withColumnRenamed("__outside", fold_col)


def approximate_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature_name, median`` per column by sketch (NULL for a column without values): one scan, no exact pass."""
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature_name string")
    return names.join(sketched_medians(median_sketches(df, cols), cols), "feature_name", "left")
