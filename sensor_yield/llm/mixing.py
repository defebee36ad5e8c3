"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share
``share`` (150 %) of all words; a target stops at twice its source's size and the excess is
reshared by weight. That is a water level L with target = min(2 size, L weight), found from
one sorted pass over the per-source table.

Schedule: slot i is the golden-ratio point frac(i phi), an exact permutation of 2^31 lattice
points; it falls into the cumulative targets and so belongs to one source. Slots are ranked
per source and the r-th slot of a source takes the r-th block of its shuffled documents, laid
end to end (twice round at most). Blocks have equal numbers of words; the last one of a source
ends at the target, and blocks for which the finite schedule had no slot follow at its end, so
each source's words meet the target to the word.

Nothing depends on a group meeting in one task: ranks and positions are running sums over
hash buckets (``common.running_sum``); tables handled in one task have one row per source.

Defined cases: null text has size 0; documents of size 0 are never taken; null ids and
sources are values like others; rows alike in id, source and text are interchangeable; an
empty table gives no rows; other columns are ignored (``mixed_rows`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensor_yield.llm.common import running_sum, stored, task_count
from sensor_yield.llm.sharding import numbered

WEIGHTS = (5, 2, 1)
LATTICE = 1 << 31
#: 2^31 / phi rounded to an odd number: i * GOLDEN mod 2^31 is a permutation of the lattice.
GOLDEN = 1327217885
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def shuffle_key(id_col: str, source_col: str, text_col: str, seed: int) -> Column:
    """63 evenly spread bits that depend on the row alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)), 1)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target (double), words (the target as a whole number), and the
    source's interval [lo, hi) of the lattice. One row per source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    code_point = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.select(
        "*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.row_number().over(code_point) - 1) % len(weights) + 1).alias("weight"))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    done = F.coalesce(F.sum("source_size").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))
    water = ranked.select("*", F.row_number().over(level).alias("at"),
                          ((share * F.sum("source_size").over(everything) - limit * done) / open_).alias("level"))
    fits = F.col("level") <= limit * F.col("source_size") / F.col("weight") * (1 + 1e-12)
    first = F.min(F.when(fits, F.struct("at", "level"))).over(everything)
    target = F.least(limit * F.col("source_size"), first["level"] * F.col("weight"))
    out = water.select("source", "source_size", target.alias("target"))
    out = out.select("*", F.least(F.round("target"), F.floor(limit * F.col("source_size"))).cast("bigint").alias("words"))
    upto = F.sum("words").over(code_point.rowsBetween(Window.unboundedPreceding, 0))
    total = F.greatest(F.sum("words").over(everything), F.lit(1))
    lattice = lambda x: F.floor(x.cast("double") / total * LATTICE).cast("bigint")
    return out.select("*", lattice(upto - F.col("words")).alias("lo"), lattice(upto).alias("hi"),
                      total.alias("total"))


def schedule(targets: DataFrame, block_words: int, n_slots: int) -> DataFrame:
    """source, block, slot: the order in which the sources' blocks are taken."""
    spark = targets.sparkSession
    width = LATTICE // CELLS
    point = F.pmod(F.pmod(F.col("slot"), F.lit(LATTICE)) * GOLDEN, F.lit(LATTICE))
    points = (spark.range(n_slots).withColumnRenamed("id", "slot").select("slot", point.alias("point"))
              .withColumn("cell", F.floor(F.col("point") / width)))
    cells = targets.where("hi > lo").select(
        "source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
        .alias("cell"))
    owned = (points.join(cells, "cell").where("point >= lo AND point < hi")
             .select("source", "slot", (F.col("slot") * (((1 << 63) - 1) // max(1, n_slots))).alias("spread"),
                     F.lit(1).cast("bigint").alias("one")))
    ranked = running_sum(owned, ["source"], ["spread", "slot"], "one", "block")
    blocks = targets.where("words > 0").select("source", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("words") - 1) / block_words))).alias("block"))
    return (blocks.alias("b").join(ranked.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))
                                   & (F.col("b.block") == F.col("s.block")), "left")
            .select("b.source", "b.block", F.coalesce("s.slot", F.lit(n_slots) + F.col("b.block")).alias("slot")))


def _placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Every document with its position in its source's shuffled order and the source's figures."""
    placed = running_sum(sized, ["source"], ["key", "doc_id"], "size", "begin")
    return placed.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", "t.source_size", "t.target", "t.words")


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               seed: int = 9) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"),
                       shuffle_key(id_col, source_col, text_col, seed).alias("key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        n_slots: int = 1 << 16, seed: int = 9) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, first_slot (where in the
    mix it first comes up). ``n_slots`` is the resolution of the schedule: a block holds that
    share of all target words."""
    sized = stored(sized_rows(docs, id_col, text_col, source_col, seed), "mix-sizes")
    targets = stored(source_targets(sized), "mix-targets")
    total = targets.agg(F.max("total")).first()[0] or 1
    block_words = max(1, -(-int(total) // n_slots))
    slots = schedule(targets, block_words, -(-int(total) // block_words))

    placed = stored(_placed(sized, targets), "mix-places")
    ends = lambda r: F.least(F.col("begin") + F.col("size") + r * F.col("source_size"), F.col("words"))
    starts = lambda r: F.col("begin") + r * F.col("source_size")

    def pieces(r: int) -> Column:
        blocks = F.when(starts(r) < F.col("words"), F.sequence(
            F.floor(starts(r) / block_words), F.floor((ends(r) - 1) / block_words)))
        return F.transform(F.coalesce(blocks, F.array().cast("array<bigint>")), lambda b: F.struct(
            b.alias("block"),
            (F.least(ends(r), (b + 1) * block_words) - F.greatest(starts(r), b * block_words)).alias("n")))

    cut = (placed.where("size > 0").select("*", F.explode_outer(F.concat(pieces(0), pieces(1))).alias("piece"))
           .select("*", "piece.block", "piece.n").drop("piece"))
    joined = cut.alias("c").join(slots.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))
                                 & (F.col("c.block") == F.col("s.block")), "left")
    keys = ["doc_id", "source", "size", "source_size", "target", "begin"]
    taken = (joined.select(*[F.col(f"c.{k}") for k in keys], F.when(F.col("s.slot").isNotNull(), F.col("c.n")).alias("n"),
                           "s.slot")
             .groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("taken"),
                                 F.min("slot").alias("first_slot")).drop("begin"))
    empty = placed.where("size = 0").select("doc_id", "source", "size", "source_size", "target",
                                            F.lit(0).cast("bigint").alias("taken"),
                                            F.lit(None).cast("bigint").alias("first_slot"))
    return taken.unionByName(empty)


def _turns(sized: DataFrame, targets: DataFrame, slots: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Which stretch of a source's shuffled order is taken in which slot, for passes 0 and 1. A
    pass takes the documents of which at least half lies before the target; a document belongs
    to the block that holds its middle word. Blocks follow the order, so that

    * ``stretches`` (source, pass, slot, lo, hi) has the first and last key of each block,
    * ``shared`` (key, pass, slot, from, upto, n) the rows, by their place among rows of one key,
      of keys that a block's or the target's end cuts, in any pass.

    Both have about as many rows as there are slots, however many documents there are."""
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))
    placed, blocks = _placed(sized, targets), []
    for r in (0, 1):
        begin = F.col("begin") + r * F.col("source_size")
        blocks.append(F.when(begin * 2 + F.col("size") <= 2 * F.col("words"),
                             div(begin + div(F.col("size") - 1, 2), block_words)))
    placed = stored(placed.select("source", "key", *[b.alias(f"b{r}") for r, b in enumerate(blocks)]), "mix-places")
    whole = [(F.count(f"b{r}") == 0) | ((F.count(f"b{r}") == F.count(F.lit(1))) & (F.min(f"b{r}") == F.max(f"b{r}")))
             for r in (0, 1)]
    keys = stored(placed.groupBy("source", "key").agg(*[F.min(f"b{r}").alias(f"b{r}") for r in (0, 1)],
                                                      (whole[0] & whole[1]).alias("whole")), "mix-keys")
    passes = F.inline(F.array(*[F.struct(F.lit(r).alias("pass"), F.col(f"b{r}").alias("block")) for r in (0, 1)]))

    def with_slots(df: DataFrame) -> DataFrame:
        on = F.col("t.source").eqNullSafe(F.col("s.source")) & (F.col("t.block") == F.col("s.block"))
        return df.alias("t").join(slots.alias("s"), on).select("t.*", "s.slot").drop("block")

    stretches = keys.where("whole").select("source", "key", passes).where("block IS NOT NULL").groupBy(
        "source", "pass", "block").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    cut = keys.where("NOT whole").select(F.col("source").alias("__s"), F.col("key").alias("__k"))
    among = Window.partitionBy("source", "key", "pass")
    shared = (placed.join(cut, (F.col("key") == F.col("__k")) & F.col("source").eqNullSafe(F.col("__s")))
              .select("source", "key", passes).groupBy("source", "key", "pass", "block")
              .agg(F.count(F.lit(1)).alias("c")).where("block IS NOT NULL")
              .withColumn("upto", F.sum("c").over(among.orderBy("block"))).withColumn("n", F.sum("c").over(among))
              .withColumn("from", F.col("upto") - F.col("c")).drop("c"))
    return stored(with_slots(stretches), "mix-stretches"), stored(with_slots(shared), "mix-shared")


#: Words of a task that puts whole documents in order (some 25 MB).
TASK_WORDS = 4_000_000


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               n_slots: int = 1 << 16, seed: int = 9) -> DataFrame:
    """The mix as whole documents with their own columns, in the order of the schedule's slots,
    taken once or twice: a document stands in the slot of the block that holds its middle word,
    in each pass that takes it (``_turns``). Rows find their slots by their shuffle key in tables
    of about ``n_slots`` rows, so texts move only once, into the order of the slots. Rows alike
    are interchangeable: only those whose key a block's end cuts are ranked, over all tasks. Empty
    documents, of which the mix takes nothing, go. ``docs`` is read from files."""
    sized = stored(sized_rows(docs, id_col, text_col, source_col, seed).where("size > 0"), "mix-sizes")
    targets = stored(source_targets(sized), "mix-targets")
    total = int(targets.agg(F.max("total")).first()[0] or 1)
    block_words = max(1, -(-total // n_slots))
    n_slots = -(-total // block_words)
    slots = stored(schedule(targets, block_words, n_slots), "mix-slots")
    stretches, shared = _turns(sized, targets, slots, block_words)

    # cells of equal width, about one a block, lead from a key (or a place) to the few stretches that may hold it
    div = lambda a, b: F.call_function("div", a, b)
    most = F.lit((1 << 63) - 1)
    cells = lambda lo, hi, step: F.explode(F.sequence(div(lo, step), div(hi, step)))
    steps = stored(stretches.groupBy(F.col("source").alias("__source")).agg(
        (div(most, F.count(F.lit(1)) + 1) + 1).alias("__step")), "mix-steps")
    held = (stretches.join(steps, F.col("source").eqNullSafe(F.col("__source")))
            .select(F.col("source").alias("__at"), "slot", "lo", "hi", cells(F.col("lo"), F.col("hi"), F.col("__step")).alias("__cell")))
    held = stored(held, "mix-held")
    rows = docs.select(F.struct("*").alias("doc"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"),
                       shuffle_key(id_col, source_col, text_col, seed).alias("key")).where("size > 0").drop("size")

    found = rows.join(steps, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
        "__near", div(F.col("key"), F.col("__step")))
    taken = found.join(held, F.col("source").eqNullSafe(F.col("__at")) & (F.col("__near") == F.col("__cell"))
                       & (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))).select("doc", "key", "slot")
    if not shared.isEmpty():
        among = Window.partitionBy("key", "pass")
        widths = shared.withColumn("__step", div(F.max("n").over(among), F.count(F.lit(1)).over(among)) + 1)
        steps = stored(widths.groupBy("key").agg(F.max("__step").alias("__step")), "mix-shared-steps")
        held = stored(shared.join(steps, "key").select("key", "slot", "from", "upto", cells(
            F.col("from"), F.col("upto") - 1, F.col("__step")).alias("__cell")), "mix-shared-held")
        ranked, _ = numbered(rows.join(steps, "key"), ["key"], "__rank")
        first = stored(ranked.groupBy("key").agg(F.min("__rank").alias("__first")), "mix-shared-first")
        nth = ranked.join(first, "key").withColumn("__nth", F.col("__rank") - F.col("__first")).withColumn(
            "__cell", div(F.col("__nth"), F.col("__step")))
        more = nth.join(held, ["key", "__cell"]).where("__nth >= `from` AND __nth < upto").select("doc", "key", "slot")
        taken = taken.unionByName(more)
    n_tasks = task_count(-(-total // TASK_WORDS))
    # blocks that came too late for a slot follow at the end
    task = F.least(div(F.col("slot") * n_tasks, F.lit(n_slots).cast("bigint")), F.lit(n_tasks - 1)).cast("int")
    return taken.repartitionById(n_tasks, task).sortWithinPartitions("slot", "key").select("doc.*")
