"""The mixing stage: amounts with rows that repeat, further columns, the schedule and its order."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sensor_yield.llm import mixing


def size(text):
    return len(text.split())


@pytest.mark.parametrize("doc_id", [5000, 1, None])
def test_one_row_repeated_600_times(spark, tmp_path, doc_id):
    """Words taken stay within one document of the target, wherever the repeated rows fall."""
    rows = [(i, " ".join(["w"] * (10 + i % 21)), "a") for i in range(600)] + [(doc_id, "one of many " * 5, "a")] * 600
    rows += [(10_000 + i, "x y z " * 40, "b") for i in range(50)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    targets = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    got = mixing.mixed_rows(docs).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += size(r.text)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(size(t) for _, t, s in rows if s == source)
    have = Counter(rows)
    assert all(n <= 2 * have[r] for r, n in Counter((r.doc_id, r.text, r.source) for r in got).items())


def test_further_columns_stay(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(1, "a b", "s", 7), (1, "a b", "s", 8), (2, None, "s", 9), (None, "c", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").write.parquet(path)
    docs = spark.read.parquet(path)
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert got.where(F.col("text").isNull()).count() == 0


def test_mix_follows_the_schedule(spark, tmp_path):
    """Documents stand in the order of the slots of the schedule's blocks, both passes, each block whole."""
    rows = [(i, "w " * (3 + i % 5), "pqr"[i % 3]) for i in range(900)] + [(7000, "all alike", "p")] * 90
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    got = [(r.doc_id, r.text, r.source) for r in mixing.mixed_rows(docs, n_slots=300).collect()]

    sized = mixing.sized_rows(docs)
    targets = mixing.source_targets(sized).cache()
    total = targets.first().total
    block = -(-total // 300)
    slots = {(r.source, r.block): r.slot for r in mixing.schedule(targets, block, -(-total // block)).collect()}
    words = {r.source: (r.words, r.source_size) for r in targets.collect()}
    text = {r[0]: r[1] for r in rows}
    want, at = [], Counter()
    for r in sorted(sized.collect(), key=lambda r: (r.key, r.doc_id)):
        begin, (most, size) = at[r.source], words[r.source]
        at[r.source] += r.size
        for start in (begin, begin + size):
            if 2 * start + r.size <= 2 * most:
                want.append((slots[r.source, (start + (r.size - 1) // 2) // block], (r.doc_id, text[r.doc_id], r.source)))
    assert Counter(got) == Counter(w for _, w in want)
    left: dict = {}
    for slot, row in want:
        left.setdefault(slot, Counter())[row] += 1
    slot_order, i = sorted(left), 0
    for slot in slot_order:  # inside a slot any order will do
        n = left[slot].total()
        assert Counter(got[i:i + n]) == left[slot]
        i += n


def test_sources_of_one_document(spark, tmp_path):
    """Sources that fill one slot at most, and a table of nothing but empty texts."""
    path = str(tmp_path / "docs")
    rows = [(1, "a b c", "s"), (2, "d", "t"), (3, None, "u")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    docs = spark.read.parquet(path)
    assert {tuple(r) for r in mixing.mixed_rows(docs).collect()} <= set(rows[:2])
    assert mixing.mixed_rows(docs.where("doc_id = 3")).count() == 0
