"""Phrase mining: the index against plain counting, cuts of long texts, defined cases, the whole query."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from sensor_yield.llm import phrases
from sensor_yield.llm.phrase_index import BidirectionalIndex

from . import brute

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def noise(rng, n, vocab="abcdefgh", breaks=0.1):
    return "".join(rng.choice(vocab) + (rng.choice([". ", "\n", "! "]) if rng.random() < breaks else " ") for _ in range(n))


@pytest.mark.parametrize("depth", [2, 3, 5])
@pytest.mark.parametrize("order", ["rrrr", "llll", "rlrl", "lrrl"])
def test_index_counts_every_phrase(depth, order):
    rng = np.random.default_rng(depth)
    ids = rng.integers(0, 5, 400)
    index = BidirectionalIndex(ids, depth)
    found = index.words()
    for k in range(2, depth + 1):
        found = index.extend_right(found) if order[k - 2] == "r" else index.extend_left(found)
        grams = Counter(tuple(ids[s:s + k].tolist()) for s in range(len(ids) - k + 1))
        want = {g: c for g, c in grams.items() if 0 not in g}
        assert {tuple(w): c for w, c in zip(found.words.tolist(), found.size.tolist())} == want
        assert len(found.size) == len(want)


def test_index_of_many_ids_ranks_between_rounds():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 3000)
    ids[::7] = 3
    index = BidirectionalIndex(ids, 5)
    found = index.extend_left(index.extend_right(index.words()))
    assert len(found.size) == len({tuple(ids[s:s + 3].tolist()) for s in range(len(ids) - 2) if ids[s:s + 3].all()})


def test_empty_index():
    found = BidirectionalIndex(np.zeros(0, np.int64), 3).words()
    assert len(found.size) == 0


def test_segments_keep_words_and_context():
    text = b"aa bb\ncc dd ee ff gg hhhhhhhhhhhhhhhhhhhh ii jj"
    parts = list(phrases.segments(text, 6, 2))
    assert b" ".join(b" ".join(p.replace(b"\n", b" ").split()[c:]) for p, c in parts) == text.replace(b"\n", b" ")
    assert parts[0][1] == 0 and max(c for _, c in parts) == 2
    for p, c in parts[1:]:
        assert b"\n" not in b" ".join(p.split(b" ")[:c])


def test_packing():
    ids = np.array([0, 1, 255, 256, 70000, (1 << 31) - 1])
    assert phrases.unpacked(phrases.packed(ids)).tolist() == ids.tolist()
    assert phrases.unpacked(phrases.packed(ids[:0])).tolist() == []


@pytest.mark.parametrize("shard_bytes", [40, 3000, phrases.SHARD_BYTES])
def test_equals_counting_whatever_the_shards(spark, shard_bytes):
    rng = random.Random(shard_bytes)
    rows = [(noise(rng, rng.choice([0, 3, 40, 900]), breaks=rng.choice([0, 0.05, 0.3])), rng.choice(["en", "de", None]))
            for _ in range(25)]
    rows += [(None, "en"), ("", None), ("A b\tC d", "en"), ("A b\tC d", "en"), ("É é É é " * 12, "fr"), ("x" * 500, "xx")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n int").repartition(3)
    assert result(phrases.collocations(docs, shard_bytes=shard_bytes)) == sorted(brute.collocations(rows))


def test_four_words_ties_and_top(spark):
    rng = random.Random(4)
    rows = [(noise(rng, 700, "abcd"), "en"), (noise(rng, 300, "abcd"), "und"), (noise(rng, 50, "ab"), None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = phrases.collocations(docs, max_words=4, min_count=5, top=7, shard_bytes=500)
    assert result(got) == sorted(brute.collocations(rows, 4, 5, 7))


def test_scores_beyond_64_bits(spark):
    level = {1: [(1, 3 * 10 ** 12), (2, 2 * 10 ** 12)], 2: [(1, 2, 10 ** 12 + 7)]}
    levels = {k: spark.createDataFrame(v, ", ".join([*(f"w{i} int" for i in range(k)), "n bigint"])) for k, v in level.items()}
    row = phrases.candidates(levels)[2].first()
    assert row.score == 10 ** 6 * (10 ** 12 + 7) ** 2 // (6 * 10 ** 24)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0


def test_filter_lets_frequent_phrases_pass(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)  # all probes hit: nothing saved, nothing lost
    rows = [(noise(random.Random(8), 2000), "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert result(phrases.collocations(docs)) == sorted(brute.collocations(rows))
