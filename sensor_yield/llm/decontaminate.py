"""Benchmark decontamination by suffix arrays over shards of the training texts.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is one
window). Documents are read in shards of about ``SHARD_WORDS`` words. In a shard every
position is a suffix; those whose next words form word pairs of the benchmark are sorted by
their first ``WINDOW`` words (a suffix that leaves those pairs at once can hold no window).
Every benchmark suffix is then binary-searched in that array, which yields all its
occurrences; occurrences that follow each other on one diagonal join to the longest verbatim
match, with its place. Documents never meet: the search moves no text between machines.

The benchmark is a stated query set. It travels in blocks of at most ``BLOCK_BYTES`` (counted
by Spark before anything is collected); with several blocks the documents pass through one
search per block and keep the places of all.

Defined cases: null text has no words; null or empty items have no window; items that repeat
an id count once; a null id of an item reads ``null``; rows that repeat a document are judged
alike; empty tables give no rows, or no hits; other columns pass through untouched, also those
with names used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensor_yield.llm.common import arrow_rows
from sensor_yield.llm.files import text_bytes

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
FOUND = "n_words bigint, spans array<struct<begin: bigint, end: bigint>>, items array<string>, " \
        "longest struct<words: bigint, begin: bigint, item: string>"
#: Every byte that is not part of a word becomes a space; A-Z become a-z. Words are runs of
#: 0-9, a-z and all characters beyond ASCII.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """The benchmark's suffixes, ready to be searched: word numbers from 1, word pairs, and per
    distinct window its sorted key, length and the items (with positions) that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.number = window, {}
        numbered = [[self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)] for _, text in items]
        found: dict[bytes, list[tuple[int, int, int]]] = {}
        pairs, single = set(), set()
        for item, ids in enumerate(numbered):
            pairs.update(zip(ids, ids[1:], strict=False))
            if len(ids) == 1:
                single.add(ids[0])
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                part = np.array(ids[at:at + window], ">u4")
                found.setdefault(part.tobytes().ljust(4 * window, b"\0"), []).append((item, at, len(part)))
        self.items = [name for name, _ in items]
        self.base = len(self.number) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), "<i8")
        self.single = np.array(sorted(single), "<i8")
        self.keys = np.array(sorted(found), f"S{4 * window}")
        held = [found[k] for k in sorted(found)]
        self.lengths = np.array([h[0][2] for h in held], "<i8")
        self.first = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype("<i8")
        self.item = np.array([x[0] for h in held for x in h], "<i8")
        self.at = np.array([x[1] for h in held for x in h], "<i8")
        # beyond the last suffix that starts with the window
        self.upper = np.array([k[:4 * n] + b"\xff" * (4 * (window - n)) for k, n in
                               zip(sorted(found), self.lengths.tolist(), strict=True)], f"S{4 * window}")

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of a shard that may hold a window, sorted by their first words."""
        if not len(ids):
            return np.zeros(0, "<i8"), np.zeros(0, f"S{4 * self.window}")
        pair = ids[:-1] * self.base + ids[1:]
        slot = np.searchsorted(self.pairs, pair)
        known = np.zeros(len(ids) + 1, bool)
        if len(self.pairs):
            known[:len(pair)] = self.pairs[np.minimum(slot, len(self.pairs) - 1)] == pair
        several = self.lengths[self.lengths > 1]
        keep = known[:-1].copy()
        for step in range(1, int(several.min()) - 1 if len(several) else 0):
            keep[:-step] &= known[step:-1]
            keep[-step:] = False
        starts = np.flatnonzero(keep | np.isin(ids, self.single))
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        keys = np.stack([padded[starts + j] for j in range(self.window)], axis=1).astype(">u4")
        keys = np.ascontiguousarray(keys).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        return starts[order], keys[order]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences in a shard: place, length, item, position in the item."""
        places, keys = self.suffix_array(ids)
        lo = np.searchsorted(keys, self.keys, "left")
        hi = np.searchsorted(keys, self.upper, "right")
        hit = np.flatnonzero(hi > lo)
        holders = self.first[hit + 1] - self.first[hit]
        found = (hi - lo)[hit]
        each = np.repeat(hit, found * holders)
        inside = np.arange(len(each)) - np.repeat(np.cumsum(found * holders) - found * holders, found * holders)
        per = np.repeat(holders, found * holders)
        holder = self.first[each] + inside % per
        return places[lo[each] + inside // per], self.lengths[each], self.item[holder], self.at[holder]


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text.encode()) for r in block.collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc`` (a struct of the columns of ``docs``), n_words, spans (begin, end of hit words),
    items, and longest (words, begin, item): the longest verbatim match."""
    spark = docs.sparkSession
    arrow_rows(spark)
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    best = pa.struct([("words", pa.int64()), ("begin", pa.int64()), ("item", pa.string())])

    def one_pass(held):
        def judge(w: Windows, batches: list[pa.RecordBatch], texts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            flat = [d for t in texts for d in t]
            gap = np.zeros(1, "<i8")
            shard = np.concatenate([x for d in flat for x in (d, gap)] or [gap])
            begins = np.concatenate([[0], np.cumsum([len(d) + 1 for d in flat])]).astype("<i8")
            place, length, item, at = w.search(shard)
            doc = np.searchsorted(begins, place, "right") - 1
            order = np.lexsort((place, place - at, item))
            place, length, item, at, doc = (x[order] for x in (place, length, item, at, doc))
            # neighbours on a diagonal join to one verbatim match
            new = np.ones(len(place), bool)
            new[1:] = (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) \
                | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1 if len(place) else first
            match = {}
            for d, b, e, i in zip(doc[first].tolist(), place[first].tolist(), (place[last] + length[last]).tolist(),
                                  item[first].tolist(), strict=True):
                match.setdefault(d, []).append((b - int(begins[d]), e - int(begins[d]), w.items[i]))
            n = 0
            for batch, docs_of in zip(batches, texts, strict=True):
                spans, items, longest = [], [], []
                for k in range(len(docs_of)):
                    hits = match.get(n + k, [])
                    merged = []
                    for b, e, _ in sorted(hits):
                        if merged and b <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([b, e])
                    spans.append([{"begin": b, "end": e} for b, e in merged])
                    items.append(sorted({i for *_, i in hits}))
                    top = min(hits, key=lambda h: (h[0] - h[1], h[0], h[2])) if hits else None
                    longest.append(top and {"words": top[1] - top[0], "begin": top[0], "item": top[2]})
                n += len(docs_of)
                c = batch.to_pydict() if "spans" in batch.schema.names else None
                if c:  # an earlier pass has found places of other items
                    spans = [a + b for a, b in zip(c["spans"], spans, strict=True)]
                    items = [a + b for a, b in zip(c["items"], items, strict=True)]
                    longest = [min((x for x in p if x), key=lambda x: (-x["words"], x["begin"], x["item"]), default=None)
                               for p in zip(c["longest"], longest, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), batch.column("text"), pa.array([len(d) for d in docs_of], pa.int64()),
                     pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string())), pa.array(longest, best)],
                    ["doc", "text", "n_words", "spans", "items", "longest"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = Windows(held.value, window)
            get = w.number.get
            waiting, texts, size = [], [], 0
            for batch in batches:
                ids = [np.array([get(x, 0) for x in words_of(t)], "<i8") for t in text_bytes(batch.column("text"))]
                waiting.append(batch)
                texts.append(ids)
                size += sum(map(len, ids))
                if size >= SHARD_WORDS:
                    yield from judge(w, waiting, texts)
                    waiting, texts, size = [], [], 0
            if waiting:
                yield from judge(w, waiting, texts)

        return run

    rows = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    wanted = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(FOUND).fields])
    for block in _passes(benchmark, item_col, item_text_col):
        rows = rows.mapInArrow(one_pass(spark.sparkContext.broadcast(block)), wanted)
    return rows.drop("text")


def hit_words(spans: str) -> Column:
    """Number of words covered by spans that may overlap."""
    return F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["begin"]))).alias("n")),
        lambda a: a["n"])


def report(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    longest_match, longest_begin."""
    items = F.array_sort(F.array_distinct("items"))
    n_hit = hit_words("spans")
    return matches.select(
        F.col(f"doc.{id_col}").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.coalesce("longest.words", F.lit(0)).alias("longest_match"), F.col("longest.begin").alias("longest_begin"))


def clean(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    return find_matches(docs, benchmark, **columns).where(F.size("spans") == 0).select("doc.*")
