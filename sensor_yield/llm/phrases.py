"""Phrase collocations by an FM-index per shard over word ids.

1. Texts become shards of up to ``SHARD_BYTES`` of one language: lower-cased words as ids into the
   shard's own word list, 0 between pieces. Longer texts are cut between words; the next shard begins with
   the ``max_words - 1`` words before the cut, whose own occurrences it does not count again.
2. Word counts are summed over shards. Words below ``min_count`` cannot be in a phrase that reaches it, so
   they become breaks; the others get a number for all shards.
3. Level by level, a bidirectional FM-index of each shard (``phrase_index``) enumerates its phrases of k
   words with counts: words extended right, then left, and so on. Counts are summed over shards and phrases
   below ``min_count`` go. From three words on a phrase is only enumerated if its first and its last
   k - 1 words may reach ``min_count``: a Bloom filter of those that do, of at most ``FILTER_BITS`` bits,
   says so. It only saves work; sums decide.
4. Every cut of a phrase finds the counts of its two parts by equi-joins; products are exact decimals. The
   commonest one-word extensions to the left and right are grouped maxima.
5. The first ``top`` of a language are taken in parts by hash and then among the parts' firsts.

Defined cases: null text is empty; null language is ``und``; repeated rows count each; a language without
candidates has no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensor_yield.llm.common import arrow_rows, process_cache, stored
from sensor_yield.llm.files import resolve, text_bytes
from sensor_yield.llm.phrase_index import BidirectionalIndex
from sensor_yield.operators.ordering import ordinal_within_group

#: Bytes of text in a shard: some million words.
SHARD_BYTES = 7 << 20
FILTER_BITS = 1 << 28
BITS_PER_PHRASE = 16
PROBES = 4

BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(BREAKS) + b" ")
GAP = re.compile(rb"[ \n]")

SHARDS = "lang string, context int, words array<string>, counts array<bigint>, ids binary"


def packed(ids: np.ndarray) -> bytes:
    """Ids below 2^31 by their four byte planes, compressed."""
    return zstandard.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def segments(text: bytes, limit: int, context: int) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts of about ``limit`` bytes, cut between words, each with how many words of
    the part before it begin it (at most ``context``, none across a break)."""
    carried: list[bytes] = []
    at = 0
    while True:
        gap = GAP.search(text, at + limit) if len(text) - at > limit else None
        end = gap.start() if gap else len(text)
        yield b" ".join([*carried, text[at:end]]), len(carried)
        if gap is None:
            return
        broken = text.rfind(b"\n", at, end)
        words = [w for w in text[max(broken + 1, at):end].split(b" ") if w]
        carried = ((carried if broken < 0 else []) + words)[max(0, len(words) + (len(carried) if broken < 0 else 0) - context):]
        at = end


def shard_row(lang: str, blob: bytes, context: int) -> pa.RecordBatch | None:
    tokens = pc.split_pattern(pa.array([blob.replace(b"\n", b" \n ")], pa.large_binary()), b" ").values.dictionary_encode()
    words = tokens.dictionary.to_pylist()
    is_word = np.array([w not in (b"", b"\n") for w in words], bool)
    is_break = np.array([w == b"\n" for w in words], bool)
    if not is_word.any():
        return None
    numbers = np.where(is_word, np.cumsum(is_word), 0)
    at = tokens.indices.to_numpy()
    ids = numbers[at][is_word[at] | is_break[at]]
    counts = np.bincount(ids[context:], minlength=int(is_word.sum()) + 1)[1:]
    return pa.RecordBatch.from_arrays([
        pa.array([lang]), pa.array([context], pa.int32()),
        pa.array([[w for w, real in zip(words, is_word) if real]], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
        pa.array([counts], pa.list_(pa.int64())), pa.array([packed(ids)])],
        names=["lang", "context", "words", "counts", "ids"])


def _shards(limit: int, context: int):
    def build(batches):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        total = 0

        def shard(lang):
            return shard_row(lang, b"\n".join(held.pop(lang)), 0)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                text = text.translate(FOLDED)
                if len(text) > limit:
                    yield from filter(None, (shard_row(lang, *s) for s in segments(text, limit, context)))
                    continue
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                total += len(text) + 1
                while total > limit:
                    largest = max(size, key=size.get)
                    total -= size.pop(largest)
                    yield from filter(None, [shard(largest)])
        yield from filter(None, map(shard, list(held)))

    return build


def shard_table(docs: DataFrame, max_words: int, text_col: str, lang_col: str, shard_bytes: int) -> DataFrame:
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col))
    return stored(texts.mapInArrow(_shards(shard_bytes, max_words - 1), SHARDS)
                  .withColumn("shard", F.monotonically_increasing_id()), "phrase-shards")


def mixed(words: np.ndarray) -> np.ndarray:
    """Rows of word numbers to 64 evenly spread bits."""
    h = np.zeros(len(words), np.uint64)
    for column in words.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def probes(words: np.ndarray, bits: int) -> np.ndarray:
    h = mixed(words)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]).astype(np.int64)


class Filter:
    """A Bloom filter in the shared folder: Parquet rows of 64-bit words, read once per Python process."""

    def __init__(self, phrases: DataFrame, names: list[str]):
        n = phrases.count()
        self.bits = min(FILTER_BITS, max(1 << 16, 1 << (n * BITS_PER_PHRASE).bit_length()))
        bits = self.bits

        def set_bits(batches):
            for batch in batches:
                at = np.unique(probes(np.column_stack([c.to_numpy() for c in batch.columns]), bits)) if len(batch) else []
                at = np.asarray(at, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(
                    (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["at", "bits"])

        table = phrases.select(*names).mapInArrow(set_bits, "at bigint, bits bigint")
        self.path = stored(table.groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")), "phrase-filter").inputFiles()

    def array(self) -> np.ndarray:
        cache = process_cache()
        key = ("phrase-filter", tuple(self.path[:1]), len(self.path))
        if key not in cache:
            for old in [k for k in cache if isinstance(k, tuple) and k[0] == "phrase-filter"]:
                del cache[old]
            bits = np.zeros(self.bits >> 6, np.uint64)
            if self.path:
                found = [resolve(p) for p in self.path]
                for batch in ds.dataset([p for _, p in found], filesystem=found[0][0], format="parquet").to_batches():
                    bits[batch["at"].to_numpy()] = batch["bits"].to_numpy().view(np.uint64)
            cache[key] = bits
        return cache[key]

    def holds(self, words: np.ndarray) -> np.ndarray:
        bits, out = self.array(), np.ones(len(words), bool)
        for s in range(0, len(words), 1 << 16):
            at = probes(words[s:s + (1 << 16)], self.bits)
            out[s:s + (1 << 16)] = ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
        return out


def _counted(k: int, filters: dict[int, Filter]):
    """Phrases of ``k`` words with their counts in each shard, by word numbers of all shards."""
    def allowed(words: np.ndarray) -> np.ndarray:
        """Whether phrases may be frequent: by their own filter, else by that of their first and last words."""
        size = words.shape[1]
        if size in filters and len(words):
            return filters[size].holds(words)
        held = filters.get(size - 1)
        if held is None or not len(words):
            return np.ones(len(words), bool)
        ok = held.holds(words[:, :-1])
        ok[ok] = held.holds(words[ok, 1:])
        return ok

    def enumerate_shard(ids: np.ndarray, context: int):
        known, local = np.unique(np.append(ids, 0), return_inverse=True)  # break is 0 in both
        index = BidirectionalIndex(local[:-1], k)
        found = index.words()
        for step in range(1, k):
            found = index.extend_right(found) if step % 2 else index.extend_left(found)
            found = found.where(allowed(known[found.words]))
        yield known[found.words], found.size
        again = [ids[s:s + k] for s in range(context - k + 1) if ids[s:s + k].all()]
        if again:
            again = np.array(again)
            again = again[allowed(again)]
            yield again, np.full(len(again), -1)

    def count(batches):
        for batch in batches:
            for context, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words, n in enumerate_shard(unpacked(data.as_buffer().to_pybytes()), context):
                    for s in range(0, len(n), 1 << 17):
                        cut = words[s:s + (1 << 17)].astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(np.ascontiguousarray(c)) for c in cut.T), pa.array(n[s:s + (1 << 17)].astype(np.int64))],
                            names=[*(f"w{i}" for i in range(k)), "n"])

    return count


def _renumber(batches):
    """Shards by word numbers of all shards; words without one become breaks."""
    for batch in batches:
        for context, data, size, at, number in zip(*(c for c in batch.columns)):
            numbers = np.zeros(size.as_py() + 1, np.int64)
            if at.is_valid:
                numbers[at.values.to_numpy() + 1] = number.values.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([context.as_py()], pa.int32()), pa.array([packed(
                numbers[unpacked(data.as_buffer().to_pybytes())])])], names=["context", "ids"])


def _names(k: int, start: int = 0) -> list[str]:
    return [f"w{i}" for i in range(start, start + k)]


def _summed(rows: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def count_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang",
                  shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, dict[int, DataFrame]]:
    """(all words of each language: lang, total), (frequent words: lang, word, n, id) and per number of words the
    phrases with at least ``min_count`` occurrences: w0 ... (word ids), n."""
    spark = docs.sparkSession
    arrow_rows(spark)
    shards = shard_table(docs, max_words, text_col, lang_col, shard_bytes)
    listed = (shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry"))
              .select("shard", "lang", "at", F.col("entry.words").alias("word"), F.col("entry.counts").alias("n")))
    totals = stored(listed.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    words = stored(_summed(listed, ["lang", "word"], min_count), "phrase-words")
    words = stored(ordinal_within_group(words, [], ["lang", "word"], "id").withColumn("id", F.col("id").cast("int")),
                   "phrase-numbers")
    numbers = (listed.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard")
               .agg(F.collect_list(F.struct("at", "id")).alias("known")))
    joined = shards.select("shard", "context", "ids", F.size("words").alias("size")).join(numbers, "shard", "left")
    renumbered = stored(joined.select("context", "ids", "size", "known.at", "known.id")
                        .mapInArrow(_renumber, "context int, ids binary"), "phrase-ids")
    levels = {1: words.select(F.col("id").alias("w0"), "n")}
    filters: dict[int, Filter] = {}
    for k in range(2, max_words + 1):
        schema = ", ".join([*(f"{c} int" for c in _names(k)), "n bigint"])
        levels[k] = stored(_summed(renumbered.mapInArrow(_counted(k, filters), schema), _names(k), min_count),
                           f"phrase-counts-{k}")
        if k < max_words:
            filters[k] = Filter(levels[k], _names(k))
    return totals, words, levels


def _with_parts(level: DataFrame, k: int, cut: int, levels: dict[int, DataFrame]) -> DataFrame:
    """The phrases with the counts l and r of their first ``cut`` words and of the rest."""
    def part(size: int, start: int, name: str) -> DataFrame:
        return levels[size].select(*[F.col(f"w{i}").alias(f"w{start + i}") for i in range(size)], F.col("n").alias(name))

    return (level.join(part(cut, 0, "l"), _names(cut)).join(part(k - cut, cut, "r"), _names(k - cut, cut))
            .withColumn("cut", F.lit(cut)))


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    wide = lambda c: c.cast("decimal(19,0)")
    # a x a x 10^6 fits in 38 digits for counts up to 10^16
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(10 ** 6).cast("decimal(7,0)"),
                           wide(l) * wide(r))


def candidates(levels: dict[int, DataFrame], share: int = 50) -> dict[int, DataFrame]:
    """Per number of words: w0 ..., a, l, r, score (of the lowest cut), left_n and right_n (the commonest extension by
    one word, 0 if none) and dropped (a longer candidate with at least ``share`` % of a holds the phrase; a phrase
    longer by one word is at least as frequent as any that holds it, so these decide)."""
    out = {}
    for k in (k for k in levels if k > 1):
        keys = _names(k)
        level = levels[k].withColumnRenamed("n", "a")
        cuts = [_with_parts(level, k, cut, levels) for cut in range(1, k)]
        scored = reduce(DataFrame.unionByName, cuts).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
        best = (scored.groupBy(*keys).agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("b"))
                .select(*keys, "a", "b.l", "b.r", "b.score"))
        sides = ["left_n", "right_n"]
        if k + 1 in levels:
            inner = lambda start, side: levels[k + 1].select(
                *[F.col(f"w{start + i}").alias(f"w{i}") for i in range(k)],
                *[(F.col("n") if c == side else F.lit(0).cast("bigint")).alias(c) for c in sides])
            around = (inner(0, "right_n").unionByName(inner(1, "left_n")).groupBy(*keys)
                      .agg(*[F.max(c).alias(c) for c in sides]))
            best = best.join(around, keys, "left").na.fill(0, sides)
        else:
            best = best.select("*", *[F.lit(0).cast("bigint").alias(c) for c in sides])
        out[k] = best.withColumn("dropped", (F.greatest(*sides) > 0) & (F.greatest(*sides) * 100 >= F.col("a") * share))
    return out


def _in_words(level: DataFrame, k: int, words: DataFrame) -> DataFrame:
    """lang and the phrase as a string; words are joined in one by one."""
    out = level
    for i in range(k):
        named = words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), *(["lang"] if i == 0 else []))
        out = out.join(named, f"w{i}")
    return out.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(k)])).drop(
        *_names(k), *[f"word{i}" for i in range(k)])


def first_of(rows: DataFrame, group: str, order: list[Column], tie: str, top: int) -> DataFrame:
    """The first ``top`` rows of each group with their ``rank``: in parts by hash first, then the parts' first ones. With
    sqrt(rows / top) parts both steps hold sqrt(rows x top) rows of a group at most."""
    parts = max(1, isqrt(rows.count() // top))
    salted = rows.withColumn("__part", F.pmod(F.xxhash64(tie), F.lit(parts)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    inside = salted.withColumn("rank", rank(group, "__part")).where(F.col("rank") <= top).drop("rank", "__part")
    return inside.withColumn("rank", rank(group)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, share: int = 50,
                 text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, left_n, right_n."""
    totals, words, levels = count_phrases(docs, max_words, min_count, text_col, lang_col, shard_bytes)
    found = None
    for k, level in candidates(levels, share).items():
        named = _in_words(level.where("NOT dropped").drop("dropped"), k, words)
        found = named if found is None else found.unionByName(named)
    first = first_of(stored(found, "phrase-found"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score",
                                             "left_n", "right_n")
