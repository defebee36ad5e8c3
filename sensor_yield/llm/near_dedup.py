"""MinHash near-duplicates: one-permutation hashing, banded buckets, star edges, exact links.

A document's set holds its distinct shingles of five words (fewer words: the whole sequence as
one). One permutation sorts the shingle hashes; their top bits choose one of ``BINS`` bins and
each bin keeps its smallest hash. Empty bins are densified optimally: every bin has its own
random order of the others and copies the first that is not empty. ``BANDS`` bands of ``ROWS``
bins give the bucket keys. A pair at the threshold (similarity 0.75) shares no bucket with
probability (1 - 0.75^5)^48 = 2e-6, and one above it less.

Sets that are equal form classes first, so copies cost one row per task. In a bucket the
smallest class is the centre of a star: its members become candidate edges to it, as many as
the bucket has members. Candidates are confirmed on the full sets. A star can miss a link
between two members that do not link to its centre; so, while confirmed links leave a bucket of
three or more with several components, it gets another centre, and then the members of such
buckets are joined exactly, across components, by prefixes of their rarest shingles
(``prefix_pairs``). No bucket is capped, and neither pairs inside a component nor pairs that
share only what many documents share are ever listed.

Components come from alternating large-star and small-star steps on the confirmed links.

Defined cases: null, empty or blank text has an empty set and links with nothing; a row
without doc_id links like others, has the component's smallest id, and is kept only where no
row of its component has an id; rows that share a doc_id count as one document; an empty table
gives no rows; other columns are ignored (``deduplicated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensor_yield.llm.common import arrow_rows, stored
from sensor_yield.llm.files import text_bytes

SHINGLE = 5
ROWS, BANDS = 5, 48
BINS = ROWS * BANDS
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Further centres for buckets that still hold several components.
ROUNDS = 1
NO_ID = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (a public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of several runs, one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text, by whole-array steps over its bytes.

    A word's hash sums a random 64-bit value per byte times a power of an odd number for its
    place, then mixed; ``bytes.lower`` knows A-Z only, as is wanted."""

    def __init__(self):
        rng = np.random.default_rng(5)
        self.odd = rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.letter = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.letter[self.blank] = 0
        self.powers = self._powers(64)

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))

    def word_hashes(self, text: bytes) -> np.ndarray:
        return self.words(text)[1]

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins, in bytes, and its hash."""
        raw = np.frombuffer(text.lower(), np.uint8)
        blank = self.blank[raw]
        begins = ~blank
        begins[1:] &= blank[:-1]
        first = np.flatnonzero(begins)
        if not len(first):
            return first, np.zeros(0, np.uint64)
        spans = np.diff(first, append=len(raw))
        place = np.arange(first[0], len(raw)) - np.repeat(first, spans)
        if place[-1] >= len(self.powers) or spans.max() > len(self.powers):
            longest = int(place[~blank[first[0]:]].max()) + 1  # of a word, without the blanks after it
            if longest > len(self.powers):
                self.powers = self._powers(2 * longest)
            place = np.minimum(place, len(self.powers) - 1)
        terms = self.letter[raw[first[0]:]] * self.powers[place]
        return first, mixed(np.add.reduceat(terms, first - first[0]))

    def shingles(self, text: bytes) -> np.ndarray:
        """One hash per position of the text's words."""
        h = self.word_hashes(text)
        if not len(h):
            return h
        return self._joined(h, min(SHINGLE, len(h)))

    def _joined(self, h: np.ndarray, n: int) -> np.ndarray:
        # random word hashes times a fixed odd number for each place, mixed once
        total = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            total += h[j:len(h) - n + 1 + j] * self.odd[j]
        return mixed(total)

    def shingles_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of several texts one after the other, and how many each text has, from one
        pass over all bytes. A text of fewer than SHINGLE words has none here."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        first, h = self.words(b"\n".join(texts))
        n_words = np.diff(np.searchsorted(first, ends), prepend=0)
        counts = np.maximum(n_words - SHINGLE + 1, 0)
        if len(h) < SHINGLE:
            return np.zeros(0, np.uint64), counts
        # a text's shingles begin at its words but the last ones
        return self._joined(h, SHINGLE)[runs(np.cumsum(n_words) - n_words, counts)], counts

    def __call__(self, text: bytes) -> np.ndarray:
        return np.unique(self.shingles(text))


class Signer:
    """Bucket keys of a set of shingle hashes."""

    def __init__(self):
        rng = np.random.default_rng(10)
        # order[i, b]: at which attempt bin i, if empty, looks into bin b
        self.order = np.argsort(np.argsort(rng.random((BINS, BINS)), axis=1), axis=1).astype(np.uint16)
        self.salt = rng.integers(1, 1 << 63, BINS, dtype=np.uint64).reshape(BANDS, ROWS)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(bins.astype(np.int64), prepend=-1))  # hashes are sorted, so are the bins
        full = bins[first].astype(np.int64)
        minima = np.zeros(BINS, np.uint64)
        minima[full] = hashes[first]
        empty = np.ones(BINS, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        if len(empty):
            minima[empty] = minima[full[np.argmin(self.order[np.ix_(empty, full)], axis=1)]]
        return mixed(mixed(minima.reshape(BANDS, ROWS) ^ self.salt).sum(axis=1, dtype=np.uint64)).view(np.int64)


def signed_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) -> doc_id, text_key, n_shingles, set_id (128 bits), keys."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, signer = Shingler(), Signer()
        for batch in batches:
            sizes, ids, keys = [], [], []
            for text in text_bytes(batch.column("text")):
                found = shingle(text)
                sizes.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(signer(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_id", "keys"])

    return docs.mapInArrow(sign, "doc_id bigint, text_key bigint, n_shingles bigint, set_id binary, keys array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes those that link, judged on the full sets."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, last_set = Shingler(), None, None
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for left, right in zip(text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")), strict=True):
                if left != last:  # the pairs of one centre come together
                    last, last_set = left, shingle(left)
                other = shingle(right)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(last_set) + len(other) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return stored(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
                  .mapInArrow(judge, "a bigint, b bigint"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """Alternating large-star and small-star until every node points to its component's
    smallest: node, component, for all nodes of ``links`` but those smallest ones."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "stars")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        edges = stored(small.where("u <> v").distinct(), "stars")
        several = edges.groupBy("u").count().where("count > 1")
        above = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        if several.isEmpty() and above.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _with_component(rows: DataFrame, comps: DataFrame, node: str = "node") -> DataFrame:
    return (rows.join(comps.withColumnRenamed("node", node), node, "left")
            .withColumn("component", F.coalesce("component", node)))


def _open_members(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (bucket, node, component) of the buckets that hold several components."""
    placed = _with_component(members.select("bucket", "node"), comps)
    split = (placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("bucket"))
    return stored(placed.join(split, "bucket"), "near-open")


def prefix_pairs(rows: DataFrame) -> DataFrame:
    """Every pair (a, b) of nodes of different components that can reach the threshold, exactly.

    ``rows``: node, component, text. With shingles ordered from the rarest to the most common,
    two sets of n shingles at the threshold share one of their first n - ceil(0.75 n) + 1. What
    many documents share comes last in that order, so a passage or line common to a third of
    them makes no candidates unless it makes up most of two documents."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            for node, component, text in zip(batch.column("node").to_pylist(), batch.column("component").to_pylist(),
                                             text_bytes(batch.column("text")), strict=True):
                found = shingle(text).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), x)) for x in (node, component, len(found))] + [pa.array(found)],
                    ["node", "component", "n", "shingle"])

    every = stored(rows.mapInArrow(explode, "node bigint, component bigint, n bigint, shingle bigint"), "near-shingles")
    common = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"),
                                          F.max("component").alias("hi")).where("df > 1")
    shared = every.join(common, "shingle")
    rarest = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))  # one document's shingles
    held = F.count(F.lit(1)).over(Window.partitionBy("node"))
    # shingles that occur once come first in the order and are not in ``shared``
    allowed = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.col("held"))
    prefix = (shared.withColumn("held", held).withColumn("at", rarest).where((F.col("at") <= allowed) & (F.col("lo") < F.col("hi")))
              .select("shingle", "node", "component", "n", (F.col("held") - F.col("at") + 1).alias("rest")))
    prefix = stored(prefix, "near-prefixes")
    other = prefix.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "rest")])
    # from their first common shingle on, both sets must hold enough for the threshold
    enough = (100 + PERCENT) * F.least("rest", "rest_b") >= PERCENT * (F.col("n") + F.col("n_b"))
    return (prefix.join(other, "shingle").where("node < node_b AND component <> component_b").where(enough)
            .select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key."""
    arrow_rows(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text"))
    signed = stored(signed_sets(rows), "near-signed")

    # equal sets are one class; its node is the smallest id, or a hash where there is none
    lead = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_key")).alias("lead")
    classes = stored(signed.where("n_shingles > 0").groupBy("set_id").agg(
        lead, F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        .select("set_id", "lead", "least", "n", "keys",
                F.coalesce("least", F.xxhash64("set_id").bitwiseOR(F.lit(1 << 62))).alias("node")), "near-classes")
    slots = classes.select("node", "n", F.posexplode("keys").alias("band", "key")).select(
        F.xxhash64("band", "key").alias("bucket"), "node", "n")
    buckets = (slots.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last"),
                                           F.count(F.lit(1)).alias("size")).where("size > 1 AND centre < last"))
    buckets = stored(buckets, "near-buckets")
    # buckets of two are their own edge; larger ones need their members
    members = stored(slots.join(buckets.where("size > 2").select("bucket", "centre"), "bucket"), "near-members")
    pairs = (buckets.where("size = 2").select(F.col("centre").alias("a"), F.col("last").alias("b"))
             .unionByName(members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
             .distinct())
    sizes = classes.select("node", "n")

    def comparable(found: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the threshold."""
        both = (found.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b"))
        return both.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")).select("a", "b")

    pairs = stored(comparable(pairs), "near-pairs")
    involved = (pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node"))
                .distinct())
    wanted = classes.join(involved, "node").select("node", F.col("lead.id").alias("__id"),
                                                   F.col("lead.text_key").alias("__key"))
    texts = stored(rows.join(wanted, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("__id"))
                             & (F.col("text_key") == F.col("__key")))
                   .select("node", "text", "text_key").dropDuplicates(["node", "text_key"]), "near-texts")
    tested = pairs
    links = confirm(pairs, texts)
    comps = components(links)

    # members that do not link to their centre may link to each other
    for turn in range(ROUNDS):
        open_rows = _open_members(members, comps)
        pick = F.min(F.struct(F.xxhash64(F.lit(turn), "node"), "node", "component")).alias("c")
        centre = open_rows.groupBy("bucket").agg(pick).select(
            "bucket", F.col("c.node").alias("a"), F.col("c.component").alias("ca"))
        found = open_rows.join(centre, "bucket").where("component <> ca").select(
            F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        fresh = stored(comparable(found.distinct()).join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = tested.unionByName(fresh)
        links = links.unionByName(confirm(fresh, texts))
        comps = components(links)

    open_nodes = _open_members(members, comps).select("node", "component").distinct()
    found = prefix_pairs(open_nodes.join(texts, "node").select("node", "component", "text"))
    fresh = stored(found.join(tested, ["a", "b"], "left_anti"), "near-pairs")
    comps = components(links.unionByName(confirm(fresh, texts)))

    named = _with_component(classes.select("set_id", "node", "least"), comps)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = stored(named.join(ids, "component").select("set_id", "component_id"), "near-components")
    out = signed.select("doc_id", "n_shingles", "text_key", "set_id").join(by_set, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component."""
    kept = (near_duplicates(docs, id_col, text_col).where("kept")
            .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("bigint").alias("id"), text_key.alias("key"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")),
                     "left_semi").select("doc.*")
