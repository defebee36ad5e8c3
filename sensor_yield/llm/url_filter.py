"""URL filters: blocked Bloom filter of listed URLs, then an exact hash join.

A list entry is a (host, path) pair with a verdict; it covers its host, all subdomains and
every path that starts with the entry's path. Each distinct URL is expanded into the entries
that could cover it (host suffixes x listed path lengths). A blocked Bloom filter -- every key
sets eight bits inside one 512-bit block -- passes the possible hits; a hash join with the
list itself removes the false positives; the longest entry wins.

The filter has a size fixed by the number of entries (``bits_per_key``) and is broadcast only
below ``BROADCAST_LIMIT``; beyond it the same join shuffles by block.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is covered
by nothing; repeated rows are judged alike; of entries with equal host and path ``block``
wins; of equally long entries the one with the longer host wins; an empty list leaves every
URL to ``default``; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensor_yield.llm.common import BROADCAST_LIMIT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 64
WORDS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def _block_and_masks(host: Column, path: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(host, path), F.lit(n_blocks))
    bits = F.xxhash64(path, host, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("bigint"),
                             F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int"))
             for j in range(WORDS)]
    return block, masks


def bloom_filter(entries: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table: one row per used block, eight 64-bit words."""
    block, masks = _block_and_masks(F.col("host"), F.col("path"), n_blocks)
    return (entries.select(block.alias("block"), *[m.alias(f"w{j}") for j, m in enumerate(masks)])
            .groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)]))


def possible_hits(candidates: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """Candidates (host, path, ...) whose eight bits are all set in their block."""
    block, masks = _block_and_masks(F.col("host"), F.col("path"), n_blocks)
    keyed = candidates.select("*", block.alias("block"), *[m.alias(f"m{j}") for j, m in enumerate(masks)])
    side = F.broadcast(bloom) if n_blocks * BLOCK_BYTES <= BROADCAST_LIMIT else bloom
    every = reduce(lambda a, b: a & b, [F.col(f"w{j}").bitwiseAND(F.col(f"m{j}")) == F.col(f"m{j}")
                                        for j in range(WORDS)])
    return keyed.join(side, "block").where(every).select(*candidates.columns)


def url_verdicts(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 default: str = "allow", bits_per_key: int = 16) -> DataFrame:
    """``entries``: host, path, verdict. Returns per row: the id, host, path, rule, verdict."""
    entries = entries.select("host", "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    n = entries.count()
    n_blocks = max(1, -(-n * bits_per_key // (8 * BLOCK_BYTES)))
    lengths = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())

    # the URL itself is the key: however often it occurs, it is judged once
    urls = (pages.select(F.col(url_col).alias("url")).where(F.instr("url", "://") > 0).distinct()
            .select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")))
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= F.length("p"))
    candidates = (urls.select("url", "p", F.explode(suffixes).alias("host"), prefixes.alias("lens"))
                  .select("url", "host", "p", F.explode("lens").alias("len"))
                  .select("url", "host", F.expr("substring(p, 1, len)").alias("path")))
    hits = possible_hits(candidates, bloom_filter(entries, n_blocks), n_blocks).join(entries, ["host", "path"])
    best = hits.groupBy("url").agg(F.max(F.struct(
        (F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"),
        "host", "path", "verdict")).alias("best"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return rows.join(best, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
