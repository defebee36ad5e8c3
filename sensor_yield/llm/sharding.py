"""Sharding by a Feistel permutation of global row numbers.

Every row has a global number: its rank by (id, size, CRC-32 of the text). A keyed Feistel
network permutes 0..n-1; the permuted number p says shard = p mod shards and slot = p div shards.
So law ``rows`` holds (counts differ by one at most), slots have no gaps, reruns and other
partitionings agree, and ``row_at`` computes the row of a (shard, slot) without a look-up.

Network: numbers are pairs of Z_a x Z_b with a = ceil(sqrt n), b = ceil(n / a), and each round adds
a keyed mix of one half to the other, modulo a and b in turn. Fewer than a points of a * b lie
beyond n; a number that lands there is permuted again (cycle walking) until it lies below n. The
walk ends within ``beyond + 1`` steps; ``MAX_STEPS`` cover it for certain below some 4,000 rows and
with a chance of failure under (1 / 64)^64 above, where it raises an error instead of a wrong row.

Ranks come from range partitions with the row's place in the stored input as the last key, so rows
alike in all columns spread over tasks; offsets are one row per partition. All of it is SQL functions.

Defined cases: null text has no bytes (size 8, CRC 0); null ids rank first; rows alike in id, size and
CRC are interchangeable; an empty table gives no rows; other columns are ignored (``sharded_rows``
keeps them). Equal texts get shards one by one: law ``rows`` can't hold a group of them together.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensor_yield.llm.common import stored

ROUNDS = 6
MAX_STEPS = 64
MASK = (1 << 32) - 1
#: Bits of the two products that the mix drops.
DROPPED = (15, 17)


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0..n-1 as column expressions. All products stay below 2^62."""

    n: int
    seed: int = 11

    @property
    def halves(self) -> tuple[int, int]:
        a = max(1, isqrt(max(0, self.n - 1)) + 1)
        return a, max(1, -(-self.n // a))

    @property
    def keys(self) -> list[tuple[int, int, int, int, int]]:
        """Per round: two numbers to xor with, two odd factors below 2^30, the modulus."""
        out = []
        for j in range(ROUNDS):
            h = hashlib.sha256(f"{self.seed}:{j}".encode()).digest()
            k1, k2, m1, m2 = (int.from_bytes(h[4 * i:4 * i + 4], "big") for i in range(4))
            out.append((k1, k2, (m1 >> 2) | 1, (m2 >> 2) | 1, self.halves[j % 2]))
        return out

    @property
    def steps(self) -> int:
        a, b = self.halves
        return min(a * b - self.n + 1, MAX_STEPS)

    def _keys(self, backward: bool) -> Column:
        names = ("k1", "k2", "m1", "m2", "modulus")
        keys = self.keys[::-1] if backward else self.keys
        return F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(names, k)]) for k in keys])

    @staticmethod
    def _mix(half: Column, key: Column) -> Column:
        once = F.shiftright(half.bitwiseXOR(key["k1"]) * key["m1"], DROPPED[0]).bitwiseAND(F.lit(MASK))
        return F.shiftright(once.bitwiseXOR(key["k2"]) * key["m2"], DROPPED[1]).bitwiseAND(F.lit(MASK))

    def _network(self, x: Column, backward: bool = False) -> Column:
        a, _ = self.halves

        def forward(s: Column, k: Column) -> Column:
            return F.struct(s["r"].alias("l"), ((s["l"] + self._mix(s["r"], k)) % k["modulus"]).alias("r"))

        def back(s: Column, k: Column) -> Column:
            return F.struct(F.pmod(s["r"] - self._mix(s["l"], k), k["modulus"]).alias("l"), s["l"].alias("r"))

        low = F.pmod(x, F.lit(a).cast("bigint"))
        start = F.struct(low.alias("l"), F.call_function("div", x - low, F.lit(a).cast("bigint")).alias("r"))
        return F.aggregate(self._keys(backward), start, back if backward else forward,
                           lambda s: s["l"] + s["r"] * F.lit(a).cast("bigint"))

    def _walk(self, x: Column, backward: bool) -> Column:
        first = self._network(x, backward)
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.steps)), first,
                           lambda p, _: F.when(p < self.n, p).otherwise(self._network(p, backward)),
                           lambda p: F.when(p < self.n, p).otherwise(
                               F.raise_error(F.lit("cycle walk too long")).cast("bigint")))

    def position(self, row: Column) -> Column:
        """Where row number ``row`` goes."""
        return self._walk(row, False)

    def row(self, position: Column) -> Column:
        """The row number that goes to ``position``."""
        return self._walk(position, True)


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8) and text_crc32 of every row, and the row as ``doc``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       (F.octet_length(text) + 8).cast("bigint").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).cast("bigint").alias("text_crc32"), F.struct("*").alias("doc"))


def numbered(rows: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """``rows`` with their rank from 0 in ``order``, and their number. ``rows`` are read from files,
    so that a task that runs again sees them in the same order: ties fall by that order."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    staged = stored(tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie")
                    .withColumn("__part", F.spark_partition_id())
                    .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("__tie"),
                    "ranks")
    counts = staged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = stored(counts.select("__part", "__n", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))
                                   .alias("__before")), "rank-offsets")
    n = offsets.agg(F.sum("__n")).first()[0] or 0
    # one row per partition
    return (staged.join(F.broadcast(offsets.drop("__n")), "__part")
            .withColumn(out, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before"), n)


def _dealt(rows: DataFrame, n_shards: int, seed: int) -> DataFrame:
    ranked, n = numbered(rows, ["doc_id", "size", "text_crc32"], "row_number")
    placed = ranked.withColumn("__p", Permutation(n, seed).position(F.col("row_number")))
    return placed.select(*[c for c in placed.columns if c != "__p"], F.lit("rows").alias("law"),
                         (F.col("__p") % n_shards).cast("int").alias("shard"),
                         F.expr(f"__p div {int(n_shards)}").alias("slot"))


def shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, row_number, law, shard, slot of every row. Texts are read once and not moved."""
    return _dealt(stored(sized_rows(docs, id_col, text_col).drop("doc"), "shard-sizes"), n_shards, seed)


def sharded_rows(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                 seed: int = 11) -> DataFrame:
    """Every row of ``docs`` (read from files) as ``doc``, with shard and slot."""
    return _dealt(sized_rows(docs, id_col, text_col), n_shards, seed).select("doc", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, files: int = 1, **names) -> None:
    """Parquet folders ``shard=0`` ... under ``path``, each of ``files`` files that hold consecutive slots in slot
    order; a file is one task, so choose ``files`` by the bytes of a shard."""
    rows = sharded_rows(docs, n_shards, **names)
    most = rows.agg(F.max("slot")).first()[0]
    part = F.expr(f"slot * {int(files)} div {(most or 0) + 1}")
    (rows.select("shard", "slot", "doc").repartition(n_shards * files, "shard", part).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def row_at(shard: Column, slot: Column, n: int, n_shards: int = 24, seed: int = 11) -> Column:
    """The global row number that stands at ``slot`` of ``shard``."""
    return Permutation(n, seed).row(slot.cast("bigint") * n_shards + shard)


def oracle(n_shards: int = 24, seed: int = 11) -> str:
    """The same in DuckDB's SQL. CRC-32 goes byte by byte through its table of 256 remainders."""
    def mixed(half: str, k: tuple) -> str:
        k1, k2, m1, m2, _ = k
        once = f"((xor({half}, {k1}) * {m1}) >> {DROPPED[0]}) & {MASK}"
        return f"(((xor({once}, {k2}) * {m2}) >> {DROPPED[1]}) & {MASK})"

    keys = Permutation(1, seed).keys  # moduli are taken from the table below
    rounds = reduce(lambda at, jk: f"SELECT x, a, b, r AS l, (l + {mixed('r', jk[1])}) % {'ab'[jk[0] % 2]} AS r FROM ({at})",
                    enumerate(keys), "SELECT x, a, b, x % a AS l, x // a AS r FROM points")
    return f"""
WITH RECURSIVE remainders AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS text_crc32 FROM documents, remainders),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM sized),
sides AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, (SELECT max(i) + 1 FROM range(100000) q(i)
    WHERE i * i <= greatest(n - 1, 0)) AS a FROM (SELECT count(*) AS n FROM documents))),
points AS (SELECT unnest(range(a * b)) AS x, a, b FROM sides),
permuted AS (SELECT x, l + a * r AS p FROM ({rounds})),
walk AS (SELECT x, p FROM permuted, sides WHERE x < n
         UNION ALL SELECT walk.x, permuted.p FROM walk JOIN permuted ON permuted.x = walk.p, sides WHERE walk.p >= n)
SELECT doc_id, size, text_crc32, x AS row_number, 'rows' AS law, (p % {n_shards})::INT AS shard, p // {n_shards} AS slot,
       NULL::INT AS grown_shard FROM numbered JOIN walk USING (x), sides WHERE p < n
"""
