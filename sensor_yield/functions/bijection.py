"""Keyed bijections of 0..n-1 as column expressions, so a shuffle needs neither a sort nor a table.

A number is a pair of Z_a x Z_b (a = ceil(sqrt n), b = ceil(n / a)); six Feistel rounds add a keyed mix of one
half to the other, modulo a and b in turn. What lands beyond n goes round again; fewer than a of the a x b points
lie there, so hardly any row does. ``code`` (below 2^30) is the key, for instance one per feature and repeat.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = (1 << 30) - 1
MOST_STEPS = 128


def code_of(*parts) -> int:
    """A key below 2^30 from any values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) & LOW


#: Per round: a factor for the key and an odd factor for the half.
ROUNDS = [(code_of("key", j) | 1, code_of("half", j) | 1) for j in range(6)]


def sides(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def bijection(x: Column, code: Column, n: int) -> Column:
    """Where position ``x`` of 0..n-1 goes under ``code``."""
    a, b = sides(n)
    big = lambda v: F.lit(v).cast("bigint")

    def mixed(half: Column, c: int, h: int) -> Column:
        key = F.shiftright(code.cast("bigint") * big(c), 7).bitwiseAND(big(LOW))
        return F.shiftright(half.bitwiseXOR(key) * big(h), 11).bitwiseAND(big(LOW))

    def network(p: Column) -> Column:
        left = F.pmod(p, big(a))
        right = F.call_function("div", p - left, big(a))
        for j, (c, h) in enumerate(ROUNDS):
            left, right = right, (left + mixed(right, c, h)) % big((a, b)[j % 2])
        return left + right * big(a)

    # written out, the rounds are compiled; only the few positions that land beyond n walk on
    once = network(x.cast("bigint"))
    steps = min(a * b - n + 1, MOST_STEPS)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once,
                       lambda p, _: F.when(p < n, p).otherwise(network(p)),
                       lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("walk too long")).cast("bigint")))
    return F.when(once < n, once).otherwise(walk)


def bijection_ctes(n_sql: str, codes_sql: str, keys: str) -> list[str]:
    """The same in DuckDB's SQL, as CTEs that end in ``moved(keys, x, p)``: ``n_sql`` gives the number of positions,
    ``codes_sql`` rows of ``keys`` (comma-separated) and ``code``. To be used under WITH RECURSIVE."""
    at = f"SELECT {keys}, x, a, b, n, code, x % a AS half0, x // a AS half1 FROM points"
    for j, (c, h) in enumerate(ROUNDS):
        mix = f"((xor(half1, ((code * {c}) >> 7) & {LOW}) * {h}) >> 11) & {LOW}"
        at = f"SELECT {keys}, x, a, b, n, code, half1 AS half0, (half0 + ({mix})) % {'ab'[j % 2]} AS half1 FROM ({at})"
    on = " AND ".join(f"walk.{k.strip()} = once.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"walk.{k.strip()}" for k in keys.split(","))
    return [
        f"size0 AS (SELECT n, CAST(greatest(1, ceil(sqrt(n))) AS BIGINT) AS s FROM ({n_sql}) t(n))",
        "size1 AS (SELECT n, CASE WHEN s * s < n THEN s + 1 WHEN (s - 1) * (s - 1) >= n AND s > 1 THEN s - 1 ELSE s END AS a FROM size0)",
        f"""points AS (SELECT {keys}, code, n, a, greatest(1, (n + a - 1) // a) AS b, unnest(range(a * greatest(1, (n + a - 1) // a))) AS x
FROM ({codes_sql}), size1)""",
        f"once AS (SELECT {keys}, x, n, half0 + a * half1 AS p FROM ({at}))",
        f"""walk AS (SELECT {keys}, x, p, n FROM once WHERE x < n
UNION ALL SELECT {mine}, walk.x, once.p, walk.n FROM walk JOIN once ON {on} AND once.x = walk.p WHERE walk.p >= walk.n)""",
        f"moved AS (SELECT {keys}, x, p FROM walk WHERE p < n)",
    ]
