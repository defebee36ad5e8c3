"""SQL definitions (DuckDB dialect) of the derived frames in
``sources.driver_tables`` -- used only by the oracle queries of the catalog."""

from __future__ import annotations

LINEITEM_SENSORS = """
li AS (
  SELECT l_orderkey, l_linenumber, l_shipdate AS "Time",
         CAST(l_returnflag = 'R' AS INTEGER) AS Pass_Fail,
         l_quantity AS feature_000, l_extendedprice / 1000.0 AS feature_001,
         l_discount AS feature_002, l_tax AS feature_003,
         CAST(5.0 AS DOUBLE) AS feature_004,
         l_quantity * 2.0 + l_tax AS feature_005,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice / 1000.0 END AS feature_006,
         CASE WHEN l_linenumber > 1 THEN NULL ELSE l_discount END AS feature_007
  FROM lineitem)"""

DOCUMENT_SENSORS = """
docs AS (
  SELECT d.doc_id AS row_id, CAST(coalesce(l.toxic, 0) AS INTEGER) AS Pass_Fail,
         CAST(d.n_chars AS DOUBLE) AS feature_000, CAST(l.quality AS DOUBLE) AS feature_001,
         CAST(l.toxic AS DOUBLE) AS feature_002
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


#: Row id, class and the first value of each vector (for queries that need no other).
EMBEDDING_ROWS = """
emb AS (
  SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS Pass_Fail, CAST(embedding[1] AS DOUBLE) AS feature_000
  FROM embeddings)"""

#: All values of all vectors in long form.
EMBEDDING_LONG = """
long AS (
  SELECT vec_id, i AS k, 'feature_' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') AS f, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


EVENT_SCORES = """
ev AS (
  SELECT event_id AS row_id, ts AS "Time",
         CAST(event_type = 'error' AS INTEGER) AS Pass_Fail,
         CASE WHEN event_type = 'error' THEN 'Fail' ELSE 'Pass' END AS Pass_Fail_Label,
         floor(value) / (floor(value) + 50.0) AS fail_probability,
         value AS feature_000, CAST(user_id AS DOUBLE) AS feature_001,
         CAST(hour(ts) AS DOUBLE) AS feature_002,
         CASE WHEN event_type = 'view' THEN NULL ELSE value END AS feature_003,
         CASE WHEN event_type IN ('view', 'click', 'signup') THEN NULL ELSE CAST(user_id AS DOUBLE) END AS feature_004,
         CAST(1.0 AS DOUBLE) AS feature_005
  FROM events)"""


def md5_key(id_expr: str, seed: int = 42, salt: str | None = None) -> str:
    prefix = f"{seed}:" if salt is None else f"{seed}:{salt}:"
    return f"md5('{prefix}' || CAST({id_expr} AS VARCHAR))"


def split_cte(src: str, seed: int = 42, test_size: float = 0.2, name: str = "split") -> str:
    """Exact stratified split of ``src`` (row_id, Pass_Fail, ...) as in
    ``operators.splits.stratified_split``."""
    return f"""
{name}_counts AS (
  SELECT Pass_Fail, count(*) AS n_class FROM {src} GROUP BY Pass_Fail),
{name}_alloc0 AS (
  SELECT Pass_Fail, n_class, sum(n_class) OVER () AS n,
         CAST(ceil({test_size} * sum(n_class) OVER ()) AS BIGINT) AS n_test_total
  FROM {name}_counts),
{name}_alloc1 AS (
  SELECT *, n - n_test_total AS n_train_total,
         ((n - n_test_total) * n_class) // n AS base,
         ((n - n_test_total) * n_class) % n AS rem
  FROM {name}_alloc0),
{name}_alloc AS (
  SELECT Pass_Fail, n_class,
         n_class - (base + CASE WHEN row_number() OVER (ORDER BY rem DESC, Pass_Fail ASC)
                                     <= n_train_total - sum(base) OVER () THEN 1 ELSE 0 END) AS n_test
  FROM {name}_alloc1),
{name}_ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY Pass_Fail ORDER BY {md5_key('row_id', seed)}, row_id) AS ord
  FROM {src} s),
{name} AS (
  SELECT r.* EXCLUDE (ord), CASE WHEN r.ord <= a.n_test THEN 'test' ELSE 'train' END AS dataset_split
  FROM {name}_ranked r JOIN {name}_alloc a USING (Pass_Fail))"""
