"""The registered queries of the training-data operators and, where SQL can express them,
their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensor_yield.llm import (decontaminate, exact_dedup, hard_negatives, license_scan, mixing, near_dedup, phrases,
                              sharding, substring_dedup, token_files, toxicity, url_filter, warc)
from sensor_yield.llm.common import table
from sensor_yield.llm.license_texts import LICENSES, NOTICES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return add


@register("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_files(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


#: Rules of the query: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register("op7_url_filter", """
WITH rules(h, p, v) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
         FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
""".format(rules=", ".join(str(r) for r in URL_RULES)))
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


@register("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@register("op8_warc_packages", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f
""")
def op8_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark")))


@register("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc.doc_id", toxicity.held_out("doc.doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    """The canonical lines of a text, in DuckDB's words."""
    line = f"translate(translate(x, '{license_scan.UPPER}', '{license_scan.LOWER}'), " \
           f"'{license_scan.MARKS}', '{' ' * len(license_scan.MARKS)}')"
    line = f"trim(regexp_replace({line}, {_sql_text(license_scan.PUNCTUATION)}, ' ', 'g'))"
    for pattern, by in license_scan.SPELLINGS:
        by = by.replace("$", chr(92))
        line = f"regexp_replace({line}, {_sql_text(pattern)}, {_sql_text(by)}, 'g')"
    return (f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {line}), lambda x: "
            f"x <> '' AND NOT regexp_matches(x, {_sql_text(license_scan.OWNERSHIP)}) AND x <> 'all rights reserved')")


@register("op4_license_scan", f"""
WITH known AS (SELECT sha256(array_to_string({_sql_lines('t')}, ' ')) AS digest, min(id) AS license
               FROM (VALUES {', '.join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in [*LICENSES, *NOTICES])}) v(id, t)
               GROUP BY 1),
doc AS (SELECT doc_id, {_sql_lines('text')} AS lines FROM documents),
whole AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest FROM doc),
line AS (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, unnest(lines) AS x FROM doc) l JOIN known
         ON known.digest = sha256(l.x)),
said AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices, count(*) AS n FROM line GROUP BY 1)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN said USING (doc_id)
""")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), LICENSES, NOTICES)


@register("op11_feistel_sharding", sharding.oracle(24))
def op11_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 24).withColumn("grown_shard", F.lit(None).cast("int"))


@register("op12_phrase_mining")
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@register("op13_hard_negatives", """
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
             list_dot_product(a.q, r.q)::BIGINT AS score FROM p a JOIN p r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
         QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score,
       score AS negative_score FROM near JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label)
