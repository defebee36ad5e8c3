"""A training-data pipeline over ``documents``: five stages, each a narrow step or a written
table away from the next.

STAGES lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` writes what a stage returns as Parquet in the shared checkpoint folder and
rereads it as the next stage's ``docs``. All stages but the last keep the columns of ``docs``.

1. toxicity: documents scored as toxic go; the labels of ``sf_dir`` are read as training rows.
2. near_dedup: one document of each group of near duplicates stays.
3. decontaminate: documents that hold a benchmark window go.
4. mix_sources: sources are brought to their target weights, documents taken once or twice.
5. token_files: the mix as token ids in binary files; one row per document read back.

Nulls, empty tables, repeated rows and further columns are handled as the operators' docstrings
say; each stage gives an empty result for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensor_yield.llm import decontaminate as decontamination
from sensor_yield.llm import mixing, near_dedup as near, token_files as tokens, toxicity as toxic
from sensor_yield.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: SQL cannot express the learned scores and the tokenizer; tests hold the stages against
#: brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
