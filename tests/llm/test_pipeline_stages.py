"""Every stage of the pipeline against a plain version, on the output of its predecessor."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sensor_yield.llm import toxicity
from sensor_yield.llm.common import stored, table

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF), name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix_sources", "token_files"]
    assert all(f.columns == docs.columns for f in frames[:-1])
    source, clean, single, kept, mixed = ([(r.doc_id, r.text, r.source) for r in f.collect()] for f in frames[:-1])

    # toxicity: what the scorer of the same labels rejects, and nothing else
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).select("doc.doc_id", "score").collect()}
    assert sorted(d for d, *_ in clean) == sorted(d for d, s in scores.items() if s < 0.5)
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    gone = {d for d, *_ in source} - {d for d, *_ in clean}
    assert sum(labels.get(d) == 0 for d in gone) <= 2  # clean documents stay

    # near-dedup: the smallest id of each component
    component = brute.near_duplicates({d: t for d, t, _ in clean})
    assert sorted(d for d, *_ in single) == sorted(d for d, (_, c) in component.items() if c == d)

    # decontamination: documents without a window of the benchmark
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    hit = brute.decontaminate({d: t for d, t, _ in single}, items)
    assert sorted(d for d, *_ in kept) == sorted(d for d, h in hit.items() if not h[4])

    # mixing: whole documents, at most twice, each source within a document of its target
    size = {d: len(brute.words(t)) for d, t, _ in kept}
    of_source: dict = {}
    for d, _, s in kept:
        of_source.setdefault(s, []).append(d)
    targets = brute.targets({s: sum(size[d] for d in ds) for s, ds in of_source.items()})
    times = Counter(d for d, *_ in mixed)
    assert set(mixed) <= set(kept) and max(times.values()) <= 2
    for s, ds in of_source.items():
        assert abs(sum(size[d] * times[d] for d in ds) - targets[s]) <= max(size[d] for d in ds)

    # token files: the mix in order of ids, as the tokenizer has it
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in frames[-1].collect()), 0
    assert len(got) == len(mixed)
    for (d, text, _), row in zip(sorted(mixed), got, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert row == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
