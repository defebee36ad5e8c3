"""Registered queries over the smallest tables: SQL twins, or brute force where SQL is no help."""

from __future__ import annotations

import math
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sensor_yield.llm.queries import ORACLE_SQL, QUERIES
from sensor_yield.sources.driver_tables import TABLES

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _norm(v):
    return None if v is None or v is not v or (isinstance(v, float) and math.isnan(v)) else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in t}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(con.execute(ORACLE_SQL[name]).df())


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op12(spark, docs):
    got = QUERIES["op12_phrase_mining"](spark, SF).collect()
    want = brute.collocations([(r["text"], r["lang"]) for r in docs.values()])
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == sorted(want) and want


def test_op10(spark, docs):
    got = QUERIES["op10_near_dedup"](spark, SF).collect()
    want = brute.near_duplicates({d: r["text"] for d, r in docs.items()})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op2(spark, docs):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    got = QUERIES["op2_decontaminate"](spark, SF).collect()
    want = brute.decontaminate({d: r["text"] for d, r in docs.items()}, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert len(got) == len(docs)


def test_op3(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, SF).collect()}
    start = 0
    for d in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[d]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert got.pop(d) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_op9(spark, docs):
    got = QUERIES["op9_mix_sources"](spark, SF).toPandas()
    size = {d: len(brute.words(r["text"])) for d, r in docs.items()}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    per = got.groupby("source").agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"),
                                    taken=("taken", "sum"))
    assert (per["size"] == per.given).all()
    want = brute.targets(per["size"].to_dict())
    assert all(abs(per.target[s] - want[s]) < 1e-6 for s in want)
    assert (abs(per.taken - per.target) <= 1).all()
    again = QUERIES["op9_mix_sources"](spark, SF).toPandas()
    key = ["doc_id"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_op1(spark, docs):
    got = QUERIES["op1_substring_dedup"](spark, SF).collect()
    want, groups = brute.repeated_documents({d: r["text"] for d, r in docs.items()})
    class_of = {r.doc_id: r.class_id for r in got} | {r.match_id: r.class_id for r in got}
    assert want <= set(class_of)
    members: dict = {}
    for d in want:
        members.setdefault(groups.find(d), set()).add(class_of[d])
    assert all(len(m) == 1 for m in members.values())
    text = {d: brute.words(r["text"]) for d, r in docs.items()}
    for r in got:  # what is reported is similar indeed
        a, b = (frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in
                (text[r.doc_id][r.begin:r.end], text[r.match_id][r.match_begin:r.match_end]))
        assert 100 * len(a & b) >= 75 * len(a | b)
        assert r.similarity == pytest.approx(len(a & b) / len(a | b))


def test_op5_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    got = QUERIES["op5_toxicity"](spark, sf).toPandas().set_index("doc_id")
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().set_index("doc_id").toxic
    assert all(got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.index])
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got[got.held_out].join(labels, how="inner")
    ranks, y = both.score.rank(), both.toxic == 1
    auc = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95
    assert both.predicted[y].mean() > 0.85 and both.predicted[~y].mean() < 0.02
