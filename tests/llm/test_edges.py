"""Nulls, empty and very long texts, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import glob
import hashlib
import random
import zipfile

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sensor_yield.llm import (decontaminate, exact_dedup, license_scan, mixing, near_dedup, substring_dedup,
                              token_files, toxicity, url_filter, warc)
from sensor_yield.llm.license_texts import LICENSES, NOTICES
from sensor_yield.llm.near_dedup import Shingler

from . import brute

LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "one two three four five six", "a"), (2, None, "a"), (3, "", "b"), (4, " \n\t ", None), (5, LONG, "b"),
    (6, LONG, None), (5, LONG, "b"), (7, "ONE two three four five six", "a"), (8, "lone", "c"), (9, "Lone", "c"),
    (None, "one two three four five six", "a"), (10, "x1 x2 x3 " + PASSAGE, "c"), (11, PASSAGE + " y1 y2 y3 y4", "a"),
    (12, " ".join(f"u{i}" for i in range(20)) + " " + PASSAGE + " " + " ".join(f"v{i}" for i in range(200)), "b"),
    (13, "é" * 50_000, "b"),
]
SCHEMA = "doc_id bigint, text string, source string"
#: Names that the operators use inside.
CLASHING = ["doc", "key", "text_key", "size", "n", "digest", "score", "spans", "node", "begin", "slot", "block", "at",
            "n_words", "fold", "toxic", "tie", "words", "__key", "__id", "__source", "__bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


ITEMS = [(1, " ".join(f"p{i}" for i in range(5, 30))), (2, None), (3, ""), (None, "lone"), (4, "Lone!"), (1, "nothing here")]
CLEAN = [f"{a}{b}" for a in ("fi", "do", "ca", "lu") for b in ("ne", "gs", "rt", "mp", "st")]
ABUSE = ["you", "idiot", "stupid", "moron"]
LABELS = [(d, d % 2) for d in range(100, 140)] + [(None, 1), (1, None), (101, 0)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_near_duplicates(docs, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
    want = brute.near_duplicates({d: t for d, t, _ in ROWS if d is not None})
    assert sorted(g for g in got if g[0] is not None) == sorted(
        (d, *want[d], want[d][1] == d) for d, _, _ in ROWS if d is not None)
    assert [g for g in got if g[0] is None] == [(None, 2, 1, False)]  # a row without id joins its component
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g[0] for g in got if g[3])
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicated(empty).count() == 0


def test_rows_without_any_id(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words in this one")],
                                 "doc_id bigint, text string")
    got = near_dedup.near_duplicates(rows).collect()
    assert [(r.component_id, r.kept) for r in got] == [(None, True)] * 3


def test_star_misses_are_found(spark):
    """Members that link to each other, not to their bucket's centre: a chain of small edits."""
    base = [f"c{i}" for i in range(120)]
    rows, text = [], list(base)
    for d in range(60):
        rows.append((d, " ".join(text)))
        text[(d * 2) % 120] = f"e{d}"
    chain = rows + [(100 + d, " ".join([f"f{d}_{i}" for i in range(60)] + base[:60])) for d in range(30)]
    got = near_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id bigint, text string")).collect()
    want = brute.near_duplicates(dict(chain))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7)]
    got = near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {**{i: 1 for i in range(2, 41)}, 200: 100, 300: 100}
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_repeated_passages(docs, empty):
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} | {r.match_id for r in got} == {5, 6, 10, 11, 12}
    assert len({(r.doc_id, r.match_id) for r in got}) == 3  # a star of each group
    assert all(r.class_id == (5 if r.doc_id == 6 else 10) and r.match_id < r.doc_id for r in got)
    for r in got:
        if r.doc_id == 12:
            assert r.begin <= 20 and r.end >= 80
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_passages_of_a_template_family(spark):
    """Texts of one template, filled differently in pairs: the pair links, the family does not."""
    rng, rows = random.Random(5), []
    template = [f"t{i}" for i in range(72)]
    for pair in range(60):
        filled = list(template)
        for at in rng.sample(range(0, 72, 6), 3):
            filled[at:at + 2] = [f"g{pair}_{at}", f"h{pair}_{at}"]
        for half in range(2):
            around = [[f"{c}{pair}_{half}_{i}" for i in range(rng.randint(5, 60))] for c in "uv"]
            rows.append((2 * pair + half, " ".join(around[0] + filled + around[1])))
    shingled = {d: Shingler().shingles(t.encode()) for d, t in rows}
    groups, want = brute.Groups(), set()
    for a in shingled:
        for b in range(a):
            if substring_dedup.passages(shingled[b], shingled[a]):
                groups.join(a, b)
                want |= {a, b}
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert want == set(shingled) and len({groups.find(d) for d in want}) > 10
    assert {r.doc_id: r.class_id for r in got} | {r.match_id: r.class_id for r in got} == {d: groups.find(d) for d in want}


def test_exact_pairs_of_passages(spark):
    """Every pair with a passage is among the pairs, with each text a component of its own."""
    rng, texts = random.Random(9), {}
    base = [f"b{i}" for i in range(90)]
    for d in range(24):
        n = rng.choice([50, 60, 73, 90])
        words, at = base[:n], rng.randrange(n - 12)
        words[at:at + rng.randint(0, 9)] = [f"x{d}_{i}" for i in range(rng.randint(0, 9))]
        texts[d] = " ".join([f"y{d}_{i}" for i in range(40)] + words)
    shingled = {d: Shingler().shingles(t.encode()) for d, t in texts.items()}
    want = {(a, b) for b in texts for a in range(b) if substring_dedup.passages(shingled[a], shingled[b])}
    holders = spark.createDataFrame([(d, d, 0, len(x) - 1) for d, x in shingled.items()], "text_key bigint, component bigint, l bigint, r bigint")
    got = substring_dedup.exact_pairs(holders, spark.createDataFrame(list(texts.items()), "text_key bigint, text string")).collect()
    assert 20 < len(want) and want <= {tuple(r) for r in got}


def test_exact_pairs_of_a_common_line(spark):
    """Texts that hold a common line once make no pairs with texts that repeat it."""
    line = " ".join(f"l{i}" for i in range(12))
    texts = {d: " ".join([f"y{d}_{i}" for i in range(60)] + [line]) for d in range(30)}
    texts |= {d: " ".join([line] * 6) for d in range(30, 34)}
    holders = spark.createDataFrame([(d, d, 0, len(t.split()) - 5) for d, t in texts.items()], "text_key bigint, component bigint, l int, r int")
    got = substring_dedup.exact_pairs(holders, spark.createDataFrame(list(texts.items()), "text_key bigint, text string")).collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(30, 34) for b in range(a + 1, 34)]


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_decontaminate(docs, empty, items, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)  # several passes must agree with one
    got = decontaminate.report(decontaminate.find_matches(docs, items)).collect()
    texts = {i: t for i, (_, t, _) in enumerate(ROWS)}
    # items are brute-forced one row at a time: an id may repeat
    each = [brute.decontaminate(texts, {str(i) if i is not None else "null": t}) for i, t in ITEMS]
    for row, (d, text, _) in enumerate(ROWS):
        found = sorted({str(i) if i is not None else "null" for (i, _), b in zip(ITEMS, each, strict=True) if b[row][4]})
        same = [g for g in got if g.doc_id == d and g.n_words == len(brute.words(text, brute.ALNUM))]
        assert same and all((g.n_items, g.items_sha256, g.contaminated) == (
            len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(found)) for g in same)
    assert next(g for g in got if g.doc_id == 11).longest_match == 25
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not g.contaminated for g in got)
    assert decontaminate.clean(empty, items).count() == 0
    assert decontaminate.clean(docs, items.where("false")).count() == len(ROWS)


def test_mix(docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(ROWS) and got.taken[got["size"] == 0].sum() == 0
    sizes: dict = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    for s in want:
        mine = got[got.source.isna() if s is None else got.source == s]
        assert mine.target.iloc[0] == pytest.approx(want[s]) and abs(mine.taken.sum() - want[s]) <= 1
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert rows.where("text IS NULL OR trim(text) = ''").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_files.round_trip(docs, path).orderBy("start").collect()
    assert [r.doc_id for r in got][:2] == [None, 1] and len(got) == len(ROWS)
    assert [r.start for r in got[1:]] == [r.start + r.n_tokens for r in got[:-1]]
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 4))
    assert token_files.round_trip(empty, path).count() == 0
    other = token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=50256)
    assert other.count() == len(ROWS)


def test_single_document_access(spark, docs):
    from sensor_yield.llm.common import scratch

    folder, path = scratch(spark, "ids"), public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = token_files.write_files(rows, folder, path, 2).collect()
    ids = token_files.read_files(spark.createDataFrame(files), folder, with_ids=True).collect()
    first = min(files, key=lambda f: f.at)
    by_start = sorted(ids, key=lambda r: r.start)
    assert token_files.read_document(folder, first.path, 0).tolist() == by_start[0].ids


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    train = [(d, " ".join(rng.choices(CLEAN, k=rng.randint(1, 60)) + (rng.choices(ABUSE, k=rng.randint(1, 4)) if d % 2 else [])),
              "a") for d in range(100, 700)]
    rows = spark.createDataFrame([*train, *ROWS, (900, "you stupiid idiot", "a"), (901, "a fine day", "a")], SCHEMA)
    rows = rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    labels = spark.createDataFrame([(d, d % 2) for d in range(100, 700)] + [(None, 1), (1, None), (100, 0)],
                                   "doc_id bigint, toxic int")
    model = toxicity.fit(rows, labels)
    got = {r.doc_id: r.score for r in toxicity.score(rows, model).select("doc.doc_id", "score").collect()}
    assert got[900] > 0.5 > got[901] and got[2] < 0.5 and got[2] == got[3]
    kept = toxicity.clean(rows, labels)
    assert kept.columns == rows.columns and kept.where("doc_id = 900").count() == 0
    assert toxicity.clean(empty, labels).count() == 0
    nothing = toxicity.fit(docs, labels.where("false"))
    assert all(r.score == 0 for r in toxicity.score(docs, nothing).collect())


def test_exact_dedup_of_files(spark, docs, empty, tmpdir_path):
    path = f"{tmpdir_path}/docs"
    docs.coalesce(2).write.parquet(path)
    got = exact_dedup.dedup_files(spark, path).collect()
    assert len(got) == len(ROWS)
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): [] for _, t, _ in ROWS}
    for d, t, _ in ROWS:
        texts[hashlib.sha256((t or "").encode()).hexdigest()].append(d)
    for r in got:
        group = texts[r.text_sha256]
        assert r.group_size == len(group) and r.keep_id == max((d for d in group if d is not None), default=None)
    assert sum(r.kept for r in got) == len(texts)
    empty.write.parquet(f"{tmpdir_path}/none")
    assert exact_dedup.dedup_files(spark, f"{tmpdir_path}/none").count() == 0


def test_exact_dedup_keeps_its_state(spark, tmpdir_path):
    path, state = f"{tmpdir_path}/docs", f"{tmpdir_path}/state"
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").coalesce(1).write.parquet(path)
    exact_dedup.dedup_files(spark, path, state_dir=state)
    spark.createDataFrame([(3, "a")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(path)
    got = exact_dedup.dedup_files(spark, path, state_dir=state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)}


def test_exact_dedup_sets_no_disk_aside(spark, tmpdir_path):
    path, state = f"{tmpdir_path}/docs", f"{tmpdir_path}/state"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string").write.parquet(path)
    before = {name: spark.conf.get(name, None) for name in exact_dedup.STORE}
    assert exact_dedup.dedup_files(spark, path, state_dir=state).count() == 3
    assert {name: spark.conf.get(name, None) for name in exact_dedup.STORE} == before
    said = []
    for snapshot in glob.glob(f"{state}/state/0/*/*.zip"):
        with zipfile.ZipFile(snapshot) as files:
            said += [line.strip() for name in files.namelist() if "OPTIONS" in name
                     for line in files.read(name).decode().splitlines() if "allow_fallocate" in line]
    assert said and set(said) == {"allow_fallocate=false"}


def test_byte_check_resolves_a_digest_with_two_texts(spark, tmpdir_path, monkeypatch):
    plain = exact_dedup._rows

    def colliding(df, *args, **kw):
        return plain(df, *args, **kw).withColumn("digest", F.lit("same"))

    monkeypatch.setattr(exact_dedup, "_rows", colliding)
    path = f"{tmpdir_path}/docs"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string").write.parquet(path)
    got = exact_dedup.dedup_files(spark, path).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)}


def test_url_filter(spark):
    urls = [(1, "http://A.b.ORG/x?y#z"), (2, None), (3, "no scheme"), (4, "https://example.org/en/1"), (4, "https://example.org/en/1"),
            (5, "x://org"), (6, "http://example.org/es/" + "q" * 5000), (7, ""), (None, "http://notorg/"), (8, "http://a.com?/fr/")]
    rows = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
                                   ("org", "/", "block")], "host string, path string, verdict string")
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in url_filter.url_verdicts(rows, rules).collect()), key=repr)
    assert got == sorted([(1, "a.b.org", "org/", "block"), (2, "", None, "allow"), (3, "", None, "allow"),
                          (4, "example.org", "example.org/en/1", "block"), (4, "example.org", "example.org/en/1", "block"),
                          (5, "org", None, "allow"), (6, "example.org", "example.org/es/", "block"), (7, "", None, "allow"),
                          (None, "notorg", None, "allow"), (8, "a.com", None, "allow")], key=repr)
    assert url_filter.url_verdicts(rows.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(rows, rules.where("false"), default="block").collect()} == {"block"}


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"))
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("host"), F.lit("/").alias("path"))
    n_blocks = 2000 * 16 // 512 + 1
    bloom = url_filter.bloom_filter(listed, n_blocks)
    assert url_filter.possible_hits(listed, bloom, n_blocks).count() == 2000
    assert url_filter.possible_hits(others, bloom, n_blocks).count() < 400


def test_warc(spark):
    big, same = "é" * 400_000, "s" * 100
    pages = [(1, "http://a/ b\n", "<p>"), (2, None, None), (3, "u", same), (4, "u", same), (3, "u", same), (5, "u", "s" * 99),
             (6, "u", "s" * 99), (None, "u", same), (7, "u", big), (8, "u", big), (9, "u", "\r\n\r\nWARC/1.1\r\n")]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("n", F.lit(2))
    got = warc.round_trip(spark, rows).collect()
    want = []
    for p, _, h in pages:
        data = (h or "").encode()
        first = min((q for q, _, g in pages if g == h and q is not None), default=None)
        refers = first if len(data) >= 100 and p != first else None
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) \
        == sorted(want, key=repr)
    assert warc.round_trip(spark, rows.where("false")).count() == 0


def test_license_scan(spark, docs, empty):
    mit = dict(LICENSES)["MIT"]
    odd = "Copyright (c) 2021 Some One\r\n\n" + mit.upper().replace("COPIES", "copies").replace(",", " ,").replace("LICENSE", "LICENCE")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(50, mit), (51, odd), (52, "words\nRELEASED  under the mit licence\nreleased under the MIT License!"), (53, mit + " and more")],
        "doc_id bigint, text string")).withColumn("license", F.lit(1)).withColumn("line", F.lit(2))
    got = {r.doc_id: r for r in license_scan.scan_licenses(more, LICENSES, NOTICES).collect()}
    assert got[50].license == got[51].license == "MIT" and got[53].license is None
    assert got[52].notices == "MIT" and got[52].n_notices == 1
    assert got[2].digest == got[3].digest == got[4].digest == hashlib.sha256(b"").hexdigest()
    assert license_scan.scan_licenses(more, LICENSES, NOTICES).count() == len(ROWS) + 4
    assert license_scan.scan_licenses(empty, LICENSES, NOTICES).count() == 0


def test_pipeline_stages(spark, docs, empty, tmpdir_path):
    for rows, name in ((docs, "some"), (empty, "none")):
        folder = f"{tmpdir_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame(LABELS, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (out.count() > 0) == (name == "some")
