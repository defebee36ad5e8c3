"""Parts of the operators against plain versions."""

from __future__ import annotations

import io
import random
import time
import zipfile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensor_yield.llm import common, substring_dedup, zip_ranges
from sensor_yield.llm.decontaminate import Windows, words_of
from sensor_yield.llm.near_dedup import BANDS, Shingler, Signer
from sensor_yield.llm.substring_dedup import LEAST, CompactWindows
from sensor_yield.llm.token_files import encoder
from sensor_yield.llm.toxicity import Automaton, Matcher

from . import brute


class Bytes:
    def __init__(self, data: bytes):
        self.data, self.size, self.most = data, len(data), 0

    def read(self, start, length):
        assert 0 <= start <= start + length <= self.size
        self.most = max(self.most, length)
        return self.data[start:start + length]


@pytest.mark.parametrize("wide", [False, True])
def test_zip_members(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment with PK\x05\x06 inside"
        for name, data in (("a/data", b"x" * 100_000), ("b/índex", b"12 34")):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(data)
        z.writestr(zipfile.ZipInfo("packed"), "y" * 1000, zipfile.ZIP_DEFLATED)
    reader = Bytes(out.getvalue())
    found = zip_ranges.members(reader)
    assert list(found) == ["a/data", "b/índex", "packed"]
    assert zip_ranges.read_member(reader, found["b/índex"]) == b"12 34"
    assert reader.read(zip_ranges.data_start(reader, found["a/data"]) + 5, 3) == b"xxx"
    with pytest.raises(ValueError):
        zip_ranges.data_start(reader, found["packed"])
    with pytest.raises(ValueError):
        zip_ranges.members(Bytes(b"no package" * 10))


def test_zip64_directory():
    """A directory whose fields are all in the 64-bit records."""
    import struct

    data = b"payload"
    local = struct.pack("<IHHHHHIIIHH", zip_ranges.LOCAL, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"m" + bytes(20)
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = struct.pack("<IHHHHHHIIIHHHHHII", zip_ranges.ENTRY, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0,
                        0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    at = len(local) + len(data)
    end64 = struct.pack("<IQHHIIQQQQ", zip_ranges.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<IIQI", zip_ranges.END64_LOCATOR, 0, at + len(entry), 1)
    end = struct.pack("<IHHHHIIH", zip_ranges.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    reader = Bytes(local + data + entry + end64 + locator + end)
    found = zip_ranges.members(reader)
    assert zip_ranges.read_member(reader, found["m"]) == data


def test_automaton_is_edit_distance():
    rng = random.Random(4)
    terms = {"idiot": 0, "trash": 1, "moron": 2, "worthless": 3, "pathetic": 4, "idiotic": 5}
    for edits in (1, 2):
        automaton = Automaton(terms, edits)
        for _ in range(3000):
            word = list(rng.choice(list(terms)))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(word) + 1)
                word[at:at + rng.randint(0, 1)] = rng.choice(["", rng.choice("abiotr"), rng.choice("mhs")])
            word = "".join(word)
            near = min((brute.edit_distance(word, t), i) for t, i in terms.items())
            assert automaton.match(word) == (near if near[0] <= edits else None)


def test_matcher_contexts():
    matcher = Matcher([("idiot", 4.0), ("réeux*", 2.0)])
    assert matcher.hits("you are an idi0t")[1] == [(0, 1, False, True)]
    assert matcher.hits('she said: "an idiot" and left')[1] == [(0, 0, True, False)]
    assert matcher.hits("le réeuxan")[1] == [(1, 0, False, False)]
    assert matcher.hits("nothing") == (1, [])


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(2)
    compact = CompactWindows()
    for n in (LEAST, LEAST + 1, 3 * LEAST + 7, 900):
        shingles = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for k, values, first, last, left, right in compact.windows(shingles):
            h = substring_dedup.mixed(shingles ^ compact.salts[k])
            minima = [h[s:s + LEAST].min() for s in range(n - LEAST + 1)]
            assert [v for v, a, b in zip(values, first, last, strict=True) for _ in range(a, b + 1)] == minima
            for v, l, r in zip(values, left, right, strict=True):
                c = int(np.flatnonzero(h == v)[0])
                assert l <= c <= r and h[l:r + 1].min() == v
                assert (l == 0 or h[l - 1] < v) and (r == n - 1 or h[r + 1] < v)


def test_texts_of_a_batch_are_scanned_as_each_alone():
    """Texts one after the other: no shingle, minimum or window reaches from one into the next."""
    rng, shingle, compact = random.Random(3), Shingler(), CompactWindows()
    texts = [b"", b" \n\t ", b"a b", b"one two three four five", "w\u00e9 ".encode() * 90, b"x" * 300 + b" y" * 49, b"\x0b\x0c q " * 60]
    texts += [" ".join(f"{rng.randrange(40)}" for _ in range(n)).encode() for n in (49, 50, 51, 300, 700)]
    rng.shuffle(texts)
    found, counts = shingle.shingles_of(texts)
    alone = [shingle.shingles(t) if len(t.split()) >= 5 else np.zeros(0, np.uint64) for t in texts]
    assert counts.tolist() == [len(x) for x in alone] and np.array_equal(found, np.concatenate(alone))
    got = substring_dedup.windows_of(compact, np.arange(len(texts)), found, counts)
    want = [substring_dedup.windows_of(compact, key, x) for key, x in enumerate(alone)]
    assert sorted(zip(*[c.tolist() for c in got], strict=True)) == sorted(
        row for w in want for row in zip(*[np.asarray(c).tolist() for c in w], strict=True))
    assert len(got[0]) > 100 and [len(c) for c in substring_dedup.values_of(compact, np.arange(1), *shingle.shingles_of([b"a"]))] == [0, 0]


def test_shuffle_files_go_with_their_step(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    said = spark.conf.get(name)
    kept = []
    with common.shuffles_freed(spark):
        kept.append(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).count())
        assert common.stored(kept[0], "freed").count() == 1000
    assert spark.conf.get(name) == said
    for _ in range(100):  # files are deleted beside the work
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_lines_between_other_words_cost_little(monkeypatch):
    """Texts that share a line, again and again between other words, are told apart without chains."""
    line, rng = [f"l{i}" for i in range(14)], random.Random(2)
    texts = [[w for i in range(30) for w in (*line, *(f"{c}{i}_{j}" for j in range(rng.randint(20, 40))))] for c in "pq"]
    a, b = (Shingler().shingles(" ".join(t).encode()) for t in texts)
    whole = substring_dedup.Places(a)
    assert substring_dedup.passages(whole, np.append(b, a)) == substring_dedup.passages(a, np.append(b, a)) != []
    monkeypatch.setattr(substring_dedup, "_chains", None)
    assert substring_dedup.passages(whole, b) == []
    once = Shingler().shingles(" ".join(line * 9).encode())
    assert substring_dedup.passages(Shingler().shingles(" ".join(line + texts[0][14:99]).encode()), once) == []


def test_passages_that_touch_in_one_text_only():
    p, q, far = ([f"{c}{i}" for i in range(60)] for c in "pqz")
    shingle = Shingler()
    a = shingle.shingles(" ".join(p + far + far + q).encode())
    b = shingle.shingles(" ".join(q + p).encode())
    found = substring_dedup.passages(a, b, [(0, len(b))])
    assert [(f[0], f[1], f[4]) for f in sorted(found)] == [(0, 55, 1.0), (60, 115, 1.0)]
    repeated = shingle.shingles(("w " * 90 + "x " * 90).encode())
    assert len(substring_dedup.passages(shingle.shingles(("x " * 70 + " ".join(far) + " w" * 70).encode()), repeated,
                                        [(0, len(repeated))])) == 2
    assert substring_dedup.passages(a, shingle.shingles(" ".join(far[:40]).encode()), [(0, 99)]) == []


def test_two_functions_agree_on_similar_passages():
    """400 passages of 60 words, three replaced in the middle: similarity 0.78."""
    rng, compact, shingle = random.Random(7), CompactWindows(), Shingler()

    def keys(words):
        value, _, k, first, last = substring_dedup.windows_of(compact, 1, shingle.shingles(" ".join(words).encode()))[:5]
        x, y = np.nonzero((first[:, None] <= last) & (first <= last[:, None]) & (k[:, None] < k))
        return set(zip(value[x].tolist(), value[y].tolist(), strict=True))

    for _ in range(400):
        passage = [f"{rng.random()}" for _ in range(60)]
        other = passage[:28] + [f"{rng.random()}" for _ in range(3)] + passage[31:]
        around = [[f"{rng.random()}" for _ in range(60)] for _ in range(4)]
        assert keys(around[0] + passage + around[1]) & keys(around[2] + other + around[3])


@pytest.mark.parametrize("n, at, out, into", [(60, 28, 3, 3), (50, 25, 0, 3), (54, 24, 3, 0), (80, 30, 4, 4), (80, 60, 5, 2),
                                              (100, 40, 7, 7), (100, 50, 0, 15), (73, 50, 0, 8)])
def test_passages_with_a_hole(n, at, out, into):
    """``out`` words replaced by ``into`` others, in both orders."""
    words = [f"p{i}" for i in range(n)]
    other = words[:at] + [f"q{i}" for i in range(into)] + words[at + out:]
    sets = [brute.shingles(" ".join(w)) for w in (words, other)]
    similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert similarity >= 0.75
    around = [[f"{c}{i}" for i in range(90)] for c in "stuv"]
    x, y = (Shingler().shingles(" ".join(around[k] + w + around[k + 1]).encode()) for k, w in ((0, words), (2, other)))
    for a, b, size in ((x, y, len(other)), (y, x, n)):
        assert [f[:2] + f[4:] for f in substring_dedup.passages(a, b)] == [(90, 90 + size - 5, pytest.approx(similarity))]


@pytest.mark.parametrize("quoted", [(0, 20), (0, 17), (15, 35), (30, 50)])
@pytest.mark.parametrize("apart", [0, 30, 60, 200])
def test_passage_of_which_a_part_also_stands_elsewhere(quoted, apart):
    passage, far = [f"p{i}" for i in range(50)], [f"f{i}" for i in range(apart)]
    part = passage[slice(*quoted)]
    shingle = Shingler()
    y = shingle.shingles(" ".join([f"y{i}" for i in range(9)] + passage + ["z"] * 3).encode())
    for words in (part + far + passage, passage + far + part, part + far + part + far + passage + far + part):
        x = shingle.shingles(" ".join(words).encode())
        place = next(i for i in range(len(words)) if words[i:i + 50] == passage)
        # where the part stands right before or after, the passage may reach over it
        assert any(f[0] <= 9 and f[1] >= 54 and f[2] <= place and f[3] >= place + 45 for f in substring_dedup.passages(x, y))
        assert any(f[0] <= place and f[1] >= place + 45 and f[2] <= 9 and f[3] >= 54 for f in substring_dedup.passages(y, x))


def test_passages_of_texts_that_repeat_themselves():
    line = " ".join(f"r{i}" for i in range(11))
    shingle = Shingler()
    for n, m in ((8, 8), (8, 300), (300, 8), (2000, 2000)):
        a, b = (shingle.shingles(" ".join([c] * 30 + [line] * k).encode()) for c, k in (("a", n), ("b", m)))
        found = substring_dedup.passages(a, b)
        assert found and all(f[4] >= 0.75 for f in found)


def test_signatures_meet_at_the_threshold():
    """Pairs of similarity about 0.75, of any size, share a bucket."""
    rng, shingle, signer = random.Random(3), Shingler(), Signer()
    for n in [1, 2, 3, 4, 5, 8, 12, 30, 100, 400] * 12:
        words = [f"{rng.random()}" for _ in range(n + 4)]
        extra = [f"{rng.random()}" for _ in range(n // 3)]
        a, b = shingle(" ".join(words).encode()), shingle(" ".join(words + extra).encode())
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.74
        assert (signer(a) == signer(b)).any() and len(signer(a)) == BANDS


def test_shingler_counts_like_sets():
    shingle = Shingler()
    for text in ["", " \x0b\x0c", "a", "a b c d", "a b c d e", "A b c d e a B c d e a b c d e", "é\xa0É x\x1cy \x00"]:
        assert len(shingle(text.encode())) == len(brute.shingles(text))
    rng = random.Random(8)
    for _ in range(300):  # words, blanks and lengths of every kind
        text = "".join(rng.choice([*"ab \t\n\x0b\x0c\r", "é", "ab ", " " * 90, "x" * 200, "anagram nagaram "]) for _ in range(rng.randint(0, 60)))
        assert len(shingle.word_hashes(text.encode())) == len(brute.words(text))
        assert len(shingle(text.encode())) == len(brute.shingles(text))
    assert (shingle(b"A b") == shingle(b"a B")).all() and shingle(b"a b")[0] != shingle(b"a b a")[0]


def test_encoder_gives_the_tokenizers_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, (encode, width), rng = Tokenizer.from_file(path), encoder(path), random.Random(6)
    signs = [*"abcXYZ .,;:!?#$%&*'\"<>|_-09éÉßΣσςİı日 \u0301\u0308\t\n\x85\x1c\u200b½²Ⅷ👍", "<|endoftext|>", "<|startoftext|>",
             "'s", "'LL", "n't"]
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        assert np.frombuffer(encode([text.encode()])[0], f"<u{width}").tolist() == tokenizer.encode(
            text, add_special_tokens=False).ids, repr(text)


def test_windows_find_every_occurrence():
    items = [("1", b"a b c d e f g h i j k l"), ("2", b"x y"), ("3", b"z"), ("4", b""), ("5", b"x y")]
    w = Windows(items)
    text = words_of(b"z x y, a b c d e f g h i j k x Y; a b c d e f g h i J z")
    ids = np.array([w.number.get(t, 0) for t in text], "<i8")
    place, length, item, at = w.search(ids)
    got = sorted(zip(place.tolist(), length.tolist(), item.tolist(), at.tolist(), strict=True))
    assert got == [(0, 1, 2, 0), (1, 2, 1, 0), (1, 2, 4, 0), (3, 10, 0, 0), (4, 10, 0, 1), (14, 2, 1, 0), (14, 2, 4, 0),
                   (16, 10, 0, 0), (26, 1, 2, 0)]
    assert [len(x) for x in Windows([]).search(ids)] == [0] * 4
