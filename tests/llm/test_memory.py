"""What Python processes remember is bounded in bytes; long documents teach the dictionary."""

from __future__ import annotations

import random
import string

import public_tokenizers
from tokenizers import Tokenizer

from sensor_yield.llm import token_files, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_unbroken_runs_are_not_remembered(monkeypatch):
    cache: dict = {}
    monkeypatch.setattr(token_files, "process_cache", lambda: cache)
    encode, _ = token_files.encoder(PATH)
    rng = random.Random(1)
    plain = Tokenizer.from_file(PATH)
    for i in range(300):
        run = "".join(rng.choices("漢字仮名交じり文" if i % 2 else string.ascii_letters, k=2000))
        text = f"some words {run} and more"
        ids = plain.encode(text, add_special_tokens=False).ids
        got = encode([text.encode()])[0]
        assert [int.from_bytes(got[k:k + 2], "little") for k in range(0, len(got), 2)] == ids
    held = cache[("encoder", PATH)]
    remembered = [*held["runs"].items(), *held["cores"].items()]
    assert max(len(k) for k, _ in remembered) <= token_files.MEMORY_BYTES and len(remembered) < 20


def test_a_block_encodes_every_distinct_word_once(monkeypatch):
    monkeypatch.setattr(token_files, "process_cache", dict)
    monkeypatch.setattr(token_files, "MEMORY_RUNS", 0)  # nothing is kept from call to call
    asked = []

    class Counted:
        @staticmethod
        def from_file(path):
            return Spy(Tokenizer.from_file(path))

    class Spy:
        def __init__(self, inner):
            self.inner, self.get_vocab_size, self.encode = inner, inner.get_vocab_size, inner.encode
            self.model = self

        def tokenize(self, word):
            asked.append(word)
            return self.inner.model.tokenize(word)

    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    encode, _ = token_files.encoder(PATH)
    rng = random.Random(5)
    words = ["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(300)]
    texts = [" ".join(rng.choice((w, w.title(), w + ",", w.upper() + "!!")) for w in rng.choices(words, k=200)) for _ in range(50)]
    got, plain = encode([t.encode() for t in texts]), Tokenizer.from_file(PATH)
    assert [len(x) // 2 for x in got] == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sorted(asked) == sorted(words)


def test_texts_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 50)
    encode, _ = token_files.encoder(PATH)
    rng, plain = random.Random(7), Tokenizer.from_file(PATH)
    texts = ["", " \t", *("".join(rng.choices("abÉß日.,<' \n", k=rng.randint(0, 400))) for _ in range(200)), "x" * 300, ""]
    for text, ids in zip(texts, encode([t.encode() for t in texts]), strict=True):
        want = plain.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(ids[k:k + 2], "little") for k in range(0, len(ids), 2)] == want


def test_long_words_and_states_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMORY_STATES", 50)
    matcher = toxicity.Matcher([("stupid", 3.0), ("worthless", 3.0), ("idio*", 2.0)])
    rng = random.Random(2)
    for _ in range(300):
        n, hits = matcher.hits(" ".join(["".join(rng.choices(string.ascii_lowercase, k=400)), "idiot" + "x" * 90, "stupidd"]))
        assert n == 3 and sorted(h[:2] for h in hits) == [(0, 1), (2, 0)]
    assert max(map(len, matcher.known)) <= toxicity.MEMORY_LETTERS
    assert all(len(a.next) <= 50 + 20 for a in matcher.automata)


def test_long_documents_train_the_dictionary(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=4000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(token_files.train_dictionary(docs, PATH, 2)) > 1000
