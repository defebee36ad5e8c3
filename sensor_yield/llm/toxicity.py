"""Toxicity scores: a learned lexicon, Levenshtein automata over its trie, context windows.

Lexicon: of the labelled training texts every word and word beginning is counted once per
text and class; those that a likelihood-ratio test ties to the toxic class become terms.
Automaton: the trie of the terms is intersected with the Levenshtein automaton (one edit from
five letters on, two from eight) and determinised as words come by, so a word is read once,
letter by letter, whatever the size of the lexicon; misspelled terms are met like exact ones.
A term whose near misses are no rarer in clean calibration texts loses its tolerance.
Context: a hit inside quotation marks or beside a word of reporting counts as quoted; a hit
beside a word of address counts as direct. Each kind of hit has its own features, so a
quotation does not weigh like abuse.
Score: logistic regression with a ridge, fitted on the calibration fold.

Labels are read only for rows whose crc32(doc_id as text) mod 5 is 1 to 3 (lexicon) and 4
(calibration); 0 is held out. At most ``max_labelled`` labelled rows are used, those with the
smallest hash of their id: a documented bound of the classifier's sample. The text is the only
input of a score. Scoring is one narrow pass over whole texts.

Defined cases: null or empty text has no hits and the score of such a text; labels without
id or class are ignored, of contradicting labels of an id the toxic one holds; without
training texts of both classes nothing is toxic (score 0); rows that repeat are scored alike;
other columns pass through untouched; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensor_yield.llm.common import arrow_rows
from sensor_yield.llm.files import text_bytes

MAX_LABELLED = 20_000
MAX_TERMS = 4_000
#: Least likelihood-ratio statistic of a term; least and greatest length of a word beginning.
LEAST_RATIO = 20.0
SHORTEST, LONGEST = 3, 9
WINDOW = 6
#: Remembered words per Python process, their greatest length, and states of an automaton.
MEMORY_WORDS, MEMORY_LETTERS, MEMORY_STATES = 300_000, 32, 500_000
# fixed values: words of reporting and of address in four languages, and quotation marks
REPORTING = frozenset("said says wrote called quoted quote dit écrit sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your you're u ur du dein dich dir tu ton toi te vous votre tú usted eres".split())
QUOTES = "\"“”„«»"
#: A word: letters, with single digits or signs that stand for letters inside it.
WORD = re.compile(r"[^\W\d_]+(?:[\d@$*!][^\W\d_]+)*")


def held_out(id_col: str | Column = "doc_id") -> Column:
    return fold(id_col) == 0


def fold(id_col: str | Column = "doc_id") -> Column:
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def beginnings(word: str) -> list[str]:
    """The terms a word counts for: itself, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in range(SHORTEST, min(len(word), LONGEST) + 1))]


class Automaton:
    """Levenshtein automaton over the trie of the whole-word terms, determinised on demand."""

    def __init__(self, terms: dict[str, int], edits: int):
        self.edits, self.children, self.ends = edits, [{}], [-1]
        for term, number in terms.items():
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][letter]
            self.ends[node] = number
        self.start = self._closed({0: 0})
        self.next: dict[frozenset, dict[str, frozenset]] = {}

    def _closed(self, errors: dict[int, int]) -> frozenset:
        """Adds what is reached by letters missing from the word; keeps the fewest edits."""
        waiting = list(errors)
        while waiting:
            node = waiting.pop()
            if errors[node] < self.edits:
                for child in self.children[node].values():
                    if errors.get(child, self.edits + 1) > errors[node] + 1:
                        errors[child] = errors[node] + 1
                        waiting.append(child)
        return frozenset(errors.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        out: dict[int, int] = {}
        for node, e in state:
            if e < self.edits:
                out[node] = min(out.get(node, 9), e + 1)  # a letter too many
            for other, child in self.children[node].items():
                cost = e + (other != letter)
                if cost <= self.edits:
                    out[child] = min(out.get(child, 9), cost)
        return self._closed(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number) of the nearest term, if one is near enough."""
        if len(self.next) > MEMORY_STATES:
            self.next.clear()
        state = self.start
        for letter in word:
            known = self.next.setdefault(state, {})
            if letter not in known:
                known[letter] = self._step(state, letter)
            state = known[letter]
            if not state:
                return None
        return min(((e, self.ends[n]) for n, e in state if self.ends[n] >= 0), default=None)


class Matcher:
    """Finds the lexicon's terms in texts. A hit is (term number, edits, quoted, direct)."""

    def __init__(self, terms: list[tuple[str, float]], strict: frozenset = frozenset()):
        self.weights = [w for _, w in terms]
        self.stems = {t[:-1]: i for i, (t, _) in enumerate(terms) if t.endswith("*")}
        whole = {t: i for i, (t, _) in enumerate(terms) if not t.endswith("*")}
        self.whole = whole
        loose = {t: i for t, i in whole.items() if i not in strict and len(t) >= 5}
        self.automata = [Automaton({t: i for t, i in loose.items() if len(t) < 8}, 1),
                         Automaton({t: i for t, i in loose.items() if len(t) >= 8}, 2)]
        self.known: dict[str, tuple[int, int] | None] = {}

    def lookup(self, word: str) -> tuple[int, int] | None:
        """(number, edits) of the heaviest exact term of a word, else of its nearest one."""
        exact = [self.whole[word]] if word in self.whole else []
        exact += [self.stems[word[:k]] for k in range(SHORTEST, min(len(word), LONGEST) + 1) if word[:k] in self.stems]
        if exact:
            return max(exact, key=lambda i: self.weights[i]), 0
        near = min((m for m in (a.match(word) for a in self.automata) if m), default=None)
        return (near[1], near[0]) if near else None

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, bool, bool]]]:
        """Number of distinct words, and the hits of a text."""
        lowered = text.lower()
        distinct = set(WORD.findall(lowered))
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        known, long = self.known, {}
        for word in distinct.difference(known):
            # long words are not remembered: what is stays bounded in bytes, too
            (known if len(word) <= MEMORY_LETTERS else long)[word] = self.lookup(word)
        marked = {w: known[w] for w in (distinct.difference(long) if long else distinct) if known[w]}
        marked.update((w, hit) for w, hit in long.items() if hit)
        if not marked:
            return len(distinct), []
        found, spans = [], list(WORD.finditer(lowered))
        words = [m.group() for m in spans]
        for i, word in enumerate(words):
            if word in marked:
                near = words[max(0, i - WINDOW):i] + words[i + 1:i + 1 + WINDOW]
                before = lowered[spans[max(0, i - WINDOW)].start():spans[i].start()]
                after = lowered[spans[i].end():spans[min(len(spans) - 1, i + WINDOW)].end()]
                inside = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
                found.append((*marked[word], inside or not REPORTING.isdisjoint(near), not ADDRESS.isdisjoint(near)))
        return len(distinct), found


def features(weights: list[float], distinct: int, hits: list[tuple[int, int, bool, bool]]) -> list[float]:
    """Plain, misspelled, quoted and direct hits, each as a sum of weights; their greatest; their
    density; the number of terms; the length."""
    sums, times = [0.0] * 4, Counter()
    top = 0.0
    for number, edits, quoted, direct in hits:
        times[number] += 1
        if times[number] > 3:  # a text that repeats one word says no more by it
            continue
        w = weights[number] / (1 + edits)
        if quoted:
            sums[2] += w
            continue
        sums[1 if edits else 0] += w
        sums[3] += w * direct
        top = max(top, w)
    plain = sums[0] + sums[1]
    return [math.log1p(plain), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(sums[3]), top,
            plain / math.sqrt(distinct + 5), plain / (distinct + 5), math.log1p(len(times)), math.log1p(distinct)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients (intercept first) by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> DataFrame:
    """doc_id, text, toxic, fold of the labelled training rows. The labels, at most
    ``max_labelled`` of some 40 bytes, go to the documents."""
    sample = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(sample), "doc_id").withColumn("fold", fold())


def learn_terms(training: DataFrame) -> list[tuple[str, float]]:
    """Terms with their log odds, from (text, toxic) rows; at most MAX_TERMS."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_pydict({"term": list(counts), "pos": [c[1] for c in counts.values()],
                                               "neg": [c[0] for c in counts.values()]})
        for batch in batches:
            for text, toxic in zip(text_bytes(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                seen = {t for w in set(WORD.findall(text.decode().lower())) for t in beginnings(w)}
                for t in seen | {""}:  # the empty term counts the texts
                    counts.setdefault(t, [0, 0])[toxic] += 1
            if len(counts) > MEMORY_WORDS:
                yield out()
                counts = {}
        if counts:
            yield out()

    found = (training.select("text", "toxic").mapInArrow(count, "term string, pos bigint, neg bigint")
             .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3 OR term = ''"))
    total = found.where("term = ''").first()
    if total is None or not total.pos or not total.neg:
        return []
    n_pos, n_neg = float(total.pos), float(total.neg)
    share = n_pos / (n_pos + n_neg)
    both = F.col("pos") + F.col("neg")
    ratio = 2 * (F.col("pos") * F.log(F.col("pos") / (both * share))
                 + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - share)))).otherwise(0.0))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    best = (found.where("term <> ''").select("term", ratio.alias("ratio"), odds.alias("odds"))
            .where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > 1))
            .orderBy(F.desc("ratio"), "term").limit(MAX_TERMS))
    return sorted((r.term, float(r.odds)) for r in best.collect())


def _hit_rows(rows: DataFrame, terms: list[tuple[str, float]]) -> list:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        kind = pa.list_(pa.struct([("n", pa.int32()), ("e", pa.int32()), ("q", pa.bool_()), ("d", pa.bool_())]))
        for batch in batches:
            found = [matcher.hits(t.decode()) for t in text_bytes(batch.column("text"))]
            hits = [[dict(zip("neqd", h, strict=True)) for h in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([f[0] for f in found], pa.int64()),
                                              pa.array(hits, kind)], ["toxic", "words", "hits"])

    schema = "toxic int, words bigint, hits array<struct<n: int, e: int, q: boolean, d: boolean>>"
    return [(r.toxic, r.words, [tuple(h) for h in r.hits])
            for r in rows.select("text", "toxic").mapInArrow(find, schema).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED) -> dict:
    """The model: terms, terms without tolerance, and the regression."""
    arrow_rows(docs.sparkSession)
    rows = _labelled(docs, labels, id_col, text_col, max_labelled)
    terms = learn_terms(rows.where("fold IN (1, 2, 3)"))
    found = _hit_rows(rows.where("fold = 4"), terms)
    y = np.array([r[0] for r in found], float)
    if not terms or len(set(y)) < 2:
        return {"terms": terms, "strict": frozenset(), "regression": None}
    near = {label: Counter(n for t, _, hits in found if t == label for n in {h[0] for h in hits if h[1]})
            for label in (0, 1)}
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    strict = frozenset(n for n in near[0] if (near[1][n] + 0.5) / (n_pos + 1) < 2 * (near[0][n] + 0.5) / (n_neg + 1))
    weights = [w for _, w in terms]
    x = np.array([features(weights, words, [h for h in hits if not h[1] or h[0] not in strict])
                  for _, words, hits in found])
    return {"terms": terms, "strict": strict, "regression": fit_logistic(x, y)}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``doc`` (a struct of the columns of ``docs``) and score."""
    spark = docs.sparkSession
    arrow_rows(spark)
    held = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        matcher = Matcher(known["terms"], known["strict"])
        for batch in batches:
            x = np.array([features(matcher.weights, *matcher.hits(t.decode()))
                          for t in text_bytes(batch.column("text"))]).reshape(batch.num_rows, -1)
            p = np.zeros(batch.num_rows)
            if known["regression"] is not None and batch.num_rows:
                mean, scale, w = known["regression"]
                p = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(p, pa.float64())], ["doc", "score"])

    rows = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judge, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **columns) -> DataFrame:
    """``docs`` without the documents scored as toxic."""
    text = {"text_col": columns["text_col"]} if "text_col" in columns else {}
    return score(docs, fit(docs, labels, **columns), **text).where(F.col("score") < threshold).select("doc.*")
