"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None, pattern: re.Pattern = SPACED) -> list[str]:
    return pattern.findall(lower(text or ""))


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


class Groups:
    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def near_duplicates(docs: dict) -> dict:
    """doc_id -> (number of shingles, component)."""
    sets, holders, groups = {d: shingles(t) for d, t in docs.items()}, defaultdict(list), Groups()
    for d, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for e in holders[g]:
                common[e] += 1
            holders[g].append(d)
        for e, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                groups.join(d, e)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def decontaminate(docs: dict, items: dict) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    for item, text in items.items():
        w = words(text, ALNUM)
        for at in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[at:at + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs.items():
        w, hit, found = words(text, ALNUM), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if tuple(w[at:at + n]) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[tuple(w[at:at + n])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def targets(sizes: dict) -> dict:
    """source -> target, resharing what exceeds twice a source's size until nothing does."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {**share, **fixed}
        fixed.update({s: 2.0 * sizes[s] for s in over})


def repeated_documents(docs: dict, n: int = 50) -> tuple[set, Groups]:
    """Documents that share n consecutive words with another, and their groups."""
    holders, groups = defaultdict(set), Groups()
    for d, text in docs.items():
        w = words(text)
        for at in range(len(w) - n + 1):
            holders[tuple(w[at:at + n])].add(d)
    found = set()
    for group in holders.values():
        if len(group) > 1:
            found |= group
            for d in group:
                groups.join(min(group), d)
    return found, groups


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def collocations(rows: list, max_words: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> list:
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows, by counting every phrase."""
    langs = defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            langs["und" if lang is None else lang].append(re.findall(r"[^\x20\x09]+", piece))
    out = []
    for lang, pieces in langs.items():
        f = defaultdict(int)
        for p in pieces:
            for k in range(1, max_words + 1):
                for s in range(len(p) - k + 1):
                    f[tuple(p[s:s + k])] += 1
        n = sum(map(len, pieces))
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        around = defaultdict(int)
        for g, a in cands.items():
            for k in range(2, len(g)):
                for s in range(len(g) - k + 1):
                    around[g[s:s + k]] = max(around[g[s:s + k]], a)
        kept = []
        for g, a in cands.items():
            if around[g] and 100 * around[g] >= share * a:
                continue
            score, k = min((10 ** 6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n, -score) for i, (score, a, p, le, r) in enumerate(sorted(kept)[:top], 1)]
    return out
