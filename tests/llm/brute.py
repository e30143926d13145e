"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if fold else text)


class Groups:
    def __init__(self, names):
        self.up = {x: x for x in names}

    def top(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(rows):
    """rows: (id, text). id -> (set size, component, kept)."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    groups, holders = Groups([i for i, _ in sets]), defaultdict(list)
    for k, (i, s) in enumerate(sets):
        shared = Counter(other for g in s for other in holders[g])
        for other, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[other][1]) - n):
                groups.join(i, sets[other][0])
        for g in s:
            holders[g].append(k)
    sizes = defaultdict(int)
    for i, s in sets:
        sizes[i] = max(sizes[i], len(s))
    return {i: (n, groups.top(i), groups.top(i) == i) for i, n in sizes.items()}


def passages(rows, window=50):
    """rows: (id, text). Sorted (id, words, removed, digest of what stays)."""
    split = [(i, words(t)) for i, t in rows if i is not None]
    first = {}
    for i, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def repeated_bytes(rows, window=100):
    """rows: (id, text). Sorted (id, bytes, removed, runs, digest of what stays)."""
    raw = [(i, (t or "").encode()) for i, t in rows if i is not None]
    first = {}
    for i, x in raw:
        for s in range(len(x) - window + 1):
            key = x[s : s + window]
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - window + 1):
            if first[x[s : s + window]] < (i, s):
                gone[s : s + window] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(x) else 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def contamination(rows, items):
    """rows: (id, text), items: (id, text). {(id, item)} with a window of weighted similarity 0.75 and more."""
    held = {}
    for item, text in items:
        w = words(text, True)
        if item is not None and w:
            size = min(5, len(w))
            held[item, len(held)] = (len(w), size, Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)))
    holders = Counter(g for _, _, c in held.values() for g in c)
    weight = defaultdict(lambda: round(16 * (1 + np.log(max(len(held), 1)))))
    for g, n in holders.items():
        weight[g] = round(16 * (1 + np.log(len(held) / n)))
    out = set()
    for i, text in rows:
        w = words(text, True)
        for (item, _), (length, size, mine) in held.items():
            # A text of fewer words is one window.
            for s in range(max(1, len(w) - length + 1)) if i is not None else ():
                window = Counter(tuple(w[k : k + size]) for k in range(s, min(s + length, len(w)) - size + 1))
                if not window.keys() & mine.keys():
                    continue
                low = sum(min(window[g], mine[g]) * weight[g] for g in window.keys() | mine.keys())
                high = sum(max(window[g], mine[g]) * weight[g] for g in window.keys() | mine.keys())
                if 100 * low >= 75 * high:
                    out.add((i, item))
    return out


def vector_links(rows, least=0.9):
    """rows: (id, vector). id -> (links, component, kept)."""
    fit = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    ]
    groups, links = Groups([i for i, _ in rows if i is not None]), Counter()
    for a, (i, x) in enumerate(fit):
        for j, y in fit[a + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    return {i: (links[i], groups.top(i), groups.top(i) == i) for i, _ in rows if i is not None}
