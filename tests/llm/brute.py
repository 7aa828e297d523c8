"""Plain versions of the contracts, over lists."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text):
    w = words(text, True)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}


def without_repeats(texts, window=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i: i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i: i + window]] > 1:
                gone[i: i + window] = b"\1" * window
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def statistics(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i: i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def components(rows, percent):
    """{doc_id: least id reachable} for rows of (doc_id, text); rows without an id are left out."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def contained(docs, items, percent):
    held = [(i, shingles(t)) for i, t in items]
    return [(d, i, len(s), len(s & mine)) for d, t in docs for mine in [shingles(t)] for i, s in held
            if s and 100 * len(s & mine) >= percent * len(s)]
