"""Plain versions of the corpus operators, for small tables."""

import re
from collections import Counter

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


class Sets:
    def __init__(self, ids):
        self.root = {i: i for i in ids}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def jaccard(docs):
    """{id: (shingles, component)}; docs: {id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    found = Sets(docs)
    inverted = {}
    for i, s in sets.items():
        for t in s:
            inverted.setdefault(t, []).append(i)
    for i, s in sets.items():
        seen = Counter(j for t in s for j in inverted[t])
        for j, n in seen.items():
            if j < i and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                found.tie(i, j)
    return {i: (len(sets[i]), found.find(i)) for i in docs}


def cut_repeats(docs, length=50):
    """{id: (spans, kept)}; docs: {id: bytes}."""
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - length + 1):
            first.setdefault(docs[i][k : k + length], i)
    out = {}
    for i, b in docs.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out
