"""The pipeline's stages from language to repeats, by brute force on a small table."""

import numpy as np

from rangewarden.llm.simhash import shingle_hashes

LAST = (1 << 63) - 1


def place(r):
    return LAST if r["doc_id"] is None else r["doc_id"]


def language(rows):
    return [r for r in rows if any(c.isalpha() for c in r["text"] or "")]


def exact(rows):
    best = {}
    for r in rows:
        body = (r["text"] or "").encode().lower()
        if body not in best or place(r) < place(best[body]):
            best[body] = r
    return list(best.values())


def near(rows):
    sets = [frozenset(shingle_hashes(r["text"] or "", 5)) for r in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    a, b = sorted((a, b), key=lambda x: place(rows[x]))
                    at[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def repeats(rows, size=50):
    first = {}
    for r in rows:
        b = r["text"].encode()
        for s in range(len(b) - size + 1):
            first[b[s : s + size]] = min(first.get(b[s : s + size], LAST), place(r))
    out = []
    for r in rows:
        b = r["text"].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < place(r):
                gone[s : s + size] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")
        out.append({**r, "text": left, "n_chars": len(left)})
    return out
