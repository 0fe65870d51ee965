"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter


def words(text):
    return (text or "").encode().split()


def shingles(text):
    own = (text or "").encode().lower().split()
    if not own:
        return set()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if len(own) >= 5 else {tuple(own)}


def smallest_reachable(ids, links):
    least = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            for x in (a, b):
                if least[x] != low:
                    least[x], moved = low, True
    return least


def near_groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = []
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                links.append((i, j))
    return {i: len(sets[i]) for i in ids}, smallest_reachable(ids, links)


def without_repeats(texts):
    first = {}
    for i in sorted(texts):
        own = words(texts[i])
        for k in range(len(own) - 12):
            first.setdefault(tuple(own[k : k + 13]), i)
    out = {}
    for i, text in texts.items():
        own = words(text)
        gone = [False] * len(own)
        for k in range(len(own) - 12):
            if first[tuple(own[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out[i] = (len(own), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def normalised(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def bag(text):
    own = re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return Counter(zip(own, own[1:]))


def dice(a, b):
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector of numbers); every distance compared, in Python integers."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = [v for _, v in sorted(ints)[:entries]]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        homes = [[nearest(v, p)[1] for _, v in ints] for p in range(parts)]
        for p in range(parts):
            for k in range(len(first)):
                own = [cut(v, p) for (_, v), h in zip(ints, homes[p]) if h == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, v in ints:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, bytes(k for _, k in best).hex(), sum(d for d, _ in best)))
    text = ",".join(str(c) for b in books for e in b for c in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in found]


def ranked(docs, items, k=50):
    """docs, items: lists of (id, text); every document scored for every item."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scored = []
        for (i, c), size in zip(own, sizes):
            m = 50 + (50 * size * n) // max(1, length)
            score = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def without_repeated_strings(rows, width=200):
    """rows: (doc_id, text), each a document; sorted (doc_id, n_bytes, n_removed, n_spans, sha256)."""
    own = [(text or "").encode() for _, text in rows]
    seen = Counter(t[k : k + width] for t in own for k in range(len(t) - width + 1))
    out = []
    for (i, _), text in zip(rows, own):
        gone, last = bytearray(len(text)), 0
        for k in range(len(text) - width + 1):
            if seen[text[k : k + width]] > 1:
                gone[max(k, last) : k + width] = b"\1" * (k + width - max(k, last))
                last = k + width
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)
