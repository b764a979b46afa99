"""Plain statements of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def repeated_words(docs, size=35):
    """[(doc_id, n_words, n_removed, kept_sha256)] of [(doc_id, text)]."""
    seen = Counter()
    for _, text in docs:
        w = words(text)
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for doc, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((doc, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def repeated_bytes(docs, size=100):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] of [(doc_id, text)] in order."""
    seen, out = set(), []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            own = raw[i : i + size]
            if own in seen:
                gone[i : i + size] = True
            seen.add(own)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        out.append((doc, len(raw), int(gone.sum()), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g))))
    return out


def shingles(text, size=5):
    w = words(text)
    k = min(size, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def probability_jaccard(a, b):
    every = list(a.keys() | b.keys())
    wa, wb = np.array([a[e] for e in every], float), np.array([b[e] for e in every], float)
    return sum(1 / np.maximum(wa / a[d], wb / b[d]).sum() for d in a.keys() & b.keys())


def near_classes(docs, least=0.8):
    """{doc_id: least doc_id of its class} of [(doc_id, text)] with different ids."""
    own = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if own[i] and own[j] and len(own[i].keys() & own[j].keys()) * 4 >= len(own[i]) and (own[i] == own[j] or probability_jaccard(own[i], own[j]) >= least):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        groups[root(i)].append(doc)
    return {doc: min(g) for g in groups.values() for doc in g}


def base_spans(text):
    """(kind, start, end) in code points of the strong secrets."""
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(r"(?i)(?a:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def mix_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """{source: target} of {source: size}: excess over the caps is reshared by weight until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= above
    return out
