"""The operators' contracts in plain loops."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def closure(ids, linked):
    """Smallest id reachable, by repeated minima; ``linked`` is a boolean matrix."""
    label = np.array(ids)
    linked = linked | np.eye(len(ids), dtype=bool)
    while True:
        new = np.array([label[linked[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def fingerprint(text):
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(lowered)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def simhash(docs):
    """{doc_id: (fingerprint, component)} of [(doc_id, text)]."""
    fp = {i: fingerprint(t) for i, t in docs}
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], np.uint64)
    groups = closure(ids, np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    return {i: (f"{fp[i]:016x}", groups[i]) for i in ids}


def embedding_links(rows, threshold):
    """{vec_id: (n_links, component_id, kept)} of [(vec_id, vector, label)]."""
    out, by_label = {}, defaultdict(list)
    for i, v, label in rows:
        out[i] = (0, i, True)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by_label[label, len(v)].append((i, v))
    for group in by_label.values():
        ids = [i for i, _ in group]
        x = np.array([np.array(v) / max(map(abs, v)) for _, v in group])
        x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, True)
        component = closure(ids, near)
        for n, i in enumerate(ids):
            out[i] = (int(near[n].sum()) - 1, component[i], component[i] == i)
    return out


def without_repeats(docs, length=13):
    """{doc_id: (n_words, n_removed, digest)} of [(doc_id, text)]."""
    found = {i: words(t) for i, t in docs}
    first = {}
    for i in sorted(found):
        for k in range(len(found[i]) - length + 1):
            first.setdefault(tuple(found[i][k : k + length]), i)
    out = {}
    for i, w in found.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
