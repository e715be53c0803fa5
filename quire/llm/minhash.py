"""Near copies of texts by the similarity of their word shingles: sketches that find candidates, and a search that compares exactly.

A text's shingles are the XXH64 hashes of its runs of words, each once. A sketch has BANDS keys,
each of ROWS minima of the shingles under different hash functions; two texts of similarity J
share a key with probability 1 - (1 - J ** ROWS) ** BANDS: all but some 1e-5 of pairs
at J = 0.8 and 1e-8 at 0.85, and 0.4 % at 0.25. Sharing a key makes a candidate only: search() links
texts whose shingles, not sketches, have a Jaccard similarity of LEAST or more.

Cases: a null or wordless text has no shingle and no key; all of them are one node. A text shorter than a
shingle has one shingle of all its words.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
ROWS, BANDS = 7, 48
LEAST = (4, 5)  # 0.8, as a fraction so that the bound itself is exact
TOGETHER = 1024  # shingles that are hashed at a time
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_random = np.random.RandomState(SEED)
_FLIP = _random.randint(0, 1 << 32, (ROWS * BANDS, 1), np.uint64).astype(np.uint32)
_FACTOR = _random.randint(0, 1 << 32, (ROWS * BANDS, 1), np.uint64).astype(np.uint32) | np.uint32(1)
_MIX = _random.randint(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, A-Z lower-cased, words between ASCII white space."""
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    data, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(data, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    view, n = memoryview(data), len(w) - words + 1
    return np.unique(np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n))


def node(own: np.ndarray) -> int:
    """A number that texts with the same shingles share."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0


def keys(own: np.ndarray) -> np.ndarray:
    """The sketch's keys, one of 64 bits for each band."""
    if not len(own):
        return np.zeros(0, np.uint64)
    low, least = (own >> np.uint64(32)).astype(np.uint32), np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), TOGETHER):
        np.minimum(least, ((low[at : at + TOGETHER] ^ _FLIP) * _FACTOR).min(1), out=least)
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64)


def search(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (index pairs) of a spanning forest of the links among sets of shingles.

    A breadth-first search compares each reached set, through the index of which sets hold a shingle, with
    those not reached yet; the index is made anew as half of its sets are reached.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    term = np.unique(np.concatenate(sets), return_inverse=True)[1] if m else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    own = [term[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    order = np.argsort(term, kind="stable")
    terms, owner = term[order], np.repeat(np.arange(m), sizes)[order]
    count = int(terms[-1]) + 1 if len(terms) else 0
    begin = np.searchsorted(terms, np.arange(count + 1))
    rest, left, indexed = np.ones(m, bool), m, m
    edges: list[tuple[int, int]] = []
    for root in range(m):
        if not rest[root]:
            continue
        rest[root] = False
        left -= 1
        queue = [root]
        while queue and left:
            i = queue.pop()
            if 2 * left < indexed:
                some = rest[owner]
                terms, owner, indexed = terms[some], owner[some], left
                begin = np.searchsorted(terms, np.arange(count + 1))
            start, n = begin[own[i]], begin[own[i] + 1] - begin[own[i]]
            held = owner[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            shared = np.bincount(held, minlength=m)
            near = rest & (LEAST[1] * shared >= LEAST[0] * (sizes[i] + sizes - shared)) & (shared > 0)
            found = np.flatnonzero(near).tolist()
            rest[found] = False
            left -= len(found)
            edges.extend((i, j) for j in found)
            queue.extend(found)
    return edges
