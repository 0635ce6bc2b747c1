"""Plain, single-threaded versions that operators are held against."""

import numpy as np


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, resolution: float = 1.0, gain: float = 1e-4, levels: int = 10) -> np.ndarray:
    """Community of each of ``n`` nodes of a weighted graph: nodes move to the neighbouring community of most gain, then communities become nodes."""
    of = np.arange(n)
    m = float(w.sum())
    if m <= 0:
        return of
    last = -1.0
    for _ in range(levels):
        k = np.bincount(a, w, n) + np.bincount(b, w, n)
        ends, other, both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        far = ends != other
        ends, other, both = ends[far], other[far], both[far]
        order = np.argsort(ends, kind="stable")
        other, both = other[order].tolist(), both[order].tolist()
        first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
        own, weight, deg = list(range(n)), k.tolist(), k.tolist()
        moved = True
        while moved:
            moved = False
            for x in range(n):
                here, d = own[x], deg[x]
                links: dict[int, float] = {}
                for j in range(first[x], first[x + 1]):
                    c = own[other[j]]
                    links[c] = links.get(c, 0.0) + both[j]
                weight[here] -= d
                best, most = here, links.get(here, 0.0) - resolution * weight[here] * d / (2 * m)
                for c in sorted(links):
                    got = links[c] - resolution * weight[c] * d / (2 * m)
                    if got > most + 1e-12:
                        best, most = c, got
                weight[best] += d
                if best != here:
                    own[x], moved = best, True
        names, flat = np.unique(own, return_inverse=True)
        of = flat[of]
        a, b = flat[a], flat[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        key, at = np.unique(a.astype(np.int64) * len(names) + b, return_inverse=True)
        w = np.bincount(at, w)
        a, b, n = key // len(names), key % len(names), len(names)
        inside = np.bincount(a[a == b], w[a == b], n) / m
        q = float((inside - resolution * ((np.bincount(a, w, n) + np.bincount(b, w, n)) / (2 * m)) ** 2).sum())
        if q - last < gain:
            break
        last = q
    return of
