"""Vectorised text kernels shared by the Arrow-batched operators.

Everything here runs inside executor Python workers on one Arrow batch at a time; no Python object is made per word.
A *word* is a maximal run of bytes outside ``20 09-0D`` (the pattern ``[^\\x20\\x09-\\x0D]+``); UTF-8 continuation bytes never
collide with those separators, so the work can be done on encoded bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII characters other than letters and digits separate words in the folded view.
_FOLD_SEP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers = {"up": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    up = _powers["up"]
    if len(up) < n:
        steps = np.full(max(n, 1 << 16), _BASE, np.uint64)
        steps[0] = 1
        up = _powers["up"] = np.cumprod(steps, dtype=np.uint64)
    return up


def pack(texts) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes with one newline after every text, and the offset where each text starts (plus the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8), offsets


class Words:
    """Words of a batch: ``hash`` (uint64), ``start``/``end`` byte positions in ``buf`` and ``doc`` boundaries.

    ``doc[i]:doc[i+1]`` is the range of words that belong to text i.
    """

    def __init__(self, texts, folded: bool = False):
        buf, offsets = pack(texts)
        sep = (_FOLD_SEP if folded else _SPACE)[buf]
        self.buf = buf = _LOWER[buf]
        edge = np.empty(len(buf), bool)
        if len(buf):
            edge[0] = not sep[0]
            np.not_equal(sep[1:], sep[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        self.start, self.end = at[0::2], at[1::2]
        self.doc = np.searchsorted(self.start, offsets)
        self.offsets = offsets
        self._sep = sep

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word, computed over blocks so that scratch memory stays a few MB."""
        out = np.empty(len(self.start), np.uint64)
        block = 1 << 20
        lo = 0
        while lo < len(self.start):
            first = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, first + block)))
            s, e = self.start[lo:hi] - first, self.end[lo:hi] - first
            n = int(e[-1])
            up = _power_table(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.buf[first : first + n].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=total[1:])
            # the sum carries a factor base**start: divide by it (the base is odd, hence invertible)
            out[lo:hi] = (total[e] - total[s]) * _inverse_table(n + 1)[s]
            lo = hi
        return mix64(out)


def _inverse_table(n: int) -> np.ndarray:
    inv = _powers.get("down")
    if inv is None or len(inv) < n:
        base = pow(int(_BASE), -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        steps[0] = 1
        inv = _powers["down"] = np.cumprod(steps, dtype=np.uint64)
    return inv


def sum_by_doc(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sum of ``values[doc[i]:doc[i+1]]`` for every i, empty ranges give 0."""
    out = np.zeros(len(doc) - 1, np.float64)
    full = doc[1:] > doc[:-1]
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), doc[:-1][full])
    return out


def batches_of(texts, most: int = 4 << 20):
    """Cuts a pandas Series of texts so that no piece holds more than ``most`` characters unless one text alone does."""
    part = (np.cumsum(texts.str.len().fillna(0).to_numpy(np.float64)) // most).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        if b > a:
            yield texts.iloc[a:b]
