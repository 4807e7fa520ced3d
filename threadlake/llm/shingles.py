"""Word-shingle sets and SuperMinHash signatures, vectorised over batches of texts."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_MEMO_WORDS = 200_000
_LOOKUPS = 6


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Memo()


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles.

    A-Z are lower-cased; words are runs without white space (space, \\t to \\r). A text of fewer than
    k words is one shingle; one without words, or null, has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(_memo.__getitem__, words), U, n)
    if n < k:
        out = np.asarray([n], U)
        for w in h:
            out = mix(out * _GOLD + w)
        return out
    acc = np.zeros(n - k + 1, U)
    for i in range(k):
        acc = (acc ^ (acc >> U(29))) * _M1 + h[i : n - k + 1 + i] * _GOLD
    return np.unique(mix(acc))


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set: equal sets, equal keys."""
    return xxhash.xxh3_128_digest(s.tobytes())


class SuperMinHash:
    """SuperMinHash (Ertl 2017): each element gives every signature place its own rank, by a random
    permutation drawn step by step, plus a fraction; a place keeps its least value. Ranks of one element
    are correlated, which lowers the variance, and an element stops at the step that no place still waits for.

    The steps run level by level over all elements of a block of sets, so that numpy does the work.
    """

    def __init__(self, places: int):
        self.m = places

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of ``places`` 64-bit values (rank in the upper bits, fraction in the lower) for each non-empty set."""
        m, n = self.m, len(sets)
        sig = np.full((n, m), np.iinfo(U).max, U)
        flat = sig.reshape(-1)
        sizes = np.fromiter(map(len, sets), np.int64, n)
        elem = np.concatenate(sets) if n else np.empty(0, U)
        owner = np.repeat(np.arange(n), sizes)
        swaps: list[np.ndarray] = []  # of each step so far: the place that place j was swapped with
        left: list[np.ndarray] = []  # and what went there
        perm = rows = None
        for j in range(m):
            draw = mix(elem + U((int(_GOLD) * (2 * j + 1)) & (2**64 - 1)))
            k = j + ((draw >> U(40)) * U(m - j) >> U(24)).astype(np.int64)
            if perm is None:  # few steps: look the places up in the swaps
                at_k, at_j = k.copy(), np.full(len(elem), j, np.int64)
                for place, what in zip(swaps, left, strict=True):
                    np.copyto(at_k, what, where=place == k)
                    np.copyto(at_j, what, where=place == j)
            else:  # many steps, which only small sets need: whole permutations
                at_k, at_j = perm[rows, k], perm[rows, j]
                perm[rows, k] = at_j
            np.minimum.at(flat, owner * m + at_k, U(j << 40) | (draw & U((1 << 40) - 1)))
            waiting = (sig >> U(40)).max(axis=1) > j
            if not waiting.any():
                break
            stay = waiting[owner]
            if perm is None:
                swaps, left = [*swaps, k], [*left, at_j]
            if not stay.all():
                elem, owner = elem[stay], owner[stay]
                if perm is None:
                    swaps, left = [x[stay] for x in swaps], [x[stay] for x in left]
                else:
                    rows = rows[stay]
            if j == _LOOKUPS:
                rows = np.arange(len(elem))
                perm = np.broadcast_to(np.arange(m, dtype=np.int16), (len(elem), m)).copy()
                for place, what in zip(swaps, left, strict=True):
                    perm[rows, place] = what
        return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each of a signature's bands."""
    n, m = sig.shape
    rows = m // bands
    acc = np.zeros((n, bands), U)
    part = sig[:, : rows * bands].reshape(n, bands, rows)
    for i in range(rows):
        acc = mix(acc * _GOLD + part[:, :, i])
    return acc


def at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, on whole sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
