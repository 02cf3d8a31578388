"""Word shingles and MinHash labels of texts, in numpy, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n + n // 2 + 1, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words (split at white space) of all texts, and the number in each text."""
    split = [(t or "").lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    flat = " ".join(" ".join(w) for w in split if w).encode("utf-8", "surrogatepass") + b" "
    if not counts.sum():
        return np.empty(0, np.uint64), counts
    raw = np.frombuffer(flat, np.uint8)
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    return mix((sums[ends] - sums[starts]) * down[starts]), counts


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each text. A text of fewer
    words has one shingle of all of them, a text of no words has none."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(size):
        rolled += words[i : i + n] * np.uint64(2 * i + 3)
        rolled = mix(rolled)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= size:
            out.append(np.unique(rolled[end - count : end - size + 1]))
        elif count:
            whole = np.zeros(1, np.uint64)
            for w in words[end - count : end]:
                whole = mix(whole + w)
            out.append(mix(whole + np.uint64(count)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class MinHash:
    """Labels of a forest: for each tree ``depth`` minima, the low 16 bits of each, first minimum first.

    A label is the trees' paths one behind the other, two bytes for each minimum,
    so that a node of a trie is a prefix of a path, and paths sort as bytes do.
    """

    def __init__(self, trees: int, depth: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = trees * depth
        self.trees, self.depth = trees, depth
        self.factors = rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = rng.integers(0, 1 << 63, n, np.uint64)

    def label(self, shingles: np.ndarray, block: int = 2048) -> bytes:
        """The paths of a set; shingles must not be empty."""
        least = None
        for at in range(0, len(shingles), block):
            part = shingles[at : at + block]
            values = ((part[:, None] ^ self.masks) * self.factors >> np.uint64(24)).min(axis=0)
            least = values if least is None else np.minimum(least, values)
        return (mix(least) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def paths_of(labels: list[bytes], trees: int) -> np.ndarray:
    """Minima of labels, (rows, trees, depth)."""
    return np.frombuffer(b"".join(labels), ">u2").reshape(len(labels), trees, -1)
