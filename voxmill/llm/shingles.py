"""Sets of hashed word shingles, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased, split at white space), and the words per text."""
    raw = [t.encode().lower() for t in texts]
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    edge = np.diff((~_space[buf]).astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * STEP)
    ends = np.cumsum([len(r) + 1 for r in raw])
    return h, np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(texts))


def shingle_sets(texts: list[str], words: int = 5, piece: int = 1_000_000) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of `words` words of each text; of all its words where it has fewer."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end]) <= piece):
            size += len(texts[end])
            end += 1
        h, counts = word_hashes(texts[k:end])
        run = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for i in range(words):
            run = run * STEP + h[i : i + len(run)]
        run = mixed(run)
        at = 0
        for n in counts.tolist():
            if n >= words:
                out.append(np.unique(run[at : at + n - words + 1]))
            elif n:
                x = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in h[at : at + n]:
                        x = x * BASE + w
                out.append(mixed(np.array([x], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        k = end
    return out


def signature(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of the upper 32 bits of each factor times each element, as int32."""
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(own), 1024):
        low = np.minimum(low, ((own[k : k + 1024, None] * factors) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return low.view(np.int32)


def factors_of(n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, (1 << 63) - 1, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_hashes(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in any order of its elements."""
    a, b = mixed(own + STEP).sum(dtype=np.uint64), mixed(own ^ BASE).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
