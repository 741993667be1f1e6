"""Tokens of whole columns of texts, by their bytes: a set of bytes makes up tokens, all others stand between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
PIECE = 4 << 20


def inside(*outside: int) -> np.ndarray:
    """Which bytes tokens are made of: all but these."""
    out = np.ones(256, bool)
    out[list(outside)] = False
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts (null: none), and where each row's begin; a last offset ends the last row."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, of_token: np.ndarray | None, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first row, bytes, offsets) of about `size` bytes: cut between rows and, given `of_token`, in longer
    rows between tokens, so that several pieces may belong to one row."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, side="right")) - 1)
        a, b = int(offsets[k]), int(offsets[end])
        while of_token is not None and b - a > size:  # then it's one row
            cut = a + size
            while cut < b and of_token[data[cut]]:
                gap = np.flatnonzero(~of_token[data[cut : min(b, cut + 4096)]])
                cut = cut + int(gap[0]) if len(gap) else min(b, cut + 4096)
            yield k, data[a:cut], np.array([0, cut - a])
            a = cut
        yield k, data[a:b], np.append(0, offsets[k + 1 : end + 1] - a)
        k = end


def tokens(data: np.ndarray, offsets: np.ndarray, of_token: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All tokens with A-Z lower-cased, as a binary array, and the row of each."""
    mask = of_token[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts] |= mask[starts]
    at = np.flatnonzero(first)
    ends = np.zeros(len(at) + 1, np.int32)
    if len(at):
        np.cumsum(np.add.reduceat(mask, at, dtype=np.int32), out=ends[1:])
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[data[mask]])])
    return words, np.searchsorted(offsets, at, side="right") - 1
