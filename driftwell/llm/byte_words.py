"""Words of a batch of texts, cut out of its bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text that is cut at once; a longer text is cut alone.
CHUNK_BYTES = 4 << 20


def byte_class(separators: bytes) -> np.ndarray:
    """Which bytes belong to words: all but ``separators``."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row past the last, borders, bytes)`` of stretches of rows; row ``i`` has the bytes between two borders."""
    column = texts.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, borders[i : j + 1] - borders[i], data[borders[i] : borders[j]]
        i = j


def cut(borders: np.ndarray, data: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows in order, as binary values, and how many each row has; none reaches over a row's border."""
    keep = inside[data]
    if not keep.any():
        return pa.array([], pa.large_binary()), np.zeros(len(borders) - 1, np.int64)
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    edge = borders[(borders > 0) & (borders < len(data))]
    first[edge] = keep[edge]
    last[edge - 1] = keep[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
    return words, np.diff(np.searchsorted(starts, borders))


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal ones, and the different words by number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over their range, one to one."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
