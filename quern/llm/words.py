"""Words as slices of one buffer, so that distinct ones are found and looked up without an object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def binary(offsets: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """The values that offsets cut data into."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array without nulls, from 0 on."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def gather(store: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of store that codes name, one after the other, and where each ends."""
    lens = size[codes]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return store[np.repeat(first[codes] - (ends - lens), lens) + np.arange(total)], ends


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted values, each once: by sorting, which is faster here than the hash table of numpy.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x
