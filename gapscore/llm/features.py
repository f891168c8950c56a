"""Token hashes of whole batches of texts, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; the temporary arrays take about fifty times as much.
STRETCH = 1 << 18

_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = b" \t\n\x0b\x0c\r"
_BYTE[list(_SPACES)] = 0
# 0: white space, 1: letters, digits, underscore and all beyond ASCII, 2: other characters
_CLASS = np.array(
    [0 if b in _SPACES else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], dtype=np.int8
)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a binary column without nulls, and the offsets of its values; nothing is copied."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return body, at


def stretches(body: np.ndarray, at: np.ndarray, size: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, document) of successive parts of at most about ``size`` bytes.

    A part holds whole documents, or a piece of a longer one that ends after white space, if there is any.
    """
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        if at[j] - at[i] <= size:
            yield body[at[i] : at[j]], at[i:j] - at[i], np.arange(i, j)
        else:
            low, end = int(at[i]), int(at[j])
            while low < end:
                high = min(low + size, end)
                if high < end:
                    blank = np.flatnonzero(_CLASS[body[low:high]] == 0)
                    high = low + int(blank[-1]) + 1 if len(blank) else high
                yield body[low:high], np.zeros(1, np.int64), np.array([i])
                low = high
        i = j


def ngram_hashes(part: np.ndarray, starts: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case tokens and token pairs of a part, and the document of each.

    A token is a run of letters and digits, or a run of other characters. Pairs stay in a document.
    """
    if not len(part):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    part = _LOWER[part]
    kind = _CLASS[part]
    fresh = np.ones(len(part), dtype=bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[starts[starts < len(part)]] = True
    fresh &= kind != 0
    first = np.flatnonzero(fresh)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    token = np.cumsum(fresh) - 1
    place = (np.arange(len(part)) - first[token]) & 63
    single = mixed(np.add.reduceat(_BYTE[part] * _PLACE[place], first))
    owner = document[np.searchsorted(starts, first, side="right") - 1]
    together = owner[1:] == owner[:-1]
    pair = mixed(single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:])[together]
    return np.concatenate([single, pair]), np.concatenate([owner, owner[1:][together]])
