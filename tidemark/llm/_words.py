"""Hashes of words and word n-grams over whole Arrow batches of texts, in NumPy and without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_Q = 0xC2B2AE3D27D4EB4F
_Q_INV = pow(_Q, -1, 2**64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are hashed at once; a longer text makes a chunk of its own.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_ANY = _BYTE.copy()
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
#: For word_hashes(kind="letters"): ASCII letters, digits and every byte of a longer UTF-8 sequence make words.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= CHUNK:  # longer ones are for one very long text
            _POWERS[base] = have
    return have[:n]


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of about CHUNK bytes; null counts as empty."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, index of each document's first word, with the end). letters: words are runs of letters and digits, else of anything but white space."""
    outside = ~_LETTER[data] if letters else _SPACE[data]
    values = (_LOWER if lower else _BYTE)[data]
    if letters:
        values[outside] = 0
    first = ~outside
    first[1:] &= outside[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = ~outside[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
    values *= _powers(_P, len(data))
    raw = np.add.reduceat(values, starts) * _powers(_P_INV, len(data))[starts]
    return mix(raw), starts, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(_P) + words[i : len(words) - n + 1 + i]
    return mix(total)


def byte_grams(data: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of the n bytes from each place on; the last n - 1 places have none. second: another hash."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    base, inverse = (_Q, _Q_INV) if second else (_P, _P_INV)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_ANY[data] * _powers(base, len(data)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _powers(inverse, len(data))[: len(data) - n + 1])


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word, from word_hashes' last result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def released() -> None:
    """Gives free memory, Arrow's and the C library's, back to the system at the end of a task, for Python workers live on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary array of the items' bytes; lengths counts items of data."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
