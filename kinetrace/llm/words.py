"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space and 0x09 to 0x0D of the UTF-8 text,
with A-Z in lower case. All texts of a slice are handled in one pass; a slice
holds at most SLICE_BYTES of text unless a single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all others."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _byte_values() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    return mix(low.astype(_U) + _U(0x1234567))


_BYTE = _byte_values()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_M**i and its inverse for i below n, modulo 2**64."""
    if not len(_POWERS) or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _M, _U), np.full(size, _M_INV, _U)
        up[0] = down[0] = 1
        _POWERS.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into the bytes) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


#: Every ASCII byte but letters and digits, for words without punctuation.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[0x30:0x3A] = PUNCTUATION[0x41:0x5B] = PUNCTUATION[0x61:0x7B] = PUNCTUATION[0x80:] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP, latin: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and for each text the index of its first word (and the end).

    separators: for each byte value, whether it parts words.
    latin: À to Þ are put in lower case too.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, np.zeros(len(offsets), np.int64)
    if latin:
        accents = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)) + 1
        if len(accents):
            data = data.copy()
            data[accents] += 0x20
    solid = ~separators[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


_PLACE = mix(np.arange(1, 65, dtype=_U) * _U(0x51_7C_C1_B7_27_22_0A_95)) | _U(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k successive words; a shorter sequence is one shingle, no words give none. Repeats stay."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, _U(k))
    for i in range(k):
        out += words[i : n - k + 1 + i] * _PLACE[i]
    return mix(out)
