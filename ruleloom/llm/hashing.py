"""Vectorised word and shingle hashes over whole Arrow batches."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64
#: Bits of a shingle hash; the other 12 number the texts of a slice, so that one sort of plain words orders both.
BITS, SLICE = 52, 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (a xor-shift-multiply finaliser)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_P = _U(0xD6E8FEB86659FD93)
_PINV = _U(pow(int(_P), -1, 1 << 64))


_CACHE: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; up to 16 MB of them are kept for the next slice."""
    have = _CACHE.get(int(base))
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[:1] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 21:
            _CACHE[int(base)] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of texts and each word's text number.

    ``data`` holds the texts' bytes; text i is data[starts[i]:ends[i]], in order.
    A word is a run of bytes outside 0x20 and 0x09-0x0D; texts never share a word.
    """
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _LOWER[data]
    solid = ~_SPACE[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = np.unique(starts[starts < n])
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    at = cut[cut > 0] - 1
    last[at] = solid[at]
    b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * _powers(_P, n), out=total[1:])
    words = mix((total[e] - total[b]) * _powers(_PINV, n)[b] + (e - b).astype(np.uint64))
    text = np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(b, np.append(starts, n))))
    return words, text


def shingle_sets(words: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their text numbers.

    A text with fewer words than ``width`` has its whole sequence as its one
    shingle; one without words has none.
    """
    count = np.bincount(text, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    parts, owner = [], []
    if len(words) >= width:
        last = len(words) - width + 1
        same = text[:last] == text[width - 1 :]
        value = np.zeros(last, np.uint64)
        for k in range(width):
            value = mix(value + words[k : k + last] * _U(2 * k + 3))
        parts.append(value[same])
        owner.append(text[:last][same])
    for t in np.flatnonzero((count > 0) & (count < width)):
        value = _U(0)
        for k in range(count[t]):
            value = mix(np.array([value + words[begin[t] + k] * _U(2 * k + 3)], np.uint64))[0]
        parts.append(mix(np.array([value ^ _U(0xA5A5A5A5 + int(count[t]))], np.uint64)))
        owner.append(np.array([t]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = (np.concatenate(owner).astype(np.uint64) << _U(BITS)) | (np.concatenate(parts) >> _U(64 - BITS))
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return key & _U((1 << BITS) - 1), (key >> _U(BITS)).astype(np.int64)


def text_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of an Arrow string column; null texts have no words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(0, len(column), SLICE):
        part = column.slice(at, SLICE)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        with np.errstate(over="ignore"):
            words, text = word_hashes(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
            value, owner = shingle_sets(words, text, len(part), width)
        values.append(value)
        owners.append(owner + at)
    return np.concatenate(values), np.concatenate(owners)
