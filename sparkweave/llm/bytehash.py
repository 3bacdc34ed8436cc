"""Vectorised hashing of byte segments: words, lines and word n-grams of whole Arrow batches.

Everything works on the concatenated UTF-8 bytes of many texts, so the cost is a few numpy passes over the bytes
and no Python work per word. Hashes are 64 bits wide and do not depend on the platform, the batch or the process.
"""

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF95)
_POWERS = np.array([1], dtype=np.uint64)


def release():
    """Gives memory that a worker no longer uses back to the machine; other stages run beside idle workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x):
    """Finaliser of splitmix64; a bijection of 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n):
    """The first n powers of the odd multiplier, modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        top = _POWERS[-1:] * _ODD
        _POWERS = np.concatenate([_POWERS, _POWERS * top])
    return _POWERS[:n]


def texts_of(column):
    """(bytes, offsets) of a string array; null counts as empty. offsets has one more entry than the array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    at = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column, most=1 << 20):
    """Row ranges of an array whose texts have about `most` bytes together; a longer text stands alone."""
    n = len(column)
    if not n:
        return
    _, at = texts_of(column)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def lower_ascii(data):
    """A-Z lowered, other bytes kept."""
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def words_of(data, at):
    """Runs of bytes other than 0x20 and 0x09-0x0D, cut at text ends: (starts, ends, text of each)."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~gap
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    begins = inside.copy()
    begins[1:] &= gap[:-1]
    cut = at[1:-1]
    cut = cut[cut < len(data)]
    begins[cut] = inside[cut]
    closes = inside.copy()
    closes[:-1] &= gap[1:]
    cut = cut[cut > 0]
    closes[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def hash_segments(data, starts, ends):
    """64-bit hash of each data[start:end]; segments are in order, do not overlap and are not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    if total == len(data) and starts[0] == 0:
        value = data.astype(np.uint64)
        within = np.arange(total, dtype=np.int64) - np.repeat(first, length)
    else:
        within = np.arange(total, dtype=np.int64) - np.repeat(first, length)
        value = data[within + np.repeat(starts, length)].astype(np.uint64)
    value += np.uint64(1)
    value *= _powers(int(length.max()))[within]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _MUL)


def windows(hashes, text, n):
    """Hash and text of each run of n neighbouring words of one text, by its first word: (hashes, texts, positions)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    whole = np.flatnonzero(text[:m] == text[n - 1 :])
    out = np.zeros(len(whole), np.uint64)
    for k in range(n):
        out = out * _ODD + hashes[whole + k]
    return mix(out), text[whole], whole


def shingles_of(column, n=5):
    """Distinct word n-grams of each lower-cased (A-Z) text as sorted 64-bit hashes: (hashes, offsets).

    A text of fewer than n words has its whole word sequence as its one member, one without words has none.
    """
    data, at = texts_of(column)
    count = len(at) - 1
    starts, ends, text = words_of(data, at)
    words = hash_segments(lower_ascii(data), starts, ends)
    grams, owner, _ = windows(words, text, n)
    per = np.bincount(text, minlength=count)
    first = np.cumsum(per) - per
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = per[short] > k
            value[has] = value[has] * _ODD + words[first[short][has] + k]
        value = mix(value ^ (per[short].astype(np.uint64) * _MUL))
        grams, owner = np.concatenate([grams, value]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))]).astype(np.int64)
