"""Vectorised word splitting and hashing over Arrow string columns.

A text column arrives as one UTF-8 buffer with offsets.  Splitting and hashing
run over that buffer with numpy, in windows of bounded size, so a batch needs
memory for one window and not for all its texts, however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; temporaries are about twenty times that.
WINDOW = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = np.array(x, dtype=np.uint64)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_WEIGHTS = mix64(np.arange(4096)) | np.uint64(1)


def _weights(n: int) -> np.ndarray:
    global _WEIGHTS
    if n > len(_WEIGHTS):
        _WEIGHTS = mix64(np.arange(1 << int(n - 1).bit_length())) | np.uint64(1)
    return _WEIGHTS


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its len+1 offsets; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def document_windows(offsets: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``size`` bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+`` of documents first..last-1."""
    lo, hi = int(offsets[first]), int(offsets[last])
    if lo == hi:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data[lo:hi]]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[first:last] - lo
    inner = inner[inner < hi - lo]
    begin[inner] = word[inner]  # a document's first byte never continues the one before
    end = word.copy()
    end[:-1] &= ~word[1:]
    tails = inner[inner > 0] - 1
    end[tails] = word[tails]
    starts = np.flatnonzero(begin) + lo
    ends = np.flatnonzero(end) + lo + 1
    docs = np.searchsorted(offsets[first : last + 1], starts, "right") - 1 + first
    return starts, ends, docs


#: Bytes up to which a span is hashed eight at a time.
_SHORT = 64
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span lies.

    Short spans are mixed eight bytes at a time; longer ones get a multilinear
    sum.  Two given different strings collide with a probability below 2**-56.
    """
    lengths = ends - starts
    out = lengths.astype(np.uint64)
    if not len(starts):
        return out
    lo = int(starts.min())
    padded = np.concatenate([data[lo : int(ends.max())], np.zeros(8, np.uint8)])
    at_any_byte = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    who = np.flatnonzero((lengths > 0) & (lengths <= _SHORT))
    place, left = starts[who] - lo, lengths[who]
    while len(who):
        word = at_any_byte[place] & _KEEP[np.minimum(left, 8)]
        out[who] = mix64(out[who] ^ word)
        more = left > 8
        who, place, left = who[more], place[more] + 8, left[more] - 8
    long = np.flatnonzero(lengths > _SHORT)
    if len(long):
        out[long] = _hash_long(data, starts[long], lengths[long])
    return out


def _hash_long(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    total, done = np.cumsum(lengths), 0
    while done < len(starts):
        if lengths[done] > WINDOW:  # one span alone, in pieces
            for lo in range(0, int(lengths[done]), WINDOW):
                part = data[starts[done] + lo : starts[done] + min(lo + WINDOW, int(lengths[done]))].astype(np.uint64) + np.uint64(1)
                weights = mix64(np.arange(lo, lo + len(part))) | np.uint64(1)
                out[done] += (part * weights).sum(dtype=np.uint64)
            done += 1
            continue
        base = total[done - 1] if done else 0
        upto = max(int(np.searchsorted(total, base + WINDOW, "right")), done + 1)
        s, n = starts[done:upto], lengths[done:upto]
        weights = _weights(int(n.max()))
        at = np.cumsum(n) - n
        position = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(at, n)
        terms = (data[np.repeat(s, n) + position].astype(np.uint64) + np.uint64(1)) * weights[position]
        out[done:upto] = np.add.reduceat(terms, at)
        done = upto
    return mix64(out + lengths.astype(np.uint64))


def group_bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, with the length at the end."""
    if len(sorted_keys) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
