"""Token ids of whole texts with the installed tokenizers library.

Tokenisers of this kind cut a text into pieces before they merge bytes, and no
merge crosses a cut.  A text is therefore the concatenation of its chunks, cut
where every such pre-tokeniser cuts too; each distinct chunk is encoded once by
the library and the ids are gathered with numpy.  The result equals encoding
the whole text (``tests/llm/test_llm.py`` holds it against the library).

Chunks end before white space.  They are cut further where an ASCII letter,
digit or punctuation mark meets one of another of these classes, if a probe
text shows that the tokeniser at hand cuts there as well.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from . import wordbatch as wb

#: Distinct chunks that a worker remembers; beyond it starts anew (about 50 MB).
MEMO = 1_000_000
#: Bytes of text encoded together.
WINDOW = 1 << 20
#: Chunks handed to the library at once; its objects are about a hundred times as large as a chunk.
TOGETHER = 4096

# Classes of bytes: a cut within a word needs two different ones of the first three.
_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[ord("'")] = _APOSTROPHE  # may begin a contraction: never cut behind it
_KIND[ord("|")] = _OTHER  # special tokens hold it
_CUT = np.zeros((5, 5), bool)
_CUT[[_LETTER, _LETTER, _LETTER, _DIGIT, _DIGIT, _DIGIT, _MARK, _MARK], [_DIGIT, _MARK, _APOSTROPHE, _LETTER, _MARK, _APOSTROPHE, _LETTER, _DIGIT]] = True
_PROBE = "word,next don't 'tis (a) x1y22z \"q\"; 3.14 e.g. [k]=v\nNew a\n\nb $$$ I'LL o'1 <b>#7-8_x"


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool) -> ChunkEncoder:
    """One encoder for a worker's life: later tasks find the chunks of earlier ones."""
    return ChunkEncoder(path, drops_space)


class ChunkEncoder:
    """Encodes string columns with one tokeniser, chunk by chunk.

    ``drops_space`` tells that the tokeniser discards white space (chunks are
    then the words); else a chunk keeps the white space before its word.
    Special tokens' strings contain no white space, so they stay in one chunk
    and are read just as in the whole text.
    """

    def __init__(self, path: str, drops_space: bool):
        self.tokenizer = load(path)
        self.drops_space = drops_space
        self._forget()
        self.fine = True
        self.fine = self._probe()

    def _forget(self) -> None:
        self.old, self.new = _Table.empty(), _Table.empty()
        self.ids, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _probe(self) -> bool:
        """Whether finer cuts give the library's ids and leave its special tokens whole."""
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(_CUT[_KIND[b[:-1]], _KIND[b[1:]]].any() for b in (np.frombuffer(t.encode(), np.uint8) for t in added)):
            return False
        ids, _ = next(self.encode(pa.array([_PROBE])))
        return ids.tolist() == self.tokenizer.encode(_PROBE, add_special_tokens=False).ids

    def _chunks(self, data, offsets, first, last):
        lo, hi = int(offsets[first]), int(offsets[last])
        part = data[lo:hi]
        inside = np.zeros(hi - lo, bool)
        if self.fine and hi > lo:
            kind = _KIND[part]
            inside[1:] = _CUT[kind[:-1], kind[1:]]
        if self.drops_space:
            starts, ends, docs = wb.word_spans(data, offsets, first, last)
            if inside.any():
                heads = offsets[first:last] - lo
                inside[heads[heads < hi - lo]] = False
                cuts = np.flatnonzero(inside) + lo
                starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
                docs = np.searchsorted(offsets[first : last + 1], starts, "right") - 1 + first
            return starts, ends, docs
        # Cuts: before a run of white space that begins with a space and follows a byte that surely is no white space.
        if hi > lo:
            previous = np.concatenate([[np.uint8(32)], part[:-1]])
            two_back = np.concatenate([[np.uint8(32)] * min(2, hi - lo), part[:-2]])[: hi - lo]
            ascii_before = (previous > 0x20) & (previous < 0x7F)
            before = ascii_before | ((previous >= 0x80) & (two_back >= 0xC3) & (two_back < 0xE0))
            cut = inside | ((part == 0x20) & before)
            if self.fine:  # a lone line break between a visible and a word character is a chunk of its own
                lone = np.zeros(hi - lo, bool)
                lone[1:-1] = (part[1:-1] == 0x0A) & ascii_before[1:-1] & ((kind[2:] == _LETTER) | (kind[2:] == _DIGIT))
                cut |= lone
                cut[1:] |= lone[:-1]
        else:
            cut = inside
        inner = offsets[first:last][np.diff(offsets[first : last + 1]) > 0] - lo
        cut[inner] = True
        starts = np.flatnonzero(cut) + lo
        ends = np.concatenate([starts[1:], [hi]]) if len(starts) else starts
        docs = np.searchsorted(offsets[first : last + 1], starts, "right") - 1 + first
        return starts, ends, docs

    def _learn(self, data, keys, starts, ends) -> None:
        """Encode chunks that the memo lacks; ``keys`` ascend."""
        raw = data.tobytes()
        got = []
        for i in range(0, len(starts), TOGETHER):
            texts = [raw[a:b].decode("utf-8") for a, b in zip(starts[i : i + TOGETHER].tolist(), ends[i : i + TOGETHER].tolist(), strict=True)]
            got += [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        n = int(lengths.sum())
        while self.filled + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + n] = np.fromiter(chain.from_iterable(got), np.uint32, n)
        fresh = _Table(keys, self.filled + np.cumsum(lengths) - lengths, lengths)
        self.filled += n
        self.new = self.new.merged(fresh)
        if len(self.new.keys) > max(1 << 15, len(self.old.keys) // 4):  # rarely, so the work stays in proportion
            self.old, self.new = self.old.merged(self.new), _Table.empty()

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each key begin, how many they are, and which keys are known."""
        begin, n, known = self.old.find(keys)
        rest = np.flatnonzero(~known)
        begin[rest], n[rest], known[rest] = self.new.find(keys[rest])
        return begin, n, known

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows, in order: the ids of all of them and each row's count."""
        data, offsets = wb.column_bytes(column)
        for first, last in wb.document_windows(offsets, WINDOW):
            starts, ends, docs = self._chunks(data, offsets, first, last)
            keys, at, which = np.unique(wb.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
            if len(self.old.keys) + len(self.new.keys) + len(keys) > MEMO:
                self._forget()
            begin, n, known = self._find(keys)
            new = np.flatnonzero(~known)
            if len(new):
                lo = int(offsets[first])
                self._learn(data[lo : int(offsets[last])], keys[new], starts[at[new]] - lo, ends[at[new]] - lo)
                begin[new], n[new], _ = self._find(keys[new])
            begin, n = begin[which], n[which]
            out_at = np.cumsum(n) - n
            ids = self.ids[np.repeat(begin - out_at, n) + np.arange(int(n.sum()))]
            counts = np.bincount(docs - first, weights=n, minlength=last - first).astype(np.int64)
            yield ids, counts


class _Table:
    """Sorted keys with the place and number of their ids."""

    def __init__(self, keys: np.ndarray, begin: np.ndarray, n: np.ndarray):
        self.keys, self.begin, self.n = keys, begin, n

    @staticmethod
    def empty() -> _Table:
        return _Table(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def merged(self, other: _Table) -> _Table:
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        return _Table(keys[order], np.concatenate([self.begin, other.begin])[order], np.concatenate([self.n, other.n])[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.begin[at], self.n[at], self.keys[at] == keys
