"""Token counts of a unigram vocabulary without making the tokens.

Aho-Corasick lists the vocabulary's matches in a word; dynamic programming over
end positions keeps the best score and the number of pieces, for no more
positions than the longest piece has characters, so a word of any length needs
no more memory than that.  Ties follow the unigram tokeniser: pieces are tried
by ascending start and only a strictly better score replaces one found before; a character no piece covers costs the
lowest score less 10, neighbouring ones fuse, and with byte fallback they count
one token a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbatch as wb

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker remembers; beyond it starts anew.
MEMO = 1_000_000


class UnigramCounter:
    """Counts of words under (piece, score) pairs.

    Words are cut before each run of marks, which is exact as long as no piece
    holds a mark behind another character; that is checked.  Scores must be
    whole numbers or words short enough for exact double sums to compare alike.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        if any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary):
            raise ValueError("a piece holds a word mark inside: words can't be cut")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(piece) for piece, _ in vocabulary), default=1)
        self.lowest = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.memo: dict[int, int] = {}

    def count(self, word: str) -> int:
        ring = self.longest + 1  # a piece reaches back so far at most
        score, pieces, unknown = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(word)
        stop, match = next(matches, (-1, None))
        for last, char in enumerate(word):
            end, before = (last + 1) % ring, last % ring
            best, count, single = None, 0, False
            while stop == last:  # the longest, which starts first, comes first
                length, value = match
                start = (last + 1 - length) % ring
                single |= length == 1
                if best is None or score[start] + value > best:
                    best, count = score[start] + value, pieces[start] + 1
                stop, match = next(matches, (-1, None))
            alone = not single and (best is None or score[before] + self.lowest > best)
            if alone:
                fused = unknown[before] and not self.byte_fallback
                cost = len(char.encode()) if self.byte_fallback else 1
                best, count = score[before] + self.lowest, pieces[before] + (0 if fused else cost)
            score[end], pieces[end], unknown[end] = best, count, alone
        return pieces[len(word) % ring]

    def counts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For runs of rows, in order: the number of tokens of each; texts begin with a word mark."""
        texts = pc.replace_substring(pc.fill_null(column, ""), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(""), texts, " "))
        data, offsets = wb.column_bytes(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        for first, last in wb.document_windows(offsets):
            lo, hi = int(offsets[first]), int(offsets[last])
            part = data[lo:hi]
            cut = part == 0x20
            cut[1:] &= part[:-1] != 0x20
            begins = offsets[first:last][np.diff(offsets[first : last + 1]) > 0] - lo
            cut[begins] = True
            starts = np.flatnonzero(cut)
            ends = np.concatenate([starts[1:], [hi - lo]]) if len(starts) else starts
            docs = np.searchsorted(offsets[first : last + 1] - lo, starts, "right") - 1
            keys, at, which = np.unique(wb.hash_spans(part, starts, ends), return_index=True, return_inverse=True)
            raw, found = part.tobytes(), np.zeros(len(keys), np.int64)
            if len(self.memo) > MEMO:
                self.memo = {}
            for i, (key, a, b) in enumerate(zip(keys.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)):
                n = self.memo.get(key)
                if n is None:
                    n = self.memo[key] = self.count(raw[a:b].decode().replace(" ", MARK))
                found[i] = n
            yield np.bincount(docs, weights=found[which], minlength=last - first).astype(np.int64)


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


@lru_cache(maxsize=2)
def _counter(path: str, byte_fallback: bool) -> UnigramCounter:
    return UnigramCounter(read_vocabulary(path), byte_fallback)


def token_counts(documents: DataFrame, vocabulary: str, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text.

    Empty and null texts have no tokens; repeated rows are counted each; a null
    id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _counter(vocabulary, byte_fallback)
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *work.counts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], ["doc_id", "n_tokens"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
