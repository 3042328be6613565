"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and a count-only Viterbi.

The tokenizer is the unigram model over a given vocabulary with scores: spaces become the mark U+2581, a
text starts with one, and each mark starts a word of its own. Within a word the segmentation of the
largest total score wins. Going by end and, of one end, by start, a later candidate replaces an earlier
one only where its score is larger, as in the tokenizer itself: of equal scores the earliest start, that
is the longest last piece, stays. A character without a piece costs ten below the lowest score;
neighbouring such characters are one unknown piece, which counts its bytes where the vocabulary has all
of them as byte pieces, and one otherwise.

Only the best score and the number of pieces are carried. Equal words of a task are counted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, text_or_empty

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 600_000
LONGEST_CACHED = 64


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class WordCounts(dict):
    """Pieces of words seen lately. Of two generations the older is dropped when the younger is full, so frequent words stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.make(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


class UnigramCounter:
    """Counts the pieces of texts; ``pieces`` in the order of their ids, ``unknown`` the id of the unknown piece."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.pieces = dict(pieces)
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.unknown = pieces[unknown][0]
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in self.pieces}
        self.known = WordCounts(lambda word: self.word(MARK + word))

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of a word."""
        n = len(word)
        best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        runs: dict[int, int] = {}  # where the run of unknown characters starts that is open at an end; count is that before it
        unknown, size = self.unknown, len(self.unknown)

        def closed(end: int) -> int:
            if end not in runs:
                return count[end]
            piece = word[runs[end] : end]
            if piece in self.pieces:
                return count[end] + 1
            octets = piece.encode()
            return count[end] + (len(octets) if self.bytes.issuperset(octets) else 1)

        def unknown_character(end: int) -> None:
            made = best[end - 1] + self.unknown_score
            if made > best[end]:
                best[end], count[end], runs[end] = made, count[end - 1], runs.get(end - 1, end - 1)

        at, single = 0, True  # the end whose pieces come now, and whether its last character is a piece
        for last, (length, score) in self.automaton.iter(word):  # by end; of one end the longest first
            end = last + 1
            if end != at:
                if not single:
                    unknown_character(at)
                for between in range(at + 1, end):
                    unknown_character(between)
                at, single = end, False
            start = end - length
            if length == 1:
                single = True
            made = best[start] + score
            if made > best[end]:
                best[end] = made
                if length == size and word[start:end] == unknown:
                    count[end], runs[end] = count[start], runs.get(start, start)
                else:
                    count[end] = (closed(start) if runs else count[start]) + 1
                    runs.pop(end, None)
        if not single:
            unknown_character(at)
        for between in range(at + 1, n + 1):
            unknown_character(between)
        return closed(n)

    def count(self, text: str) -> int:
        """Pieces of a whole text; an empty one has none."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]
        return sum(map(self.known.__getitem__, words))


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(read_pieces(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens)`` of each row of ``docs`` by the vocabulary at ``path``.

    Null and empty texts have 0 tokens; repeated rows and null doc_ids keep their rows; further columns
    are not read; an empty table gives no rows. A word without spaces is walked once whatever its length.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            made = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "n_tokens"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(make, "doc_id long, n_tokens long")
