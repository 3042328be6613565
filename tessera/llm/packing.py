"""Best-fit packing of tokenised documents into sequences (large-item matching).

Documents are tokenised, ended by one separator id and, where longer than the capacity, cut into
capacity-sized pieces. How many pieces there are of each length is a histogram of at most
``capacity`` rows, whatever the corpus holds. The packing is planned on that histogram: pieces above
one third of the capacity go at most two to a sequence, the largest with the largest that fits it;
smaller ones then fill, in falling length, the tightest gap that takes them. Each piece finds its
place by its rank among the pieces of its length, so that no piece passes through the driver.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize, shuffle_partitions, text_or_empty

CAPACITY = 2048
SEPARATOR_ID = 0
CACHE_ENTRIES = 150_000
BATCH_CHARS = 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, first_rank long, n long, per_sequence long, first_sequence long, offset long"


class WordCache:
    """Ids of a text as little-endian uint32 bytes, from remembered ids of its white-space chunks.

    The tokenizer drops white space before its merges, so chunks are independent; within a chunk,
    each match of its split pattern is merged alone. Latin-1 texts are stable under NFC and lower
    by character, so they are lowered first, and share more chunks. Texts with a special token's
    string, or with a separator that only Python takes as white space, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.refused = 0
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: bytes that stand for themselves
        hidden = (b for b in range(256) if b not in set(shown))
        self.letters = {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        ids = self.parts.get(word)
        if ids is None:
            ids = self._packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])
            if len(self.parts) < CACHE_ENTRIES:
                self.parts[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        try:
            chunk.encode("latin-1")
        except UnicodeEncodeError:
            made = self.whole(chunk)
        else:
            made = b"".join([self._word(w) for w in self.words.findall(chunk.lower())])
        if len(self.chunks) < CACHE_ENTRIES:
            self.chunks[chunk] = made
        else:
            self.refused += 1
            if self.refused > 20 * CACHE_ENTRIES:  # the texts have changed: learn their words anew
                self.chunks, self.parts, self.refused = {}, {}, 0
        return made

    def _prepared(self, text: str) -> str:
        try:
            text.encode("latin-1")
            return text.lower()
        except UnicodeEncodeError:
            return text

    def _odd(self, text: str) -> bool:
        return any(c in text for c in "\x1c\x1d\x1e\x1f") or ("<|" in text and any(s in text for s in self.special))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Equal chunks of the batch are found by Arrow and looked up once."""
        odd = {i for i, text in enumerate(texts) if self._odd(text)}
        split = pc.utf8_split_whitespace(pa.array(["" if i in odd else self._prepared(t) for i, t in enumerate(texts)], pa.large_string()))
        words = split.flatten().dictionary_encode()
        known = self.chunks
        ids = [known[c] if c in known else self._chunk(c) for c in words.dictionary.to_pylist()]
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        word = words.indices.to_numpy(zero_copy_only=False)
        each = counts[word]
        ends = np.cumsum(each)
        source = np.repeat((np.cumsum(counts) - counts)[word] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        made = pool[source]
        at = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [self.whole(text) if i in odd else made[at[i] : at[i + 1]].tobytes() for i, text in enumerate(texts)]


_CACHES: dict[str, WordCache] = {}


def encoder(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR_ID) -> DataFrame:
    """One row per piece of a document: where its ids start, how many there are, and their CRC-32.

    A null text counts as empty: one piece that holds the separator alone. Repeated rows are
    documents of their own.
    """
    bounded_batches(docs.sparkSession)
    end = separator.to_bytes(4, "little")

    def block(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, ids in zip(doc_ids, encoder(tokenizer_path).encode_batch(texts), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, chars = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars > BATCH_CHARS:
                    yield block(doc_ids, texts)
                    doc_ids, texts, chars = [], [], 0
            if doc_ids:
                yield block(doc_ids, texts)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first_rank, n, per_sequence, first_sequence, offset)`` that place all pieces.

    The piece of rank ``first_rank + i`` goes to sequence ``first_sequence + i // per_sequence``, at
    ``offset + (i % per_sequence) * length``.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: [(first sequence, sequences)]
    sequences = 0

    def place(length: int, n: int, each: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, each, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        a = large.pop()
        while left[a]:
            fits = bisect_left(large, capacity - a + 1)
            b = a if 2 * a <= capacity and left[a] > 1 else large[fits - 1] if fits else 0
            n = left[a] // 2 if b == a else min(left[a], left[b]) if b else left[a]
            place(a, n, 1, sequences, 0)
            if b:
                place(b, n, 1, sequences, a)
                if b != a and not left[b]:
                    large.remove(b)
            if a + b < capacity:
                gaps[capacity - a - b].append((sequences, n))
            sequences += n

    order = sorted(gaps)
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                n = -(-left[length] // each)
                gap, first, many = capacity, sequences, n
                sequences += n
            else:
                gap = order[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // length
            whole = min(many, left[length] // each)
            rest = min(left[length] - whole * each, each - 1) if whole < many else 0
            filled = [(first, whole, each), (first + whole, int(rest > 0), rest), (first + whole + (rest > 0), many - whole - (rest > 0), 0)]
            for start, n, held in filled:
                if not n:
                    continue
                if held:
                    place(length, n * held, held, start, capacity - gap)
                if remains := gap - held * length:
                    if remains not in gaps:
                        insort(order, remains)
                    gaps[remains].append((start, n))
    return runs


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of :func:`pieces`; ``made`` must be materialised.

    Ranks are counted in buckets of each length, as one length may hold a third of all pieces; the
    buckets' starts come from their counts.
    """
    spark = made.sparkSession
    buckets = max(16, shuffle_partitions(spark))
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = made.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(histogram, capacity), RUNS)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    at = F.col("rank") - F.col("first_rank")
    return (
        # the plan has a few runs for each length: bounded by the capacity, not by the corpus
        ranked.join(F.broadcast(runs), "length")
        .where((at >= 0) & (at < F.col("n")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
            (F.col("offset") + F.pmod(at, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text; further columns are not read) into sequences of ``capacity`` ids.

    Empty tables give an empty result; null and empty texts give a piece of one separator.
    """
    return pack(materialize(pieces(docs, tokenizer_path, capacity, separator), "pieces"), capacity)
