"""Phrases by Apriori passes: frequent (k-1)-grams let k-grams be counted, and level tables score the cuts.

A pass over the texts counts the k-grams of which both overlapping (k-1)-grams are frequent; others can't be.
The frequent (k-1)-grams are sent to the tasks as a bit set of bounded size, whatever their number: a bit that is set
by chance lets a k-gram be counted that the count itself then drops, so the tables are exact at every size.
The words of a block of texts are hashed at once, and the block's k-grams are counted by sorting their hashes; two hashes of
64 bits tell them apart. Blocks' counts are added up by Spark, by the phrases themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bits import bit_set, is_set
from tessera.llm.common import bounded_batches, materialize, text_or_empty
from tessera.llm.words import hashed, joined, spread, stretches

LEAST_COUNT, LONGEST, SCALE, REPORTED = 30, 4, 2_000_000, 2000
#: A phrase goes where a longer one has so many hundredths of its occurrences.
CONTAINED = 80
NO_LANG = "und"
#: Bytes of texts that a task holds before it counts them; a longer text is a block by itself.
HELD_BYTES = 8 << 20
ROWS = 50_000
# what a byte is: 0 of a word, 1 between words, 2 between pieces
KINDS = np.array([2 if b in b".,;:!?\n\v\f\r" else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
COUNTS = "lang string, phrase string, n long"


class Words:
    """The words of texts of one language: where they stand in the lower-cased bytes, in which piece, and two hashes of each."""

    def __init__(self, texts: list[bytes], lang: str):
        # a text's end ends a piece; the last byte is there to be read behind the last word
        self.octets = LOWER[np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)]
        kinds = KINDS[self.octets]
        self.starts, self.lengths = stretches(kinds == 0)
        self.piece = np.cumsum(kinds == 2)[self.starts]
        self.lang = lang

    def hashes(self, turn: int) -> np.ndarray:
        return hashed(self.octets, self.starts, self.lengths, xxhash.xxh64_intdigest(self.lang, turn))

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words that start at the words ``at``, joined by blanks."""
        places = at[:, None] + np.arange(k)
        lengths = self.lengths[places]
        lengths[:, :-1] += 1
        ends = np.cumsum(lengths.ravel())
        made = self.octets[spread(self.starts[places].ravel(), lengths.ravel())]
        made[(ends.reshape(-1, k)[:, :-1] - 1).ravel()] = 32
        offsets = np.concatenate(([0], ends[k - 1 :: k])).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(made)])


def chained(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of ``k`` words."""
    return reduce(joined, (hashes[i : len(hashes) - k + 1 + i] for i in range(k)))


def told_apart(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair of hashes stands first, and how often it stands."""
    _, at, slot, n = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
    if (second[at][slot] != second).any():
        _, at, n = np.unique(np.stack((first, second), axis=1), axis=0, return_index=True, return_counts=True)
    return at, n


def counted_block(words: Words, k: int, frequent: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of ``k`` words of a block, and how often each stands there; some rows at a time."""
    if len(words.starts) < k:
        return
    first, second = words.hashes(0), words.hashes(1)
    if k == 1:
        places = np.arange(len(first))
    else:
        shorter = is_set(frequent, chained(first, k - 1))
        places = np.flatnonzero(shorter[:-1] & shorter[1:] & (words.piece[: len(words.piece) - k + 1] == words.piece[k - 1 :]))
    at, n = told_apart(chained(first, k)[places], chained(second, k)[places])
    for low in range(0, len(at), ROWS):
        yield words.phrases(places[at[low : low + ROWS]], k), n[low : low + ROWS]


def hashed_phrases(grams: DataFrame, k: int) -> DataFrame:
    """``(hash)`` of phrases ``(lang, phrase)`` of ``k`` words, as the texts' are made."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang].append(phrase.encode())
            for lang, phrases in by_lang.items():
                own = Words(phrases, lang).hashes(0).reshape(-1, k)
                made = reduce(joined, (own[:, i] for i in range(k)))
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64))], names=["hash"])

    return grams.select("lang", "phrase").mapInArrow(make, "hash long")


def grams(docs: DataFrame, k: int, frequent: np.ndarray | None = None) -> DataFrame:
    """``(lang, phrase, n)``: the k-grams of ``(lang, text)`` whose (k-1)-grams are ``frequent``; for words also a null phrase with all occurrences."""
    spark = docs.sparkSession
    sent = None if frequent is None else spark.sparkContext.broadcast(frequent)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        size = 0

        def row(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                words = Words(texts, lang)
                for phrases, n in counted_block(words, k, sent and sent.value):
                    yield row(lang, phrases, n)
                if k == 1:
                    yield row(lang, pa.nulls(1, pa.string()), np.array([len(words.starts)]))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[lang].append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                size += len(held[lang][-1]) + 1
                if size >= HELD_BYTES:
                    yield from counted()
                    held.clear()
                    size = 0
        yield from counted()

    bounded_batches(spark)
    return docs.mapInArrow(make, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def cut_scores(candidates: DataFrame, counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(lang, phrase, a, l, r, score)``: of each candidate the cut of least score, then of least length."""
    words = F.split("phrase", " ")
    sides = lambda k: F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice(words, 1, k), " ").alias("part")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("part")))
    parts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")).select("*", F.explode(sides(F.col("k"))).alias("p"))
    met = parts.select("lang", "phrase", "a", "k", "p.side", "p.part").join(counts.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("n"))).alias(s)
    scored = met.groupBy("lang", "phrase", "a", "k").agg(side("l"), side("r"))
    scored = scored.withColumn("score", F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    return scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def inside_longer(counts: DataFrame) -> DataFrame:
    """``(lang, phrase, longest_n)``: of each phrase that stands in longer ones the largest count of those."""
    words, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    places = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    return counts.where(n > 2).select("lang", F.explode(places).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer_n"))


def frequent_grams(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n)`` of all phrases of up to ``longest`` words that occur ``least`` times, and ``(lang, n)`` of all words."""
    own = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), text_or_empty().alias("text"))
    words = materialize(grams(own, 1).where(F.col("phrase").isNull() | (F.col("n") >= least)), "grams-1")
    level = words.where("phrase is not null")
    levels = level
    for k in range(2, longest + 1):
        n = level.count()
        if not n:
            break
        level = materialize(grams(own, k, bit_set(hashed_phrases(level, k - 1), n)).where(F.col("n") >= least), f"grams-{k}")
        levels = levels.unionByName(level)
    return levels, words.where("phrase is null").select("lang", "n")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, reported: int = REPORTED, scale: int = SCALE, contained: int = CONTAINED) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``reported`` best phrases of 2 to ``longest`` words.

    A null lang counts as ``und``; null and empty texts have no words; repeated rows count each; phrases end at
    punctuation and line ends; ties go to the larger count, then to UTF-8 byte order; further columns are not read.
    """
    counts, totals = frequent_grams(docs, least, longest)
    candidates = counts.where(F.contains("phrase", F.lit(" ")))
    longer = inside_longer(candidates)
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer_n").isNull() | (100 * exact("longer_n") < contained * exact("n"))).drop("longer_n")
    scored = cut_scores(kept, counts, scale)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reported)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
