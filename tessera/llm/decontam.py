"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The n-grams of the test items are a table. One pass over the corpus counts how common each is, by the words that stand
around it, so that copies of an item don't make its n-grams common; a second one joins the texts with the items on
the rare n-grams. A seed in a text proposes a place for its item. Places whose words can't reach the threshold in
any order are left out, which loses no match; local alignment of the item with the words around the others scores
exact, edited and partly paraphrased copies alike. Neither the items nor the corpus come to the driver: what is sent to
the tasks is a bit set of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bits import bit_set, is_set
from tessera.llm.common import TEXT_KEYS, bounded_batches, join_counted, materialize, text_keys, text_or_empty
from tessera.llm.words import grams, joined, words_of_batch, words_of_text

NGRAM = 3
THRESHOLD = 0.5
#: An n-gram is rare with so many pairs of words around it, or fewer.
RARE = 1000
LEAST_SEEDS = 20
PUNCTUATION = bytes(32 if 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates."""
    return text.lower().encode().translate(PUNCTUATION).split()


def _best(item: np.ndarray, window: np.ndarray, match: int, mismatch: int, gap: int) -> tuple[int, int, int]:
    """The best local score and the first cell, by row and then column, that has it. Two rows of the matrix are held."""
    ramp = gap * np.arange(len(window) + 1)
    row, best, at = np.zeros(len(window) + 1, np.int64), 0, (0, 0)
    for i, word in enumerate(item):
        open_ = np.zeros_like(row)
        open_[1:] = np.maximum(row[:-1] + np.where(window == word, match, mismatch), row[1:] - gap)
        # the chain of gaps within a row is a running maximum
        row = np.maximum.accumulate(np.maximum(open_, 0) + ramp) - ramp
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (i + 1, j)
    return best, *at


def align(item: np.ndarray, window: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[float, int, int]:
    """Best Smith-Waterman score as a share of a full match, and the first and last word it covers.

    Memory grows with the window alone. Where the alignment starts is found from its end: in the reversed words
    up to there no other cell ends an alignment that good.
    """
    if not len(item) or not len(window):
        return 0.0, 0, 0
    best, i, j = _best(item, window, match, mismatch, gap)
    if not best:
        return 0.0, 0, 0
    _, _, back = _best(item[:i][::-1], window[:j][::-1], match, mismatch, gap)
    return best / (match * len(item)), j - back, j - 1


def places(own: np.ndarray, coded: np.ndarray, starts: list[int], threshold: float) -> Iterator[tuple[int, int]]:
    """Stretches of a text, first and end word, that hold every alignment through one of ``starts`` that may reach ``threshold``.

    Such an alignment has at most twice (1 - threshold) of the item's words more than the item, and its score
    is at most the item's share of words that the stretch holds too, in whatever order.
    """
    size = len(own)
    slack = int(2 * size * (1 - threshold)) + 1
    words, often = np.unique(own, return_counts=True)
    low = end = None
    for start in starts:
        a, b = max(0, start - slack), min(len(coded), start + size + slack)
        if end is not None and b <= end:
            continue
        slot = np.minimum(np.searchsorted(words, coded[a:b]), len(words) - 1)
        there = np.bincount(slot[words[slot] == coded[a:b]], minlength=len(words))
        if np.minimum(there, often).sum() < threshold * size:
            continue
        if end is not None and a <= end:
            end = b
        else:
            if end is not None:
                yield low, end
            low, end = a, b
    if end is not None:
        yield low, end


def items_of(benchmark: DataFrame) -> DataFrame:
    """``(item, item_id, text)``: distinct test items; ``item`` tells unlike texts of one id apart."""
    own = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), text_or_empty().alias("text"))
    return own.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"])


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """``(item, gram, place)`` of the n-grams of each item; items of fewer words have none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, hashes, rows in words_of_batch(batch.column(1)):
                at, made = grams(hashes, rows, n)
                item = batch.column(0).to_numpy()[low + rows[at]]
                place = at - np.searchsorted(rows, rows[at])
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(made.view(np.int64)), pa.array(place.astype(np.int32))], names=["item", "gram", "place"])

    return items.select("item", F.lower("text").alias("text")).mapInArrow(make, "item long, gram long, place int")


def met_grams(docs: DataFrame, bits: np.ndarray, n: int, contexts: bool) -> DataFrame:
    """Where n-grams of the set ``bits`` stand: ``(gram, context)``, the words beside them, or ``(k1, k2, gram, at)``, the text and the word."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    schema = "gram long, context long" if contexts else "k1 long, k2 long, gram long, at int"
    names = [c.split()[0] for c in schema.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, hashes, rows in words_of_batch(batch.column(2)):
                at, made = grams(hashes, rows, n)
                here = np.flatnonzero(is_set(sent.value, made))
                at, made = at[here], made[here]
                if not len(at):
                    continue
                if contexts:  # each once in a batch; zero stands for no word
                    edged, inside = np.concatenate(([np.uint64(0)], hashes, [np.uint64(0)])), np.concatenate(([-1], rows, [-1]))
                    before = np.where(inside[at] == rows[at], edged[at], np.uint64(0))
                    after = np.where(inside[at + n + 1] == rows[at], edged[at + n + 1], np.uint64(0))
                    columns = list(np.unique(np.stack((made.view(np.int64), joined(before, after).view(np.int64))), axis=1))
                else:
                    keys = (batch.column(i).to_numpy()[low + rows[at]] for i in (0, 1))
                    columns = [*keys, made.view(np.int64), (at - np.searchsorted(rows, rows[at])).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.select(*text_keys(), F.lower(text_or_empty()).alias("text")).mapInArrow(make, schema)


def rare_seeds(docs: DataFrame, placed: DataFrame, n: int, rare: int = RARE, least: int = LEAST_SEEDS) -> DataFrame:
    """``(item, gram, place)``: the n-grams of each item that are rare in the corpus, or its ``least`` rarest ones if they are more.

    An n-gram is as common as there are words around it: the pairs of the words before and after it, over the
    whole corpus, and the items that hold it. Copies of an item don't count, as there the same words stand beside its n-grams.
    """
    every = placed.select("gram").distinct()
    around = met_grams(docs, bit_set(every, every.count()), n, True).groupBy("gram").agg(F.approx_count_distinct("context").alias("around"))
    held = placed.groupBy("gram").agg(F.count_distinct("item").alias("items"))
    told = held.join(around, "gram", "left").select("gram", (F.coalesce("around", F.lit(0)) + F.col("items")).alias("common"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("common", "gram", "place"))
    return placed.join(told, "gram").withColumn("rank", rank).where((F.col("common") <= rare) | (F.col("rank") <= least)).select("item", "gram", "place")


def candidates(docs: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """``(k1, k2, item, starts)``: texts that hold a seed of an item, and where the item would start by each."""
    every = seeds.select("gram").distinct()
    # copies of a text are one text
    hits = materialize(met_grams(docs, bit_set(every, every.count()), n, False).distinct(), "hits")
    counted = seeds.join(hits.groupBy("gram").agg(F.count(F.lit(1)).alias("hits")), "gram")
    met = join_counted(hits, materialize(counted, "seeds-met"), "gram", "hits", hits.count())
    return met.groupBy(*TEXT_KEYS, "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))


def only_keys(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``(k1, k2, text)`` of the rows whose key ``k1`` is in the set, or seems to be."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = np.flatnonzero(is_set(sent.value, batch.column(0).to_numpy().view(np.uint64)))
            if len(here):
                yield batch.take(pa.array(here))

    return docs.select(*text_keys(), text_or_empty().alias("text")).mapInArrow(make, "k1 long, k2 long, text string")


def found_in_texts(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``(k1, k2, item_id, score, first_word, last_word)`` of each distinct text and item whose best alignment reaches ``threshold``."""
    bounded_batches(docs.sparkSession)
    items = materialize(items_of(benchmark), "items")
    seeds = materialize(rare_seeds(docs, materialize(item_grams(items, n), "item-grams"), n), "seeds")
    pairs = materialize(candidates(docs, seeds, n), "candidates")
    told = pairs.join(items, "item").groupBy(*TEXT_KEYS).agg(F.collect_list(F.struct("item_id", F.lower("text").alias("text"), "starts")).alias("items"))
    keys = pairs.select("k1").distinct()
    texts = only_keys(docs, bit_set(keys, keys.count())).dropDuplicates(list(TEXT_KEYS))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[float, int, int]] = {}
        for batch in batches:
            for k1, k2, text, own in zip(*batch.columns, strict=True):
                coded, out = words_of_text(text.as_py()), []
                for x in own.as_py():
                    item, best = words_of_text(x["text"]), (0.0, 0, 0)
                    for low, end in places(item, coded, sorted(x["starts"]), threshold):
                        window = coded[low:end]
                        key = (item.tobytes(), window.tobytes())
                        if key not in known:
                            if len(known) > 2_000:
                                known.clear()
                            known[key] = align(item, window)
                        score, a, b = known[key]
                        if score > best[0]:
                            best = (score, low + a, low + b)
                    if best[0] >= threshold:
                        out.append((k1.as_py(), k2.as_py(), x["item_id"], *best))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=FOUND_NAMES)

    return texts.join(told, list(TEXT_KEYS)).select(*TEXT_KEYS, F.lower("text").alias("text"), "items").mapInArrow(verify, FOUND)


FOUND = "k1 long, k2 long, item_id long, score double, first_word long, last_word long"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``(doc_id, item_id, score, first_word, last_word)``: one row per document row and item whose best alignment reaches ``threshold`` of a full match.

    ``score`` is that share, ``first_word`` and ``last_word`` the words it covers. Items of fewer
    than ``n`` words have no n-gram and match nothing; null texts count as empty; items with null
    ids are left out; repeated rows give repeated rows; empty tables give no rows. An edited copy that keeps none of its item's
    seeds is not found.
    """
    found = materialize(found_in_texts(docs, benchmark, threshold, n), "found")
    # the found texts are told once each; of copies Spark may split the rows
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys()).join(found, list(TEXT_KEYS)).drop(*TEXT_KEYS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; other rows of their doc_id stay."""
    found = materialize(found_in_texts(docs, benchmark, threshold).select(*(F.col(k).alias(f"__{k}") for k in TEXT_KEYS)).distinct(), "found")
    own = docs.select("*", *(key.alias(f"__own_{name}") for name, key in zip(TEXT_KEYS, text_keys(), strict=True)))
    same = (F.col("__own_k1") == F.col("__k1")) & (F.col("__own_k2") == F.col("__k2"))
    # the found keys are hashed, so that whole texts are dealt but not sorted
    return own.join(found.hint("shuffle_hash"), same, "left_anti").select(*docs.columns)
