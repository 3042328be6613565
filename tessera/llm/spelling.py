"""Spelling variants: rolling-hash deletions of words, met by integer key and verified on strings.

Two words differ by one replaced code point if deleting the same place of both gives one string, and by one
inserted or deleted one if deleting a place of the longer gives the shorter. So every word emits the keys of all its
deletions and of itself. A key is a 64-bit hash of the string that a deletion leaves: the polynomial hash of the
word's prefix joined with that of its suffix, made for all words of a batch at once from running sums. Keys are
dealt by their leading digit and sorted; where two rows of a key can make near words, the strings are compared.

A string is left by at most one word per place and letter, so the rows of a key are bounded by the string's length
times the alphabet, whatever the corpus, and each word's count and best form are summed up from its keys:
pairs of words are never listed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shuffle_partitions, text_or_empty

LEAST_LENGTH, LEAST_COUNT, TIMES, CHANGED = 7, 2, 10, 31
#: What a deletion leaves travels with its word up to this length; the words of longer ones are fetched where keys meet.
CARRIED = 64
#: Code points whose deletions are hashed at once.
HELD_POINTS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WHOLE = -1
MET = "word string, near long, form string, form_n long"


def counted_words(docs: DataFrame, least: int = LEAST_LENGTH, changed: int = CHANGED) -> DataFrame:
    """``(word, n)``: lower-cased runs of Latin letters of ``docs``, one in ``changed`` of them with a code point deleted."""
    runs = F.regexp_extract_all(text_or_empty(), F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    low = each.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % changed == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(which word, place, key)`` of each word itself, at ``WHOLE``, and of the deletion of each of its places.

    With sums T of code points times powers of the base, a stretch [a, b) hashes to (T[b] - T[a]) / base^a; the part
    behind a deleted place moves up by one power. All arithmetic is modulo 2^64, where an odd base has an inverse.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = mixed(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(points)
    powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n + 1, BASE, np.uint64))))
    inverse = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n + 1, BASE_INVERSE, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * powers[:n], dtype=np.uint64)))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    at, start, end = np.arange(n), starts[owner], ends[owner]
    left = (sums[at] - sums[start]) * inverse[start] + (sums[end] - sums[at + 1]) * inverse[start + 1]
    whole = (sums[ends] - sums[starts]) * inverse[starts]
    kept = np.concatenate((lengths, lengths[owner] - 1)).astype(np.uint64)  # the length of what is left
    keys = mixed(np.concatenate((whole, left)) + kept * np.uint64(0xD1B54A32D192ED03))
    return np.concatenate((np.arange(len(words)), owner)), np.concatenate((np.full(len(words), WHOLE), at - start)), keys


def emitted(words: DataFrame, long: bool) -> DataFrame:
    """``(key, at, word, n)`` of the keys of strings of up to ``CARRIED`` code points; if ``long``, ``(key, at, id)`` of the others."""

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of a batch whose words have few enough code points; a longer word is a slice of its own."""
        lengths = pc.utf8_length(batch.column(0)).to_numpy()
        low = 0
        while low < len(lengths):
            n = max(1, int(np.searchsorted(np.cumsum(lengths[low : low + HELD_POINTS]), HELD_POINTS)))
            yield batch.slice(low, n)
            low += n

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                own = block.column(0).to_pylist()
                which, at, keys = deletion_keys(own)
                left = np.fromiter(map(len, own), np.int64, len(own))[which] - (at != WHOLE)
                here = np.flatnonzero((left > CARRIED) == long)
                which = pa.array(which[here])
                kept = [block.column(i).take(which) for i in range(2 if not long else 3)][2 if long else 0 :]
                yield pa.RecordBatch.from_arrays([pa.array(keys[here].view(np.int64)), pa.array(at[here].astype(np.int32)), *kept], names=["key", "at", *(["id"] if long else ["word", "n"])])

    length = F.char_length("word")
    if long:
        return words.where(length > CARRIED).select("word", "n", F.md5("word").alias("id")).mapInArrow(make, "key long, at int, id string")
    return words.where(length <= CARRIED + 1).select("word", "n").mapInArrow(make, "key long, at int, word string, n long")


def near_of_key(rows: Iterable[tuple[int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """``(word, near words, best of them, its n)`` from the rows ``(at, word, n)`` of one key."""
    by_left = defaultdict(list)
    for at, word, n in rows:  # different strings of one key are a collision of hashes
        by_left[word if at == WHOLE else word[:at] + word[at + 1 :]].append((at, word, n))

    def told(some: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
        """Each of ``some`` is near all others."""
        first, second = (sorted(some, key=lambda w: (-w[1], w[0])) + [None])[:2]
        for w in some:
            best = second if w == first else first
            yield w[0], len(some) - 1, best[0], best[1]

    for left, own in by_left.items():
        whole = next(((word, n) for at, word, n in own if at == WHOLE), None)
        places = defaultdict(list)
        longer = []
        for at, word, n in own:
            if at != WHOLE:
                places[at].append((word, n))
                if not at or word[at] != word[at - 1]:  # a run of one letter gives one string wherever it is cut
                    longer.append((word, n))
        for some in places.values():
            if len(some) > 1:
                yield from told(some)
        if whole and longer:
            best = min(longer, key=lambda w: (-w[1], w[0]))
            yield whole[0], len(longer), best[0], best[1]
            for word, _ in longer:
                yield word, 1, whole[0], whole[1]


def met(keyed: DataFrame) -> DataFrame:
    """Near words by key, from rows ``(key, at, word, n)``: dealt by the key's leading digit, sorted, and compared as strings."""
    parts = shuffle_partitions(keyed.sparkSession)
    dealt = keyed.repartition(parts, F.shiftrightunsigned("key", 48)).sortWithinPartitions("key", "at")

    def candidates(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of keys where a whole word stands beside deletions, or one place is deleted twice."""
        key, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        twice = np.zeros(len(starts), bool)
        twice[group[1:][(key[1:] == key[:-1]) & (at[1:] == at[:-1])]] = True
        sizes = np.diff(np.append(starts, len(key)))
        return batch.take(pa.array(np.flatnonzero((twice | ((at[starts] == WHOLE) & (sizes > 1)))[group])))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = candidates(pa.Table.from_batches(some).combine_chunks().to_batches()[0])
            found, last, own = [], None, []
            for key, at, word, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if key != last:
                    found += near_of_key(own)
                    last, own = key, []
                own.append((at, word, n))
            found += near_of_key(own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "form", "form_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if held and (cut or held[-1].column(0)[-1].as_py() != keys[0]):
                yield from told([*held, batch.slice(0, cut)] if cut else held)
                held = []
            elif cut:
                yield from told([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from told(held)

    return dealt.mapInArrow(meet, MET)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, form, form_n)``, a row for each key that gives a word near ones; ``words`` is a written table of distinct ``(word, n)``.

    Of words beyond ``CARRIED`` code points only numbers are dealt by key; their strings are fetched for the keys that meet.
    """
    keys = emitted(words, True)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    fetched = keys.join(shared, "key", "left_semi").join(words.where(F.char_length("word") > CARRIED).select(F.md5("word").alias("id"), "word", "n"), "id")
    return met(emitted(words, False)).unionByName(met(fetched.select("key", "at", "word", "n")))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words that have a form: forms followed to the last, twice as far in each round.

    A form's n is ``TIMES`` the word's or more, so a chain is as long as the decimal digits of the largest n at most.
    """
    chains = materialize(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(chains.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        chains = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return chains


def first_of(n: str | Column, word: str) -> Column:
    """Orders words by largest n, then by code points."""
    return F.struct((-F.col(n)).alias("n"), F.col(word).alias("word"))


def spelling_variants(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, changed: int = CHANGED) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of the words of ``docs`` that have ``least`` code points and ``least_count`` occurrences.

    ``form`` is the near word of largest n, if that is at least ``times`` the word's own; ``root`` is the last form
    that is reached, or the word itself. Null and empty texts have no words; a null doc_id hashes as an empty one;
    repeated rows count each; of equal n the form first in code-point order counts; further columns are not read.
    """
    words = materialize(counted_words(docs, least, changed).where(F.col("n") >= least_count), "words")
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<n:long,word:string>").alias("best"))
    found = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "near", first_of("form_n", "form").alias("best"))
    summed = own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.n") >= times * F.col("n")
    forms = materialize(summed.select("word", "n", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")), "forms")
    return forms.join(roots(forms.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
