"""Passages that repeat, by content-defined chunks.

A gear rolling hash over the last ``WINDOW`` bytes of a text decides where it is cut, so that equal passages are
cut alike wherever they stand and an insertion shifts no cut but those near it. From each chunk on, the fewest chunks that hold ``SEED_WORDS`` words are a window. Windows with the digest (128 bits)
of a window at another place, in another text or the same, are repeated; those that overlap form a run. A run is reported
where it may lie in a passage of ``LEAST_WORDS`` words: such a passage may begin up to ``REACH`` bytes before the second
chunk before, and ends before the next window does.

A word is a run of bytes that are no white space; as some languages have no spaces, ``WORD_BYTES`` for each word suffice too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize, text_or_empty

WINDOW = 16
#: A chunk ends where the hash is below 2**WINDOW / MEAN_BYTES and wasn't so within the last LEAST_GAP bytes.
MEAN_BYTES = 20
LEAST_GAP = 8
#: A chunk without such an end is cut at its smallest hash, which lines of few distinct bytes need.
MOST_BYTES = 64
#: Bytes before a cut that decide whether it is one.
REACH = WINDOW + LEAST_GAP
SEED_WORDS = 16
LEAST_WORDS = 51
WORD_BYTES = 16
#: Stands for a null doc_id, which is larger than all others.
LAST = (1 << 63) - 1
SLICE = 1 << 20
GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:2] for b in range(256)), "<u2")


def gear_hashes(octets: np.ndarray) -> np.ndarray:
    """The hash at each byte: gear values of the last 16 bytes, each shifted by its distance.

    Doubling windows give all of them in four steps; the first bytes have shorter windows.
    """
    h = GEAR[octets]
    width = 1
    while width < WINDOW:
        h = h.copy()
        h[width:] += h[:-width] << np.uint16(width)
        width *= 2
    return h


def chunk_ends(raw: bytes) -> np.ndarray:
    """Where chunks end, in bytes; the last is the text's end. No chunk is longer than ``MOST_BYTES``."""
    octets = np.frombuffer(raw, np.uint8)
    limit = np.uint16((1 << 16) // MEAN_BYTES)
    found = []
    for at in range(0, len(octets), SLICE):  # bounds the memory that a very long text takes
        low = max(0, at - WINDOW)
        below = np.flatnonzero(gear_hashes(octets[low : at + SLICE]) < limit) + low
        found.append(below[below >= at])
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    cuts = at[np.diff(at, prepend=-LEAST_GAP) >= LEAST_GAP] + 1
    ends = np.unique(np.append(cuts, len(octets)))
    lengths = np.diff(ends, prepend=0)
    more = []
    for end, length in zip(ends[lengths > MOST_BYTES].tolist(), lengths[lengths > MOST_BYTES].tolist(), strict=True):
        start = end - length
        while end - start > MOST_BYTES:
            low = max(0, start - WINDOW)
            h = gear_hashes(octets[low : start + MOST_BYTES])[start + LEAST_GAP - low :]
            start += MOST_BYTES - int(h[::-1].argmin())  # the last of the smallest
            more.append(start)
    ends = np.unique(np.append(ends, np.array(more, np.int64))) if more else ends
    return ends[ends > 0]


def word_starts(raw: bytes) -> np.ndarray:
    """Where words start, in bytes."""
    octets, found = np.frombuffer(raw, np.uint8), [np.zeros(0, np.int64)]
    for at in range(0, len(octets), SLICE):
        # the byte before tells whether the first one starts a word
        part = octets[max(0, at - 1) : at + SLICE]
        word = ~((part == 32) | ((part >= 9) & (part <= 13)))
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        found.append(np.flatnonzero(starts[1:] if at else starts) + at)
    return np.concatenate(found)


def windows_of(raw: bytes) -> tuple[np.ndarray, ...]:
    """``(start, end, low, high, digests)`` of each window; ``low`` to ``high`` are the words that a passage around it may touch."""
    ends, words = chunk_ends(raw), word_starts(raw)
    starts = np.concatenate(([0], ends[:-1]))[: len(ends)]
    upto, before = np.searchsorted(words, ends), np.searchsorted(words, starts)
    last = np.minimum(np.searchsorted(upto, before + SEED_WORDS), np.searchsorted(ends, starts + SEED_WORDS * WORD_BYTES))
    own = np.flatnonzero(last < len(ends))
    if len(own) and last[own[-1]] + 1 < len(ends):  # one more window, so that the text's last words are in one
        own, chosen = np.append(own, own[-1]), np.append(last[own], len(ends) - 1)
    else:
        chosen = last[own]
    following = ends[np.minimum(np.append(last, len(ends))[own + 1], len(ends) - 1)]
    start, end = starts[own], ends[chosen]
    low = np.searchsorted(words, starts[np.maximum(own - 2, 0)] - REACH, "right") - 1
    high = np.searchsorted(words, following)
    digest = xxhash.xxh3_128_digest
    digests = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)
    return start, end, np.maximum(low, 0), high, digests


#: What is shuffled of each window is kept small: ``span`` is start and length, ``words`` is low, high - low and the text.
LENGTHS = 1 << 10
COUNTS = 1 << 9
VERSIONS = 1 << 24
WINDOWS = "doc_id long, text_key long, span long, words long, a long, b long"
#: Texts that share a doc_id are told apart by 64 bits and 24 more of another hash.
OWN = ["doc_id", "text_key", "version"]


def told_apart() -> list[Column]:
    return [F.xxhash64(text_or_empty()).alias("text_key"), (F.crc32(text_or_empty().cast("binary")) % VERSIONS).alias("version")]


def windows(docs: DataFrame) -> DataFrame:
    """The windows of each text in bytes of its UTF-8, and their digests ``(a, b)``; ``LAST`` stands for a null doc_id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            rows = 0
            for doc_id, key, own, text in zip(*(c.to_numpy() for c in batch.columns[:3]), batch.column(3), strict=True):
                start, end, low, high, digests = windows_of(text.as_py().encode())
                parts.append((np.full(len(start), doc_id), np.full(len(start), key), start * LENGTHS + end - start, (low * COUNTS + high - low) * VERSIONS + own, digests[:, 0], digests[:, 1]))
                rows += len(start)
                if rows > 100_000:
                    yield _batch(parts)
                    parts, rows = [], 0
            if rows:
                yield _batch(parts)

    bounded_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), *told_apart(), text_or_empty().alias("text"))
    return source.mapInArrow(make, WINDOWS)


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)], names=[c.split()[0] for c in WINDOWS.split(", ")])


def shared_windows(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, text_key, version, run, start, end, first_doc)``: windows that stand elsewhere too, in runs that may hold ``least_words``.

    ``first_doc`` is the smallest document that holds the window; ``LAST`` stands for a null doc_id.
    """
    cut = windows(docs)
    # a few numbers for each digest, added up before the shuffle
    holders = cut.groupBy("a", "b").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # read back, so that the join deals both sides anew and may split a digest that very many windows have
    shared = cut.join(materialize(holders, "holders").hint("merge"), ["a", "b"]).drop("a", "b")
    start, told = F.expr(f"span div {LENGTHS}"), F.expr(f"words div {VERSIONS}")
    low = F.expr(f"words div {VERSIONS * COUNTS}")
    parts = {"version": F.col("words") % VERSIONS, "start": start, "end": start + F.col("span") % LENGTHS, "low": low, "high": low + told % COUNTS}
    shared = shared.select("doc_id", "text_key", "first_doc", *(c.cast("int").alias(name) for name, c in parts.items()))
    order = Window.partitionBy(*OWN).orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = shared.withColumn("new", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*OWN, "run")
    words = F.max("high").over(whole) - F.min("low").over(whole)
    octets = F.max("end").over(whole) - F.min("start").over(whole) + 4 * MOST_BYTES
    long = (F.col("words") >= least_words) | (F.col("octets") >= least_words * WORD_BYTES)
    return runs.withColumn("words", words).withColumn("octets", octets).where(long).select(*OWN, "run", "start", "end", "first_doc")


def stretches(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, text_key, version, start, end, first_doc)``: neighbouring shared windows with one ``first_doc``."""
    order = Window.partitionBy(*OWN).orderBy("start")
    turn = F.coalesce((F.col("run") != F.lag("run").over(order)) | (F.col("first_doc") != F.lag("first_doc").over(order)), F.lit(True))
    turned = shared_windows(docs, least_words).withColumn("turn", turn.cast("int"))
    own = turned.withColumn("stretch", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*OWN, "stretch", "first_doc").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("stretch")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, start, end, first_doc)``: stretches of text that stand at another place too.

    ``start`` and ``end`` are bytes of the UTF-8 text. ``first_doc`` is the smallest doc_id that holds the stretch's
    windows, which may be ``doc_id`` itself; where it changes within a run, another stretch begins, and the two may overlap.
    A text that repeats a passage within itself has each place reported. Repeated rows are places of their own, and
    their stretches are reported once; different texts under one doc_id are apart; a null doc_id is a document
    after all others, and returned as null. Null and empty texts have no windows; empty tables give no rows.
    """
    null = lambda c: F.nullif(F.col(c), F.lit(LAST)).alias(c)
    return stretches(docs, least_words).select(null("doc_id"), "start", "end", null("first_doc"))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from all texts but those of the smallest doc_id that holds them.

    All rows and columns stay. A stretch that a document is the smallest to hold is cut nowhere in it, even where it
    overlaps one that goes, so every repeated window stays whole somewhere. A passage that ends within a character
    loses whole characters only.
    """
    found = materialize(stretches(docs, least_words), "repeats")
    span = F.struct("start", "end", (F.col("first_doc") < F.col("doc_id")).alias("later"))
    spans = found.groupBy(*OWN).agg(F.array_sort(F.collect_set(span)).alias("__spans")).where(F.exists("__spans", lambda s: s.later))
    spans = spans.withColumnsRenamed({c: f"__of_{c}" for c in OWN})
    own = docs.select("*", *(c.alias(f"__{name}") for name, c in zip(OWN, [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), *told_apart()], strict=True)))
    same = [F.col(f"__{c}") == F.col(f"__of_{c}") for c in OWN]
    joined = own.join(spans, reduce(Column.__and__, same), "left").select(*docs.columns, "__spans")
    at = docs.columns.index("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.columns[-1], strict=True):
                text, spans = text.as_py(), spans.as_py()
                if text and spans:
                    raw = text.encode()
                    kept = np.ones(len(raw), bool)
                    for later in (True, False):
                        for s in spans:
                            if s["later"] == later:
                                kept[s["start"] : s["end"]] = not later
                    text = np.frombuffer(raw, np.uint8)[kept].tobytes().decode(errors="ignore")
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(make, docs.schema)
