"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` bits meet where each emits all variants within half the radius: 2,081
variants of 64 bits for a radius of 4. Variants are dealt by their class, a number of ``CLASS_BITS`` bits that
is linear in the variant's bits: bit i of a class is the parity of every 21st bit. A ball has variants of 232
classes, so a fingerprint travels 232 times, not 2,081, and its variants of a class are made where the class is
met. Any flip of a bit changes the class, so a large group of near copies is spread over as many classes as
it has fingerprints or more. Fingerprints that share a variant are verified and linked to the variant's
smallest; nothing is capped, and no group is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, join_counted, materialize, shuffle_partitions, text_or_empty
from tessera.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Stands for a null doc_id, which is larger than all others.
LAST = (1 << 63) - 1
CLASS_BITS = 21
#: Variants that a task holds at once; a class with more of them is met in slices.
HELD_VARIANTS = 2_000_000


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer."""
    split = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(split) - words + 1)
    upto = ends[words - 1 :] if len(split) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65536].tolist(), upto[at : at + 65536].tolist(), strict=False)]
        ones += np.unpackbits(np.array(bits, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, fp)`` of each row; ``fp`` holds the 64 bits as a signed long. Null texts count as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps)], names=["doc_id", "text_key", "fp"])

    bounded_batches(docs.sparkSession)
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(make, "doc_id long, text_key long, fp long")


def class_of(bits: np.ndarray) -> np.ndarray:
    """The class of 64-bit numbers: the parity of the bits i, i + 21, i + 42 and so on is bit i of it."""
    out = np.zeros_like(bits)
    for shift in range(0, 64, CLASS_BITS):
        out ^= bits >> np.uint64(shift)
    return out & np.uint64((1 << CLASS_BITS) - 1)


def ball(radius: int) -> dict[int, np.ndarray]:
    """Masks of all ways to flip up to ``radius`` of 64 bits, by the class of the mask."""
    masks = np.array([sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(64), r)], np.uint64)
    own = class_of(masks)
    order = np.argsort(own, kind="stable")
    edges = np.flatnonzero(np.diff(own[order])) + 1
    return {int(own[part[0]]): masks[part] for part in np.split(order, edges)}


def shared_variants(fps: np.ndarray, classes: np.ndarray, masks: dict[int, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links ``(a, b)`` of fingerprints that share a variant of the given class, which each is here for.

    A variant has one class, so all fingerprints that emit it are here. Many variants are met in slices, which bounds the memory.
    """
    ways = class_of(fps) ^ classes
    order = np.argsort(ways, kind="stable")
    fps, ways = fps[order], ways[order]
    edges = [0, *(np.flatnonzero(np.diff(ways)) + 1), len(ways)]
    emitted = sum((b - a) * len(masks[int(ways[a])]) for a, b in zip(edges, edges[1:], strict=False))
    slices = 1 << max(0, (int(emitted) // HELD_VARIANTS).bit_length())
    for part in range(slices):
        variants, owners = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            own = masks[int(ways[a])]
            step = max(1, HELD_VARIANTS // len(own))
            for low in range(a, b, step):
                some = fps[low : min(low + step, b)]
                made = (some[:, None] ^ own[None, :]).ravel()
                whose = np.repeat(some, len(own))
                if slices > 1:  # spread by all bits of the variant
                    here = (made * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(slices - 1) == part
                    made, whose = made[here], whose[here]
                variants.append(made)
                owners.append(whose)
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variant)
        variant, owner = variant[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
        sizes = np.diff(np.append(starts, len(variant)))
        met = np.repeat(sizes > 1, sizes)
        least = np.repeat(np.minimum.reduceat(owner, starts), sizes)[met] if len(variant) else owner
        other = owner[met]
        # all flips lie within the radius of each other: verified before the link is made
        near = (least != other) & (np.bitwise_count(least ^ other) <= radius)
        least, other = least[near], other[near]
        order = np.lexsort((other, least))
        least, other = least[order], other[order]
        fresh = np.concatenate(([True], (least[1:] != least[:-1]) | (other[1:] != other[:-1]))) if len(least) else near[:0]
        yield least[fresh], other[fresh]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)``, as signed longs, that connect all fingerprints within ``radius``, which must be even.

    ``fps`` holds distinct fingerprints. Each member of a variant is linked to the variant's smallest member,
    so a variant has fewer links than members, and any two members are connected.
    """
    masks = ball(radius // 2)
    flips = F.explode(F.array(*map(F.lit, sorted(masks))))
    parity = F.lit(0).cast("long")
    for shift in range(0, 64, CLASS_BITS):
        parity = parity.bitwiseXOR(F.shiftrightunsigned("fp", shift))
    own = parity.bitwiseAND(F.lit((1 << CLASS_BITS) - 1))
    parts = 4 * shuffle_partitions(fps.sparkSession)
    # each row becomes 232: the few rows of a file are dealt out before that
    sent = fps.repartition(parts, "fp").select("fp", own.alias("own"), flips.alias("flip")).select(F.col("own").bitwiseXOR(F.col("flip")).cast("int").alias("class"), "fp")
    dealt = sent.repartition(parts, "class").sortWithinPartitions("class")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by class; whole classes are met together, up to the variants that may be held."""

        def linked(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            classes, own = (np.concatenate(x) for x in zip(*held, strict=True))
            for a, b in shared_variants(own.view(np.uint64), classes.astype(np.uint64), masks, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            classes, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # the last class of a batch may go on in the next one
            at = int(np.searchsorted(classes, classes[-1]))
            if n + at > HELD_VARIANTS // 9 and (at or held and held[-1][0][-1] != classes[0]):
                yield from linked([*held, (classes[:at], own[:at])])
                held, n = [], 0
                classes, own = classes[at:], own[at:]
            held.append((classes, own))
            n += len(own)
        if held:
            yield from linked(held)

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def components(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, fp, least)`` of each row: the smallest row ``(doc_id, text_key)`` whose fingerprint is reachable.

    Documents of one fingerprint are one node, so copies are never paired. A null doc_id is larger than all others.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    own = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("text_key").alias("key"))
    nodes = materialize(prints.groupBy("fp").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    grouped = materialize(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "grouped")
    names = materialize(grouped.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("members")), "names")
    sizes = grouped.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    by_print = materialize(join_counted(grouped.select("root", "fp", "n"), names, "root", "members", sizes["nodes"]).select("fp", "n", "least"), "by-print")
    return join_counted(prints, by_print, "fp", "n", sizes["rows"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` of each row: the smallest doc_id whose fingerprint is reachable.

    Null and empty texts have fingerprint 0 and link like any other; a null doc_id keeps its row and never
    names a component that holds another; repeated rows stay.
    """
    return components(docs, radius, words).select("doc_id", "fp", F.nullif(F.col("least.doc"), F.lit(LAST)).alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of its smallest doc_id and, of rows that share it, one text.

    Texts of other components stay where they share a doc_id or have none; rows that repeat one text under one doc_id are one.
    """
    found = components(docs, radius, words)
    least = F.struct(F.coalesce("doc_id", F.lit(LAST)), "text_key") == F.struct("least.doc", "least.key")
    kept = materialize(found.where(least).select(F.coalesce("doc_id", F.lit(LAST)).alias("__doc"), F.col("text_key").alias("__kept")), "kept")
    own = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__key", F.xxhash64(text_or_empty()))
    # the kept rows are hashed, so that whole texts are dealt but not sorted
    named = own.join(kept.hint("shuffle_hash"), (F.col("__id") == F.col("__doc")) & (F.col("__key") == F.col("__kept")), "left_semi")
    if not kept.groupBy("__doc", "__kept").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["__id", "__key"])
    return named.drop("__id", "__key")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
