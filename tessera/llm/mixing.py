"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents gets in the mean. The whole
part is given to all; what is left is a probability, and documents are paired: a random amount of words is moved from
one probability to the other, so that their sum in words stays and the means stay, until one of the two is zero or
one. The one that is still open meets the next document. Documents meet in leaves of bounded size; the open ones of the
leaves meet again, ``WAYS`` leaves at a time, until one is left, which is rounded by its probability.

Long documents are rounded before short ones, in classes that are eight times apart: what the last open document of
a class adds or lacks, the mean of the shorter ones takes up, so a source misses its target by a short document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, materialize, shuffle_partitions, text_or_empty

#: Sources weigh these in turn, by code point.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Documents of a leaf, about, and leaves of one tree that meet in a step.
LEAF, WAYS = 2048, 64
SEED = 42


def sizes(docs: DataFrame) -> DataFrame:
    """``(source, named, doc_id, text_key, size)`` of each row; ``named`` is false for a null source."""
    text = text_or_empty()
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    source = F.col("source").cast("string")
    return docs.select(F.coalesce(source, F.lit("")).alias("source"), source.isNotNull().alias("named"), F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), words.alias("size"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number``, from 0, in the given order: rows are counted by sorted part, so none meets all others."""
    parts = materialize(df.orderBy(*order).withColumn("part", F.spark_partition_id()), "sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("own", own).join(offsets, "part").withColumn("number", F.col("own") + F.col("offset")).drop("part", "own", "offset")


def repeated_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with ``weight``: the weights in turn, by code point of the source, null last."""
    turn = (F.col("number") % len(weights)).cast("int") + 1
    return numbered(sources, F.desc("named"), F.asc("source")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).drop("number")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources``, with ``weight`` and ``source_size``, and their ``target``.

    The targets share ``share`` of all words by weight and stop at ``most`` times the source's size; what is above is shared anew
    by weight until none is above. Each round asks for two sums; sources never leave their table.
    """
    sources = materialize(sources.withColumn("most", most * F.col("source_size")), "sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("most") <= level * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if row[2] == stopped or not row[1]:
            break
        level, stopped = (total - row[0]) / row[1], row[2]
    return sources.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("most")


class Pivot:
    """The open document of a tree, and the pairing of the next one with it. The draws follow from what is paired."""

    def __init__(self, seed: int):
        self.seed, self.open = seed, None

    def drawn(self, *what) -> float:
        return (xxhash.xxh64_intdigest(repr(what), self.seed) >> 11) / (1 << 53)

    def meet(self, row: tuple, p: float) -> Iterator[tuple[tuple, int]]:
        """Rows that are settled by this step, as zero or one; a row is ``(doc_id, text_key, size)``."""
        if not row[2] or p <= 0 or p >= 1:
            yield row, int(p >= 1)
            return
        if self.open is None:
            self.open = row, p
            return
        (a, pa_), (b, pb) = self.open, (row, p)
        up = min(a[2] * (1 - pa_), b[2] * pb)  # words that may move from b to a
        down = min(a[2] * pa_, b[2] * (1 - pb))  # and from a to b
        if self.drawn(a, pa_, b, pb) * (up + down) < down:
            fills, empties = up == a[2] * (1 - pa_), up == b[2] * pb
            ends = (1.0 if fills else pa_ + up / a[2], 0.0 if empties else pb - up / b[2])
        else:
            empties, fills = down == a[2] * pa_, down == b[2] * (1 - pb)
            ends = (0.0 if empties else pa_ - down / a[2], 1.0 if fills else pb + down / b[2])
        self.open = None
        for own, end in ((a, ends[0]), (b, ends[1])):
            if end <= 0 or end >= 1:
                yield own, int(end >= 1)
            else:
                self.open = own, end


def reduced(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """Rows ``(source, named, doc_id, text_key, size, leaf, p, whole)``, of each leaf at most one still open (``extra`` null), or none if ``last``.

    A task walks its rows by leaf, longest first, and holds one open document.
    """
    order = ("named", "source", "leaf", F.desc("size"), "p", "doc_id", "text_key")
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "named", "source", "leaf").sortWithinPartitions(*order)
    schema = "source string, named boolean, doc_id long, text_key long, size long, leaf long, p double, whole int, extra int"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(pivot: Pivot, key: tuple | None, whole: int) -> Iterator[tuple]:
            if pivot.open is not None:
                (doc, text, size), p = pivot.open
                yield (key[1], key[0], doc, text, size, key[2], p, whole, int(pivot.drawn(doc, text, size, p) < p) if last else None)

        key, pivot, whole = None, Pivot(seed), 0
        for batch in batches:
            made = []
            for source, named, doc, text, size, leaf, p, all_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (named, source, leaf) != key:
                    made += closed(pivot, key, whole)
                    key, pivot = (named, source, leaf), Pivot(seed)
                whole = all_  # of the source
                made += ((source, named, *own, leaf, float(up), whole, up) for own, up in pivot.meet((doc, text, size), p))
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, m, strict=True)) for m in made], schema=ARROW)
        yield pa.RecordBatch.from_pylist([dict(zip(NAMES, m, strict=True)) for m in closed(pivot, key, whole)], schema=ARROW)

    return dealt.mapInArrow(make, schema)


NAMES = ("source", "named", "doc_id", "text_key", "size", "leaf", "p", "whole", "extra")
ARROW = pa.schema(list(zip(NAMES, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)))


def rounded(rows: DataFrame, means: DataFrame, total: int, largest: int, seed: int) -> DataFrame:
    """``rows`` with ``copies``: as many as ``means`` says for their source, rounded by one tree for each source.

    ``largest`` is the largest number of rows of a source, ``total`` that of all; ``means`` is a written table.
    """
    levels = 0
    while LEAF * WAYS**levels < largest:
        levels += 1
    each = join_counted(rows, means.withColumn("leaves", F.greatest(F.ceil(F.col("n") / LEAF), F.lit(1))), ["source", "named"], "n", total)
    leaf = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.col("leaves")).cast("long")
    open_ = each.select("source", "named", "doc_id", "text_key", "size", leaf.alias("leaf"), (F.col("mean") - F.floor("mean")).alias("p"), F.floor("mean").cast("int").alias("whole"))
    settled = []
    for level in range(levels + 1):
        made = materialize(reduced(open_, seed + level, level == levels), f"rounded-{level}")
        settled.append(made.where("extra is not null"))
        open_ = made.where("extra is null").drop("extra").withColumn("leaf", F.floor(F.col("leaf") / WAYS))
    return reduce(DataFrame.unionByName, settled).select("source", "named", "doc_id", "text_key", "size", (F.col("whole") + F.col("extra")).cast("long").alias("copies"))


def mixture(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, text_key, size, source_size, target, copies, taken)`` of each row of ``docs``.

    ``weights`` has rows ``(source, weight)``, a null source included (missing ones weigh nothing); without it sources weigh 3, 1, 2 in turn.
    ``copies`` are whole copies in the mix, ``taken`` their words; a source's taken words differ from its target by less than its
    longest document, and by less than eight times its shortest one where the means of short documents leave room.
    Null and empty texts have size 0 and no copies; repeated rows are rounded one by one, and equal rows may change places;
    the draws depend on the rows and ``seed`` alone, so reruns agree. An empty table gives no rows.
    """
    rows = materialize(sizes(docs).withColumn("class", F.ceil(F.length(F.bin("size")) / 3).cast("int") * F.sign("size").cast("int")), "sizes")
    cells = materialize(rows.groupBy("source", "named", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "cells")
    sources = cells.groupBy("source", "named").agg(F.sum("n").alias("n"), F.sum("words").alias("source_size"))
    if weights is None:
        sources = repeated_weights(sources)
    else:
        own = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNotNull().alias("named"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(own, ["source", "named"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    told = materialize(targets(sources, share, most), "targets")
    classes = cells.groupBy("class").agg(F.sum("n").alias("n"), F.max("n").alias("largest")).orderBy(F.desc("class")).collect()  # 22 rows at most
    left = told.select("source", "named", F.col("target").alias("words_open"), F.col("source_size").alias("words_left"))
    given = []
    for one in classes:
        own = rows.where(F.col("class") == one["class"]).drop("class")
        if not one["class"]:
            given.append(own.withColumn("copies", F.lit(0).cast("long")))
            continue
        cell = cells.where(F.col("class") == one["class"]).select("source", "named", "n", "words")
        mean = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("words_open") / F.col("words_left")))
        means = materialize(cell.join(left, ["source", "named"]).select("source", "named", "n", mean.alias("mean")), "means")
        given.append(rounded(own, means, one["n"], one["largest"], seed + one["class"]))
        taken = given[-1].groupBy("source", "named").agg(F.sum(F.col("copies") * F.col("size")).alias("took"), F.sum("size").alias("words"))
        left = left.join(taken, ["source", "named"], "left")
        rest = [(F.col(a) - F.coalesce(b, F.lit(0))).alias(a) for a, b in (("words_open", "took"), ("words_left", "words"))]
        left = materialize(left.select("source", "named", *rest), "left")
    shown = told.select("source", "named", "n", "source_size", "target")
    total = sum(one["n"] for one in classes)
    empty = rows.drop("class").withColumn("copies", F.lit(0).cast("long")).limit(0)
    out = join_counted(reduce(DataFrame.unionByName, given, empty), shown, ["source", "named"], "n", total)
    return out.select("doc_id", F.when(F.col("named"), F.col("source")).alias("source"), "text_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies. The columns stay.

    Rows of one doc_id, source and text are copies of each other: they share what all of them get, and their other columns are those of one of them.
    """
    key = ("__id", "__source", "__text")
    own = mixture(docs, weights, share, most, seed).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__text")).agg(F.sum("copies").alias("__copies"))
    named = docs.withColumns({"__id2": F.col("doc_id").cast("long"), "__source2": F.col("source").cast("string"), "__text2": F.xxhash64(text_or_empty())})
    named = named.dropDuplicates(["__id2", "__source2", "__text2"])
    same = [named[f"{k}2"].eqNullSafe(own[k]) for k in key]
    taken = named.join(own.where(F.col("__copies") > 0), same)
    repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select(*[named[c] for c in docs.columns])
