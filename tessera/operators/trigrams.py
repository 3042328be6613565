"""A trigram index: which rows hold which trigrams, so that a search reads the rows that may match and no others.

``(part, gram, key, size)`` has a row for each trigram of a text; ``size`` is how many the text has. Grams are dealt to
``PARTS`` folders by hash and sorted there, so a query's trigrams are read from as many folders as it has trigrams at most.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

PARTS = 64
WORD_SIMILARITY, SIMILARITY = 0.6, 0.3


def part_of(gram: str | Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def trigram_index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(part, gram, key, size)`` of ``texts``; it is to be written by ``part``. A text without letters or digits has no row."""
    grams = texts.select(F.col(key).alias("key"), X.trigrams(text).alias("grams"))
    each = grams.select(F.explode("grams").alias("gram"), "key", F.size("grams").alias("size"))
    return each.withColumn("part", part_of("gram")).repartition("part").sortWithinPartitions("part", "gram")


def grams_of(query: str) -> list[str]:
    """The trigrams of a query's padded words, as the index has them."""
    words = [f"  {w} " for w in X.WORD.findall(query.lower())]
    return sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})


def inner_grams(query: str) -> list[str]:
    """Trigrams that any text with the query in it has: those of words that begin, or end, within the query, and of the letters between."""
    out: set[str] = set()
    for m in re.finditer(X.WORD, query.lower()):
        # what stands at the query's edge may be a part of a longer word
        padded = ("  " if m.start() else "") + m[0] + (" " if m.end() < len(query) else "")
        out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return sorted(out)


def candidates(index: DataFrame, query: str, least_similarity: float = SIMILARITY, whole_texts: bool = True) -> DataFrame | None:
    """``(key)`` of all rows that may hold ``query``, or resemble it as a whole or in a stretch; null where the index can't tell.

    A whole resembles the query by ``s`` only with ``s`` of their joint trigrams, a stretch by 0.6 only with that share of the
    query's; a text that holds the query has all its inner trigrams. A query too short for an inner trigram may stand anywhere.
    Where what resembles the query is but a part of the indexed text, ``whole_texts`` is false, and the text's size isn't counted.
    """
    asked, inner = grams_of(query), inner_grams(query)
    if not inner:
        return None
    every = sorted({*asked, *inner})
    spark = index.sparkSession
    # a few strings of the query, hashed as Spark hashes them
    parts = sorted({r[0] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, every))).alias("g")).select(part_of("g")).collect()})
    both = index.where(F.col("part").isin(parts) & F.col("gram").isin(every))
    counted = both.groupBy("key", "size").agg(F.count_if(F.col("gram").isin(asked)).alias("shared"), F.count_if(F.col("gram").isin(inner)).alias("inner"))
    whole = F.col("shared") >= least_similarity * (F.col("size") + len(asked) - F.col("shared") if whole_texts else F.lit(len(asked))) - 1e-9
    stretch = F.col("shared") >= WORD_SIMILARITY * len(asked) - 1e-9
    return counted.where(whole | stretch | (F.col("inner") == len(inner))).select("key")
