"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of each text are numbers of one row, made in Arrow batches. Trees are grown on the
driver from at most ``SAMPLE`` labelled rows, on features cut into ``BINS`` quantile bins, and flattened
into arrays that are walked level by level for a whole batch at once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_batches, text_or_empty

SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, MIN_LEAF, RIDGE = 64, 80, 4, 0.15, 20, 1.0
ACCEPT = 0.3
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "distinct_words", "top_word", "repeated_next", "upper_words",
    "upper_letters", "digits", "marks", "exclamations", "white_space", "lines_per_word", "line_length", "repeated_lines",
    "sentence_ends", "sentence_length", "non_ascii", "letter_entropy", "repeated_trigrams", "packed_share", "vowels", "longest_word", "tag_marks",
)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; of an empty text, zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    words = text.split()
    chars, n = len(text), max(len(words), 1)
    raw = text.encode()
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digits, ascii_ = octets[65:91].sum(), octets[48:58].sum(), octets[:128].sum()
    marks = octets[33:48].sum() + octets[58:65].sum() + octets[91:97].sum() + octets[123:127].sum()
    spaces = octets[32] + octets[9:14].sum()
    lower = octets[97:123] + octets[65:91]
    letters = max(int(lower.sum()), 1)
    share = lower[lower > 0] / letters
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = octets[46] + octets[33] + octets[63]
    trigrams = max(n - 2, 1)
    return [
        math.log1p(chars), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n, sum(map(str.isupper, words)) / n,
        upper / letters, digits / chars, marks / chars, octets[33] / n, spaces / chars, len(lines) / n, chars / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        ends / n, n / (ends + 1), 1 - ascii_ / len(raw), float(-(share * np.log2(share)).sum()), 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / trigrams if n > 2 else 0.0,
        len(zlib.compress(raw, 1)) / len(raw), float(lower[[0, 4, 8, 14, 20]].sum()) / letters, float(lengths.max()), (octets[60] + octets[62] + octets[123] + octets[125]) / n,
    ]


@dataclass
class Trees:
    """All trees in flat arrays; children of a leaf are the leaf itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost ``trees`` on logistic loss. Without rows of both kinds the score is constant."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for column, fill in ((feature, 0), (threshold, 0.0), (value, 0.0)):
            column.append(fill)
        left.append(len(left))
        right.append(len(right))
        return len(left) - 1

    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            rows, at, level = np.arange(len(y)), np.zeros(len(y), np.int64), [node()]
            roots.append(level[0])
            for d in range(depth + 1):
                k = len(level)
                g, h = np.bincount(at, grad[rows], k), np.bincount(at, hess[rows], k)
                splits = _splits(binned[:, rows], at, grad[rows], hess[rows], cuts, k) if d < depth else [(-1, 0)] * k
                children: list[int] = []
                moved = np.full(len(rows), -1)
                for i, own in enumerate(level):
                    f, cut = splits[i]
                    here = np.flatnonzero(at == i)
                    if f < 0:
                        value[own] = float(-rate * g[i] / (h[i] + RIDGE))
                        margin[rows[here]] += value[own]
                        continue
                    feature[own], threshold[own] = f, float(cuts[f][cut])
                    left[own], right[own] = node(), node()
                    moved[here] = len(children) + (binned[f, rows[here]] > cut)
                    children += [left[own], right[own]]
                rows, at, level = rows[moved >= 0], moved[moved >= 0], children
                if not level:
                    break
    return Trees(base, *(np.array(c) for c in (feature or [0], threshold or [0.0], left or [0], right or [0], value or [0.0])), np.array(roots, np.int64), depth)


def _splits(binned: np.ndarray, at: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], k: int) -> list[tuple[int, int]]:
    """The best (feature, bin) of each of ``k`` nodes, from histograms of gradients; -1 for none."""
    best, where = np.full(k, 1e-9), [(-1, 0)] * k
    g, h, n = np.bincount(at, grad, k)[:, None], np.bincount(at, hess, k)[:, None], np.bincount(at, minlength=k)[:, None]
    for f, cut in enumerate(cuts):
        width = len(cut) + 1
        cell = at * width + binned[f]
        gl, hl, nl = (np.bincount(cell, w, k * width).reshape(k, width).cumsum(1)[:, :-1] for w in (grad, hess, None))
        gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
        gain[(nl < MIN_LEAF) | (n - nl < MIN_LEAF)] = 0
        if gain.size:
            top = gain.argmax(1)
            for i in np.flatnonzero(gain[np.arange(k), top] > best):
                best[i], where[i] = gain[i, top[i]], (f, int(top[i]))
    return where


def held_out(doc_id: str = "doc_id"):
    """Rows of the fold that training never sees; rows without a doc_id have no labels and are in neither."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Grow the trees from at most ``sample`` labelled rows, the first by a hash of doc_id.

    The held-out fold and rows with a null in doc_id or quality take no part.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    # at most `sample` pairs of numbers, so the join sends a bounded table to the tasks
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    joined = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    made = joined.select("doc_id", "quality", "text").mapInArrow(make, "doc_id long, quality int, x array<double>")
    # repeated rows of a doc_id are as many numbers each; `sample` holds for them too
    rows = made.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("x")).limit(sample).toPandas()
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    x = np.stack(rows.x.to_numpy()) if len(rows) else np.zeros((0, len(STATISTICS)))
    return grow(x, rows.quality.to_numpy(np.float64) if len(rows) else np.zeros(0))


def score(docs: DataFrame, trees: Trees, name: str = "quality_score") -> DataFrame:
    """Add column ``name`` (0 to 1, higher is better) to all rows of ``docs``; null texts count as empty.

    A column of that name in ``docs`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != name]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], text_or_empty().alias("__text"))
    out = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.columns[-1]]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(trees.score(x))], names=out.names)

    return source.mapInArrow(make, out)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``."""
    return score(docs, train(docs, labels), "__quality").where(F.col("__quality") >= threshold).drop("__quality")
