"""Approximate nearest neighbours by cosine: stable random projections, a kd-tree, and a chi-square stopping test.

Unit vectors at distance d land, under a Gaussian projection to ``DIMENSIONS`` numbers, at a squared distance of
d^2 times a chi-square variable of that many degrees of freedom. The directions are made orthogonal, which keeps that mean
and narrows the spread, so the test errs on the side of more candidates. Rows are dealt to the cells of a kd-tree over their
projections, and cells to blocks of bounded size. A query first meets every ``HOME_SHARE``-th row of its own cell,
whose best bound its k-th distance d_k. It then visits the blocks of every cell that the test leaves open. In a
block, candidates come in the order of their projected distance, leaf by leaf of a local kd-tree, and are verified
against the vectors themselves until one is so far that a k-th neighbour would have come nearer with probability
``CONFIDENCE``: chi2(projected^2 / d_k^2) >= CONFIDENCE. Each verified candidate may lower d_k.

The top of the tree is fitted on at most ``SAMPLE`` rows; every row is indexed. A block's rows are held
in memory, queries stream past them, so memory doesn't grow with the number of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize

DIMENSIONS = 24
CONFIDENCE = 0.85
SAMPLE = 40_000
MAX_CELLS = 1024
BLOCK_ROWS = 8192
LEAF_ROWS = 64
#: Rows of a cell for each that a query meets first.
HOME_SHARE = 8
VERIFIED_AT_ONCE = 64
SEED = 11


def chi_square_cdf(x: float, freedom: int) -> float:
    """P(chi-square <= x) for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, freedom) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, freedom) < p else (low, mid)
    return high


def split(points: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: rows split at the median of their widest dimension until at most ``most``."""
    todo, leaves = [rows], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            leaves.append(own)
            continue
        widest = int(np.ptp(points[own], axis=0).argmax())
        own = own[np.argpartition(points[own, widest], len(own) // 2)]
        todo += [own[: len(own) // 2], own[len(own) // 2 :]]
    return leaves


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    out = np.maximum(np.maximum(low - point, point - high), 0)
    return (out * out).sum(axis=1)


@dataclass
class Top:
    """The top of the tree: inner nodes in flat arrays; a negative child is a cell."""

    dimension: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> Top:
        nodes: list[list[float]] = []

        def grow(own: np.ndarray, share: int) -> int:
            nonlocal n
            if share < 2 or len(own) < 2:
                n += 1
                return -n
            widest = int(np.ptp(points[own], axis=0).argmax())
            cut = float(np.median(points[own, widest]))
            at = len(nodes)
            nodes.append([widest, cut, 0, 0])
            below = points[own, widest] <= cut
            nodes[at][2] = grow(own[below], share // 2)
            nodes[at][3] = grow(own[~below], share - share // 2)
            return at

        n = 0
        grow(np.arange(len(points)), cells)
        table = np.array(nodes or [[0, np.inf, -1, -1]], float)
        return cls(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64))

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while len(open_ := np.flatnonzero(node >= 0)):
            at = node[open_]
            below = points[open_, self.dimension[at]] <= self.cut[at]
            node[open_] = np.where(below, self.left[at], self.right[at])
        return -node - 1


def plane_of(width: int, dimensions: int, seed: int) -> np.ndarray:
    """Directions to project on: Gaussian, and orthogonal where the vectors have more numbers than that."""
    made = np.random.default_rng(seed).standard_normal((width, dimensions))
    return np.linalg.qr(made)[0] * math.sqrt(width) if width > dimensions else made


class Block:
    """The rows of one block with a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        order = np.concatenate(leaves := split(points, np.arange(len(ids)), LEAF_ROWS))
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.ends = np.cumsum([len(x) for x in leaves])
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def nearest_first(self, point: np.ndarray, far: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and their squared projected distances, up to ``far`` at least, nearest first over all parts.

        A row is given once no unopened leaf can hold a nearer one. Leaves are opened in doubling numbers.
        """
        boxes = box_distance(self.low, self.high, point)
        order = np.argsort(boxes, kind="stable")
        rows, away, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(order) and boxes[order[at]] <= far:
            opened = order[at : at + step]
            more = np.concatenate([np.arange(self.ends[x - 1] if x else 0, self.ends[x]) for x in opened.tolist()])
            gap = self.points[more] - point
            rows, away = np.concatenate((rows, more)), np.concatenate((away, (gap * gap).sum(axis=1)))
            at, step = at + step, step * 2
            reached = boxes[order[at]] if at < len(order) else np.inf
            sure = np.flatnonzero(away <= min(reached, far))
            sure = sure[np.lexsort((self.ids[rows[sure]], away[sure]))]
            yield rows[sure], away[sure]
            left = np.ones(len(rows), bool)
            left[sure] = False
            rows, away = rows[left], away[left]

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, bound: float, reach: float) -> tuple[np.ndarray, np.ndarray, int]:
        """``(ids, scores, verified)`` of up to ``k`` nearest rows; ``bound`` is a known upper bound of d_k^2."""
        norm = math.sqrt((vector * vector).sum())
        ids, scores, verified = np.zeros(0, np.int64), np.zeros(0), 0
        for rows, away in self.nearest_first(point, reach * bound):
            for at in range(0, len(rows), VERIFIED_AT_ONCE):
                some = rows[at : at + VERIFIED_AT_ONCE]
                some = some[(away[at : at + VERIFIED_AT_ONCE] <= reach * bound) & (self.ids[some] != own)]
                if not len(some):
                    continue
                # row sums, not a matrix product: equal vectors get equal scores wherever they stand
                made = (self.vectors[some].astype(np.float64) * vector).sum(axis=1) / (self.norms[some] * norm)
                verified += len(some)
                ids, scores = np.concatenate((ids, self.ids[some])), np.concatenate((scores, made))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    bound = min(bound, max(2 - 2 * float(scores[-1]), 0.0) + 1e-12)
            if len(away) and away[-1] > reach * bound:
                break
        return ids, scores, verified


def usable(vector: str) -> Column:
    """Vectors that are not null, not zero, and hold finite numbers only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` rows of ``vectors`` nearest to each row of ``queries``.

    Both have ``vec_id`` and ``embedding``; further columns are not read. ``score`` is the cosine in
    double precision; ties go to the smaller vec_id; a query's own vec_id is no candidate. Rows with a
    null vec_id, vectors that are null, empty, zero or hold a null or non-finite component, and vectors
    of another length than most take no part. Repeated rows are candidates of their own; repeated
    queries count once. Empty tables give no rows; a sole vector has no neighbours and gives no rows.
    """
    return ranked(candidates(vectors, queries, k, confidence, seed), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score double, verified long"


def candidates(vectors: DataFrame, queries: DataFrame, k: int = 5, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """``(query_id, vec_id, score, verified)``: the nearest rows of each block that a query visits, and
    one row without vec_id that says how many rows of the block were verified."""
    spark = vectors.sparkSession
    # vectors of 4-byte numbers stay so in the shuffles; scores are made of 8-byte ones
    numbers = "float" if all(d.schema["embedding"].dataType == T.ArrayType(T.FloatType()) for d in (vectors, queries)) else "double"
    clean = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{numbers}>")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows = clean(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sizes is None:
        return spark.createDataFrame([], FOUND)
    width = sizes["width"]
    rows = rows.where(F.size("embedding") == width)
    wanted = clean(queries).where(F.size("embedding") == width).dropDuplicates(["vec_id"])
    plane = plane_of(width, DIMENSIONS, seed)

    def project(matrix: np.ndarray) -> np.ndarray:
        matrix = matrix.astype(np.float64)
        return (matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]) @ plane

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    cells = int(min(MAX_CELLS, max(1, -(-sizes["count"] // BLOCK_ROWS))))
    top = Top.fit(project(np.stack(sample.embedding.to_numpy())), cells)
    dims = range(DIMENSIONS)
    bounds_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(f"{f}{d}", T.DoubleType()) for d in dims for f in ("min", "max"))])
    placed_schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top.cell(project(_matrix(batch.column(1)))), pa.int32())], names=placed_schema.names)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The box of each cell's projections in a batch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            points, cell = project(_matrix(batch.column(1))), batch.column(2).to_numpy()
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            own = points[order]
            low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
            columns = [pa.array(cell[order][first], pa.int32()), pa.array(np.diff(np.append(first, len(cell))), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x[:, d]) for d in dims for x in (low, high)], names=bounds_schema.names)

    placed = materialize(rows.mapInArrow(place, placed_schema), "placed")
    # one row for each cell, of which there are MAX_CELLS at most
    extent = [f(f"{f.__name__}{d}").alias(f"{f.__name__}{d}") for d in dims for f in (F.min, F.max)]
    boxes = placed.mapInArrow(bound, bounds_schema).groupBy("cell").agg(F.sum("n").alias("n"), *extent).toPandas().sort_values("cell")
    low = boxes[[f"min{d}" for d in dims]].to_numpy()
    high = boxes[[f"max{d}" for d in dims]].to_numpy()
    at = {int(c): i for i, c in enumerate(boxes.cell)}
    reach = chi_square_quantile(confidence, DIMENSIONS)
    cell_at = F.create_map(*(F.lit(x) for c, i in at.items() for x in (c, i)))
    met_schema = f"block int, asks int, vec_id long, embedding array<{numbers}>, bound double"

    class Deal:
        """Which blocks the rows of each cell are dealt to: a cell of n rows has n / BLOCK_ROWS."""

        def __init__(self, share: int):
            self.parts = np.maximum(np.ceil(boxes.n.to_numpy() / share / BLOCK_ROWS), 1).astype(np.int64)
            self.firsts = np.cumsum(self.parts) - self.parts

        def members(self) -> DataFrame:
            firsts, parts = (F.array(*map(F.lit, x.tolist())) for x in (self.firsts, self.parts))
            place = cell_at[F.col("cell")]
            block = F.get(firsts, place) + F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.get(parts, place))
            return placed.select(block.cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "embedding", F.lit(0.0).alias("bound"))

        def asks(self, asking: DataFrame, home: bool) -> DataFrame:
            """Queries with the blocks they visit: those of their own cell, or of all that the test leaves open."""
            parts, firsts = self.parts, self.firsts

            def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    points, own, to = project(_matrix(batch.column(1))), [], []
                    for i, (point, far) in enumerate(zip(points, batch.column(2).to_numpy(zero_copy_only=False), strict=True)):
                        away = box_distance(low, high, point)
                        # a query's bound is from a few rows of its own cell: the first of its blocks is enough for it
                        cells_ = [int(away.argmin())] if home else np.flatnonzero(away <= reach * far).tolist()
                        for c in cells_:
                            blocks = range(firsts[c], firsts[c] + (1 if home else parts[c]))
                            own += [i] * len(blocks)
                            to += blocks
                    taken = batch.take(pa.array(own, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.ones(len(to)), pa.int32()), *taken.columns], names=["block", "asks", "vec_id", "embedding", "bound"])

            return asking.select("vec_id", "embedding", "bound").mapInArrow(make, met_schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, members first; of one block at a time the members are held."""
        now, held, built = -1, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            found: tuple[list, ...] = ([], [], [], [])
            blocks, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, far = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            vectors = _matrix(batch.column(3))
            points = project(vectors)
            edges = np.flatnonzero(np.diff(blocks) | np.diff(asks)) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if blocks[a] != now:
                    now, held, built = blocks[a], [], None
                if not asks[a]:
                    held.append((ids[a:b], vectors[a:b], points[a:b]))
                    continue
                if held:
                    built, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                for i in range(a, b) if built else ():
                    near, scores, verified = built.search(ids[i], vectors[i].astype(np.float64), points[i], k, far[i], reach)
                    told = ([ids[i]] * (len(near) + 1), [*near.tolist(), None], [*scores.tolist(), None], [None] * len(near) + [verified])
                    for column, values in zip(found, told, strict=True):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "vec_id", "score", "verified"])

    def visited(members: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
        met = members.unionByName(asked).repartition(max(8, min(blocks, 4096)), "block").sortWithinPartitions("block", "asks")
        return met.mapInArrow(search, FOUND)

    # any pair of unit vectors is at most 2 apart, so the first visit is bounded by 4; a few rows are moved for it
    home, all_ = Deal(HOME_SHARE), Deal(1)
    few = home.members().where(F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(HOME_SHARE)) == 0)
    met = visited(few, home.asks(wanted.withColumn("bound", F.lit(4.0)), True), int(home.parts.sum())).where("vec_id is not null")
    kth = ranked(met, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bounded = wanted.join(kth, wanted.vec_id == kth.query_id, "left").withColumn("bound", F.when(F.col("n") >= k, F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) + 1e-12).otherwise(4.0))
    bounded = materialize(bounded.select("vec_id", "embedding", "bound"), "bounded")
    return visited(all_.members(), all_.asks(bounded, False), int(all_.parts.sum()))
