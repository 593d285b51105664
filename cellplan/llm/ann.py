"""Approximate nearest neighbours by few stable projections (Sun et al. 2014): a kd-tree over Gaussian projections.

Distances between projections, over distances between vectors, are chi-square distributed with as many degrees of
freedom as there are projections. So projected neighbours are met in order of distance and verified on the vectors until
the next one lies so far off that, by that distribution, it is nearer than the k-th found with a small probability only.

The tree's upper part, down to its cells, is split on a bounded sample and known to all; each vector belongs to one cell,
whose rows are the tree's lower part, built where they are searched. A query is searched in its own cell first; then only
in the cells that its k-th neighbour's distance lets it reach.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Projections, the chance that a true neighbour passes the stopping test, vectors in a leaf and in a cell.
PROJECTIONS, CHANCE, LEAF, CELL = 12, 0.93, 256, 8192
#: Vectors on whose projections cells are split (about; the fewest of them in a cell): all vectors are indexed.
SAMPLE, LEAST = 20_000, 8
SEED = 7


def chi_square(p: float, degrees: int) -> float:
    """The quantile p of the chi-square distribution."""

    def below(x: float) -> float:  # the regularized lower gamma function, by its series
        a, y = degrees / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= y / n
            total += term
        return total * math.exp(-y + a * math.log(y) - math.lgamma(a))

    low, high = 1e-9, 10.0 * degrees + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def basis(length: int, projections: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, projections))


def project(vectors: np.ndarray, projections: int) -> np.ndarray:
    """Projections of rows scaled to length 1."""
    return (vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]) @ basis(vectors.shape[1], projections)


class Cells:
    """The tree's upper part for vectors of one length: cells numbered from ``first``, split at sampled medians."""

    def __init__(self, low: np.ndarray, first: int, wanted: int):
        self.first, self.splits = first, []  # by node: axis, value, children; a child below 0 is cell -1 - child
        self.floor, self.roof = [], []
        self._split(low, wanted, np.full(low.shape[1], -math.inf), np.full(low.shape[1], math.inf))
        self.floor, self.roof = np.array(self.floor), np.array(self.roof)

    def _split(self, low: np.ndarray, wanted: int, floor: np.ndarray, roof: np.ndarray) -> int:
        axis = int(np.ptp(low, axis=0).argmax()) if len(low) else 0
        values = np.sort(low[:, axis])
        at = values[len(values) // 2] if len(values) else 0.0
        if wanted < 2 or len(low) < 2 * LEAST or at == values[0]:
            self.floor.append(floor)
            self.roof.append(roof)
            return -len(self.floor)
        node = len(self.splits)
        self.splits.append(None)
        below, above = roof.copy(), floor.copy()
        below[axis] = above[axis] = at
        left = low[:, axis] < at
        self.splits[node] = axis, at, self._split(low[left], wanted // 2, floor, below), self._split(low[~left], wanted - wanted // 2, above, roof)
        return node

    def of(self, low: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(low), np.int64)
        stack = [(0 if self.splits else -1, np.arange(len(low)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = self.first - 1 - node
            elif len(rows):
                axis, at, left, right = self.splits[node]
                is_left = low[rows, axis] < at
                stack += [(left, rows[is_left]), (right, rows[~is_left])]
        return out

    def within(self, low: np.ndarray, reach: float) -> np.ndarray:
        """The cells whose squared distance from the point is ``reach`` at most."""
        gap = ((np.maximum(self.floor - low, 0) + np.maximum(low - self.roof, 0)) ** 2).sum(axis=1)
        return self.first + np.flatnonzero(gap <= reach)


class Tree:
    """A kd-tree over the projections of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, leaf: int = LEAF):
        self.basis = basis(vectors.shape[1], projections)
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        low = (vectors / norms[:, None]) @ self.basis
        leaves, stack = [], [np.arange(len(ids))]
        while stack:
            rows = stack.pop()
            spread = np.ptp(low[rows], axis=0)
            axis = int(spread.argmax())
            if len(rows) <= leaf or not spread[axis]:
                leaves += [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
                continue
            order = rows[np.argpartition(low[rows, axis], len(rows) // 2)]
            stack += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.norms, self.low = ids[order], vectors[order], norms[order], low[order]
        ends = np.cumsum([len(x) for x in leaves])
        self.spans = list(zip((ends - [len(x) for x in leaves]).tolist(), ends.tolist(), strict=True))
        self.floor = np.array([self.low[a:b].min(axis=0) for a, b in self.spans])
        self.roof = np.array([self.low[a:b].max(axis=0) for a, b in self.spans])

    def search(self, own: int, vector: np.ndarray, k: int, limit: float, reach: float = math.inf) -> tuple[list[int], list[float]]:
        """Ids and cosines of the k nearest found, nearest first, equal ones by id; ``limit``: the chi-square quantile.

        ``reach``: squared projected distance beyond which none is looked for, from neighbours that are known elsewhere.
        """
        norm = math.sqrt(vector @ vector)
        q = (vector / norm) @ self.basis
        gap = ((np.maximum(self.floor - q, 0) + np.maximum(q - self.roof, 0)) ** 2).sum(axis=1)
        ids, cosines = np.empty(0, np.int64), np.empty(0)
        for n in np.argsort(gap, kind="stable").tolist():
            if gap[n] > reach:
                break  # neither this leaf's nor any later leaf's vectors pass the test
            a, b = self.spans[n]
            away = ((self.low[a:b] - q) ** 2).sum(axis=1)
            rows = np.flatnonzero((away <= reach) & (self.ids[a:b] != own)) + a
            if not len(rows):
                continue
            found = np.clip(self.vectors[rows] @ vector / (self.norms[rows] * norm), -1.0, 1.0)
            ids, cosines = np.concatenate([ids, self.ids[rows]]), np.concatenate([cosines, found])
            best = np.lexsort((ids, -cosines))[:k]
            ids, cosines = ids[best], cosines[best]
            if len(ids) == k:
                reach = min(reach, reach_of(cosines[-1], limit))
        return ids.tolist(), cosines.tolist()


def reach_of(cosine: float, limit: float) -> float:
    """How far a projection may lie, squared, to be of use when the k-th neighbour found has this cosine (as near ones are, too)."""
    return (max(0.0, 2 - 2 * cosine) + 1e-12) * limit


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, vector) with an id and a vector that is neither null, empty nor zero and has finite components only."""
    kind = df.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    return rows.where(finite & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """All components in one row after another, in double precision, and where rows end."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()


def _by_length(column: pa.Array):
    """(rows, matrix of them) for each length of the vectors in a column."""
    flat, ends = _matrix(column)
    lengths = np.diff([0, *ends])
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        starts = np.array(ends)[rows] - n
        yield rows, flat[starts[:, None] + np.arange(n)]


def cells_of(kept: DataFrame, total: int, projections: int, cell: int, sample: int) -> dict[int, Cells]:
    """By length of vectors: cells of about ``cell`` of the ``total`` rows, split on about ``sample`` of them (a hash of the id)."""

    def run(batches):
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(list(project(x, projections)), pa.list_(pa.float64()))], names=["length", "low"])

    some = kept.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, total // sample))) == 0).limit(2 * sample)
    found: dict[int, list] = {}
    for r in some.select("vector").mapInArrow(run, "length int, low array<double>").collect():
        found.setdefault(r.length, []).append(r.low)
    out, first = {}, 0
    for n, low in sorted(found.items()):
        out[n] = Cells(np.unique(low, axis=0), first, math.ceil(len(low) / sum(map(len, found.values())) * total / cell))
        first += len(out[n].floor)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, chance: float = CHANCE, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k nearest found by cosine, itself left out.

    Vectors are dealt to the cells of one tree; a cell of more than ``cell`` rows (the sample misjudged it) is searched in
    parts. Of vectors that are copies of one another only the k + 1 smallest ids can be among any query's k nearest, so
    only these are indexed: a hot vector is cut down before the exchange (a partial limit in each task). Vectors of
    another length than the query's take no part with it, nor do unusable() ones. Rows that share an id count as one
    neighbour, by their nearest vector; of queries that share one, one is searched. Extra columns aren't read; without
    vectors or queries the result is empty. How many cells a query reaches depends on the data: few where neighbours are
    much nearer than the rest, all where they aren't.
    """
    copies = Window.partitionBy("vector").orderBy("id")
    kept = usable(vectors, id_col, vector_col).withColumn("r", F.dense_rank().over(copies)).where(F.col("r") <= k + 1).drop("r")
    total = usable(vectors, id_col, vector_col).count()
    limit = chi_square(chance, projections)
    cells = cells_of(usable(vectors, id_col, vector_col), total, projections, cell, sample)
    kind = kept.schema["vector"].dataType.simpleString()

    def place(batches):
        """Each row's own cell; a length that the sample missed has a cell of its own below 0."""
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for rows, x in _by_length(batch.column(1)):
                known = cells.get(x.shape[1])
                out[rows] = known.of(project(x, projections)) if known else -x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(0), batch.column(1)], names=["cell", "id", "vector"])

    def further(batches):
        """The other cells that a query may reach."""
        for batch in batches:
            out = [[]] * batch.num_rows
            own, kth = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for rows, x in _by_length(batch.column(2)):
                if known := cells.get(x.shape[1]):
                    for r, low in zip(rows.tolist(), project(x, projections), strict=True):
                        reach = math.inf if kth[r] is None else reach_of(kth[r], limit)
                        out[r] = [c for c in known.within(low, reach).tolist() if c != own[r]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())), *batch.columns[1:]], names=["cells", "id", "vector", "kth"])

    def search(batches):
        """Vectors (side 0) and queries (side 1) by cell and part, in this order."""
        now, trees, held = None, None, {}
        for batch in batches:
            out = ([], [], [])
            flat, ends = _matrix(batch.column(4))
            start = 0
            for c, part, side, i, kth, end in zip(*(batch.column(x).to_pylist() for x in (0, 1, 2, 3, 5)), ends, strict=True):
                x, start = flat[start:end], end
                if (c, part) != now:
                    now, trees, held = (c, part), None, {}
                if not side:
                    ids, rows_ = held.setdefault(len(x), ([], []))
                    ids.append(i)
                    rows_.append(np.array(x))
                    continue
                if trees is None:
                    trees = {n: Tree(np.array(ids), np.array(rows_), projections) for n, (ids, rows_) in held.items()}
                    held = {}
                if len(x) in trees:
                    found, scores = trees[len(x)].search(i, x, k, limit, math.inf if kth is None else reach_of(kth, limit))
                    out[0].extend([i] * len(found))
                    out[1].extend(found)
                    out[2].extend(scores)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    placed = written(kept.mapInArrow(place, f"cell bigint, id bigint, vector {kind}"), "vectors", 4)[0]
    # Cells of vectors: as many as the total over ``cell`` (a sampled length each has one at least), with their parts.
    sizes = placed.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (2 * cell))).alias("parts"))
    sizes = written(sizes, "cells")[0]
    tasks = max(1, min(sizes.agg(F.sum("parts")).first()[0] or 1, 8 * int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    held = placed.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(0).alias("side"), "id", "vector", F.lit(None).cast("double").alias("kth"))

    def searched(asked: DataFrame) -> DataFrame:
        sent = asked.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "vector", "kth")
        return held.unionByName(sent).repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "side").mapInArrow(search, "query_id bigint, vec_id bigint, score double")

    asked = usable(queries, id_col, vector_col).dropDuplicates(["id"]).select("id", F.col("vector").cast(kind).alias("vector")).mapInArrow(place, f"cell bigint, id bigint, vector {kind}")
    near = written(searched(asked.withColumn("kth", F.lit(None).cast("double"))), "nearest")[0]
    kth = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
    kth = kth.select(F.col("query_id").alias("id"), F.when(F.size("scores") >= k, F.element_at("scores", k)).alias("kth"))  # at most k a part of a cell
    far = asked.join(kth, "id", "left").select("cell", "id", "vector", "kth").mapInArrow(further, f"cells array<bigint>, id bigint, vector {kind}, kth double")
    met = near.unionByName(searched(far.select(F.explode("cells").alias("cell"), "id", "vector", "kth")))
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all other vectors, as nearest() finds them."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
