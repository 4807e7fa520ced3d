"""Centroid clustering (Lloyd's rounds) filtered by partition-local metric trees, in whole numbers.

Vectors become whole numbers, floor(64 * x). Each task cuts its rows into blocks and builds a balanced metric tree over each: a node holds a pivot (the rounded
mean of its rows), a radius around it, its count and its exact integer sum. The trees are written once; a round sends the k centroids to them and, level by level,
strikes off each node's centroids that the triangle inequality rules out. A ball with one centroid left goes to it whole, by its count and sum, without a look at its
rows; a leaf with several is decided row by row, exactly. What comes back from a tree is k counts and sums, which Spark adds up.

Bounds are widened by more than the rounding of the square roots, so that they only ever rule out what is truly further; rows that are compared are compared in exact
integers. So the result is that of plain exact rounds, whatever the trees are like.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import Scratch

SCALE = 64
BLOCK = 4096  # rows of a tree
LEAF = 32  # rows of a leaf at most
LIMIT = 2**27  # whole numbers below it have squared distances that fit a long up to 64 places
TREE = "ids array<long>, vectors binary, starts binary, pivots binary, radii binary, sums binary"
SUMS = "cluster int, n long, sums array<long>"
PLACED = "vec_id long, cluster int, distance long"


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(id, v): floor(64 * x) of each vector of exactly ``size`` numbers that are neither null nor NaN nor infinite; other rows are left out. A number beyond what
    exact distances allow raises."""
    x = F.col(vec_col).cast("array<double>")
    fits = x.isNotNull() & (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    small = F.forall("x", lambda e: F.abs(e) * SCALE < LIMIT)
    kept = vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    whole = F.transform("x", lambda e: F.floor(e * SCALE).cast("int"))
    return kept.select("id", F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT // SCALE}: its distances don't fit a long"))).alias("v"))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows, as int64; by way of doubles where these hold every sum exactly."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, pivots, radii, sums) of a perfectly balanced tree over whole-number rows, its nodes as in a heap: node i has the children 2i+1 and 2i+2, and
    the rows order[starts[i, 0]:starts[i, 1]]. A node is halved across the line between two far rows."""
    n, depth = len(x), 0
    while -(-n // 2**depth) > LEAF:
        depth += 1
    order, count = np.arange(n), 2 ** (depth + 1) - 1
    starts = np.zeros((count, 2), np.int64)
    pivots, radii, sums = np.zeros((count, x.shape[1])), np.zeros(count), np.zeros((count, x.shape[1]), np.int64)
    starts[0] = 0, n
    for i in range(count):
        lo, hi = starts[i]
        rows = x[order[lo:hi]]
        sums[i] = rows.sum(0)
        pivots[i] = np.rint(sums[i] / max(1, hi - lo))
        far = ((rows - pivots[i]) ** 2).sum(1)
        radii[i] = np.sqrt(far.max(initial=0)) * (1 + 1e-12)
        if 2 * i + 2 < count:
            a = rows[far.argmax()]
            b = rows[((rows - a).astype(np.float64) ** 2).sum(1).argmax()]
            mid = (hi - lo) // 2
            side = np.argpartition((rows - a).astype(np.float64) @ (b - a).astype(np.float64), mid)
            order[lo:hi] = order[lo:hi][side]
            starts[2 * i + 1], starts[2 * i + 2] = (lo, lo + mid), (lo + mid, hi)
    return order, starts, pivots, radii, sums


def filtered(pivots: np.ndarray, radii: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, leaf): for each node the centroid that all its rows belong to, where it is the topmost such, else -1; and whether it is a leaf to be decided row by row."""
    count = len(radii)
    far = np.sqrt(((pivots[:, None, :] - centroids[None, :, :]) ** 2).sum(2))
    slack = 1e-9 * (1 + far.max(initial=0))
    mask = np.zeros((count, len(centroids)), bool)
    mask[0] = True
    owner, leaf = np.full(count, -1), np.zeros(count, bool)
    first = (count + 1) // 2 - 1  # of the leaves
    lo = 0
    while lo < count:  # a level is 2^l nodes
        hi = 2 * lo + 1
        level = mask[lo:hi]
        reach = np.where(level, far[lo:hi] + radii[lo:hi, None], np.inf).min(1)
        level &= far[lo:hi] - radii[lo:hi, None] <= reach[:, None] + slack
        left = level.sum(1)
        one = np.flatnonzero(left == 1) + lo
        owner[one] = mask[one].argmax(1)
        if lo >= first:
            leaf[lo:hi] = left > 1
        else:
            down = np.where(left[:, None] > 1, level, False)
            mask[2 * lo + 1 : 2 * hi + 1] = np.repeat(down, 2, axis=0)
        lo = hi
    return owner, leaf


def _builder(size: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = some.column(1).combine_chunks() if isinstance(some.column(1), pa.ChunkedArray) else some.column(1)
                x = x.flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, size).astype(np.int64)
                order, starts, pivots, radii, sums = build(x)
                cols = [pa.array([some.column(0).take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))]
                cols += [pa.array([a.tobytes()], pa.binary()) for a in (x[order].astype(np.int32), starts, pivots, radii, sums)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in TREE.split(", ")])

    return run


def _unpack(row: dict, size: int) -> tuple:
    x = np.frombuffer(row["vectors"], np.int32).reshape(-1, size).astype(np.int64)
    starts = np.frombuffer(row["starts"], np.int64).reshape(-1, 2)
    pivots, radii = np.frombuffer(row["pivots"]).reshape(-1, size), np.frombuffer(row["radii"])
    return x, starts, pivots, radii, np.frombuffer(row["sums"], np.int64).reshape(-1, size)


def _each_tree(batches):
    """One tree at a time, so that memory is bounded by a tree."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield from batch.slice(i, 1).to_pylist()


def _summer(centroids: np.ndarray):
    """Counts and sums per centroid of each tree."""
    k, size = centroids.shape

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for row in _each_tree(batches):
            x, starts, pivots, radii, sums = _unpack(row, size)
            owner, leaf = filtered(pivots, radii, centroids)
            whole = np.flatnonzero(owner >= 0)
            np.add.at(n, owner[whole], starts[whole, 1] - starts[whole, 0])
            np.add.at(total, owner[whole], sums[whole])
            rows = [x[lo:hi] for lo, hi in starts[leaf]]
            if rows:
                rows = np.concatenate(rows)
                best = squared_distances(rows, centroids).argmin(1)  # the first of equals
                n += np.bincount(best, minlength=k)
                np.add.at(total, best, rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _placer(centroids: np.ndarray):
    """Each row with its centroid and squared distance; rows of a whole ball are measured against its centroid alone."""
    size = centroids.shape[1]

    def run(batches):
        for row in _each_tree(batches):
            x, starts, pivots, radii, _ = _unpack(row, size)
            owner, leaf = filtered(pivots, radii, centroids)
            cluster = np.full(len(x), -1, np.int32)
            for i in np.flatnonzero(owner >= 0):
                cluster[starts[i, 0] : starts[i, 1]] = owner[i]
            open_ = cluster < 0
            if open_.any():
                cluster[open_] = squared_distances(x[open_], centroids).argmin(1)
            distance = ((x - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def start(whole: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the least SHA-256 of ``seed:id``, in its order; ids that repeat are told apart by their numbers, null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["v"] for r in whole.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of each vector after ``rounds`` rounds, the final centroids).

    Vectors that are null, of another length than ``size``, or hold a null, NaN or infinite component are left out, as are all other columns whatever their names.
    Repeated rows and ids count each, as do rows with a null id, which start no centroid while others can. Fewer vectors than k make as many centroids; an empty
    table gives no rows and no centroids. Equal distances go to the smaller number; an empty centroid stays where it is.
    """
    scratch = Scratch(vectors.sparkSession, "ball-tree")
    whole = whole_vectors(vectors, id_col, vec_col, size)
    trees = scratch.table(whole.mapInArrow(_builder(size), TREE), "trees")
    first = start(whole, k, seed)
    if not first:
        return vectors.sparkSession.createDataFrame([], PLACED), []
    centroids = np.array(first, np.int64)
    for _ in range(rounds):
        sums = trees.mapInArrow(_summer(centroids), SUMS)
        added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():  # k rows
            if r["n"]:
                centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    placed = scratch.table(trees.mapInArrow(_placer(centroids), PLACED), "placed")
    scratch.drop("trees")
    return placed, centroids.tolist()


def report(placed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The rows of ``placed`` with their cluster's and all clusters' summed distance, and their final centroid's digest."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    all_ = placed.agg(F.sum("distance").alias("inertia"))  # one row
    named = placed.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    facts = reduce(lambda a, b: a.join(b, "cluster"), (each, named)).crossJoin(F.broadcast(all_))
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
