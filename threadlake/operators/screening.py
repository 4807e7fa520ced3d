"""Near-duplicate screen (U1): golden rows that lie close to an indexed one, by random-projection hashing, and the scores with and without them.

A vector's hash is the sign of its product with a random direction; two vectors at an angle a share it with a chance of 1 - a / pi. Several signs make a key, several keys a vector's
buckets: as many as let a pair at the threshold miss all of them with a chance of ``MISS``. Vectors that share a bucket are compared exactly, in it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.operators.retrieval import units
from threadlake.session import Scratch

SIGNS = 12  # of a key
MISS = 1e-6
SQUARE = 1024  # vectors of a side that are compared at once
DEALT = 250_000  # keyed vectors of a task, about


def keys_for(threshold: float, signs: int = SIGNS, miss: float = MISS) -> int:
    """How many keys a vector needs."""
    same = (1 - math.acos(threshold) / math.pi) ** signs
    return max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


def _keyed(size: int, signs: int, keys: int, seed: int, at: int):
    """A row per key, which is its number and its signs, with the row, whose vector is column ``at``."""

    def run(batches):
        directions = np.random.default_rng(seed).normal(size=(size, signs * keys))
        weights = 2 ** np.arange(signs, dtype=np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                n = part.num_rows
                x = part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, size)
                key = ((x @ directions >= 0).reshape(n, keys, signs) * weights).sum(2) + (np.arange(keys, dtype=np.int64) << signs)
                each = part.take(pa.array(np.repeat(np.arange(n), keys)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *each.columns], ["key", *each.schema.names])

    return run


def _first(i: np.ndarray, ids: np.ndarray, cosines: np.ndarray):
    """Per i the greatest cosine, of equal ones the lesser id."""
    order = np.lexsort((ids, -cosines, i))
    top = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
    return i[top], ids[top], cosines[top]


def _nearest(asked, q, first, second, x, threshold: float, digits: int):
    """(place of the query, id, cosine) of the nearest vector above the threshold. A vector stands for one or two ids; a query's own doesn't count."""
    out = []
    for at in range(0, len(q), SQUARE):
        for to in range(0, len(x), SQUARE):
            s = np.round(q[at : at + SQUARE] @ x[to : to + SQUARE].T, digits)
            i, j = np.nonzero(s > threshold)
            ids = np.where(first[to + j] == asked[at + i], second[to + j], first[to + j])
            other = ids != asked[at + i]
            out.append(_first(i[other] + at, ids[other], s[i[other], j[other]]))
    return _first(*(np.concatenate(o) for o in zip(*out, strict=True)))


def _unit(vectors: pa.ListArray, n: int) -> np.ndarray:
    if not n:
        return np.zeros((0, 0))
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _compared(threshold: float, digits: int):
    """The rows of a key come together, the golden ones (side 0) before the others: for each golden row its nearest of the key, where that is near enough."""

    def run(batches):
        at, asked, golden = None, None, None
        for batch in batches:
            key, side, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            right = np.concatenate(([0], np.cumsum(side)))  # indexed rows before each row
            g, x = _unit(batch.column(4), len(side) - int(right[-1])), _unit(batch.column(5), int(right[-1]))
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            found = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                mid = hi - int(right[hi] - right[lo])
                mine = a[lo:mid], g[lo - right[lo] : mid - right[mid]]
                if key[lo] != at:
                    at, asked, golden = key[lo], *mine
                elif mid > lo:  # the key's golden rows go on from the batch before
                    asked, golden = (np.concatenate(p) if len(p[0]) else p[1] for p in zip((asked, golden), mine, strict=True))
                if len(asked) and hi > mid:
                    i, ids, cosines = _nearest(asked, golden, a[mid:hi], b[mid:hi], x[right[mid] : right[hi]], threshold, digits)
                    found.append((asked[i], ids, cosines))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found, strict=True)], ["id", "best_id", "cosine"])

    return run


def near_screen(golden: DataFrame, indexed: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", signs: int = SIGNS, miss: float = MISS, seed: int = 0, digits: int = 6) -> DataFrame:
    """(id, best_id, cosine): golden vectors with an indexed one of another id at a (rounded) cosine above the threshold, and the nearest such; of equal ones the lesser id.

    Equal indexed vectors are one before anything is dealt, so that copies never meet as pairs. A vector goes to the bucket of each of its keys, and is compared there: pairs are never
    rows, so what is shuffled grows as the vectors do. A task holds a bucket's golden vectors, the others pass by.
    """
    spark = golden.sparkSession
    scratch = Scratch(spark, "screen")
    left = scratch.table(units(golden, id_col, vec_col).drop("u"), "golden")
    size = left.select(F.size("v").alias("n")).first()
    if size is None:
        return spark.createDataFrame([], "id long, best_id long, cosine double")
    rows = units(indexed, id_col, vec_col)
    first = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("u").orderBy("id"))).where("nth <= 2")  # one of the two isn't the golden row's own
    right = scratch.table(first.groupBy("u").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.first("v").alias("v")).drop("u"), "indexed")
    keys = keys_for(threshold, signs, miss)
    kind, other = (df.schema["v"].dataType.simpleString() for df in (left, right))
    schema = f"key long, side int, a long, b long, g {kind}, x {other}"

    def keyed(df, at, *columns):
        return df.select(*columns).mapInArrow(_keyed(size["n"], signs, keys, seed, at), schema)

    g = keyed(left, 3, F.lit(0).alias("side"), F.col("id").alias("a"), F.col("id").alias("b"), F.col("v").alias("g"), F.lit(None).cast(other).alias("x"))
    x = keyed(right, 4, F.lit(1).alias("side"), "a", "b", F.lit(None).cast(kind).alias("g"), F.col("v").alias("x"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-right.count() * keys // DEALT))
    met = g.unionByName(x).repartition(tasks, "key").sortWithinPartitions("key", "side")
    near = met.mapInArrow(_compared(threshold, digits), "id long, best_id long, cosine double")
    best = near.groupBy("id").agg(F.max_by(F.struct("best_id", "cosine"), F.struct("cosine", -F.col("best_id"))).alias("x"))
    return best.select("id", "x.best_id", "x.cosine")


def screen_report(scored: DataFrame, near: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(stratum, n, screened, accuracy_with, accuracy_without) of ``scored`` (id, stratum, label_intent, predicted): how many rows the screen takes out, and the share of right
    predictions before and after. Strata are never pooled; a stratum that loses all its rows has no accuracy without."""
    flag = scored.where("label_intent IS NOT NULL").join(near.select(F.col("id").alias(id_col), F.lit(True).alias("_near")), id_col, "left")
    right = (F.col("predicted") == F.col("label_intent")).cast("double")
    kept = F.when(F.col("_near").isNull(), F.coalesce(right, F.lit(0.0)))
    return flag.groupBy("stratum").agg(
        F.count("*").alias("n"), F.count("_near").alias("screened"), F.round(F.avg(F.coalesce(right, F.lit(0.0))), 6).alias("accuracy_with"), F.round(F.avg(kept), 6).alias("accuracy_without")
    )
