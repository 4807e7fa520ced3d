"""Retrieval index (U2): inverted lists over k-means cells, kept as a bucketed table and probed by a join.

Cells are fitted on a bounded sample, all rows are indexed. A cell's vectors lie in parts of about ``PART`` rows, a row of the table each, bucketed and sorted by (cell, part), so that
a cell of any size is spread over all buckets and a search moves no indexed vector. A query goes to the parts of its nearest cells; queries that meet in a part travel in blocks
and are compared with it in one matrix product. How many cells a query has to probe is measured against exact answers, for which all parts pass by the held queries. Vectors never pass through the driver; the cells' centroids, of a stated number, do.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from threadlake.functions.vectors import l2_normalize
from threadlake.operators.sampling import uniform
from threadlake.session import Scratch

PART = 1024  # vectors of a row of the index, about
ASKED = 256  # queries of a block at most
STRIPES = 24  # of the index, where all of it is compared
HELD = 65_536  # queries of a task then, about
FIT_SAMPLE = 20_000  # rows that the cells are fitted on
MOST_CELLS = 1024
PROBE_SAMPLE, SHARE = 200, 0.95  # queries on which the number of probes is measured, and the share of their neighbours that it has to reach
FOUND = "id long, matches array<long>, cosines array<double>"


@dataclass
class Index:
    """A built index: the table of lists, (cell, centroid), and (cell, parts), all in written tables."""

    lists: str
    centroids: DataFrame
    parts: DataFrame
    cells: int
    scratch: Scratch

    def drop(self) -> None:
        self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self.lists}")
        self.scratch.drop(*self.scratch.made, self.lists)


def units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, u, v): vectors of length 1 beside those given; rows without an id or a vector, and those whose vector is all zero or not finite, are left out."""
    u = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), l2_normalize(F.col(vec_col)).alias("u"), F.col(vec_col).alias("v"))
    return u.where(F.exists("u", lambda x: x != 0) & F.forall("u", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.0001)))


def _near(shared, at: int, n: int | None):
    """The rows, whose unit vectors are column ``at``, with their n nearest cells, nearest first; of equally near ones the lesser."""

    def run(batches):
        cells, c = shared.value
        square = (c**2).sum(1)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                u = part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)[:, : c.shape[1]]  # an empty index has centroids without places
                far = square - 2 * (u @ c.T)  # of unit vectors the nearest centroid has the least |c|^2 - 2 u c
                order = far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
                ends = np.arange(0, order.size + 1, order.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells[order.ravel()]))], [*part.schema.names, "cells"])

    return run


def nearest_cells(rows: DataFrame, centroids: DataFrame, n: int | None = None) -> DataFrame:
    """Adds ``cells``: the ``n`` nearest (all, by default) by the distance of their centroids to ``u``, nearest first. The centroids, ``MOST_CELLS`` at most, go to the tasks as one matrix, with
    which they multiply blocks of rows."""
    found = sorted((r["cell"], r["c"]) for r in centroids.collect())
    shared = rows.sparkSession.sparkContext.broadcast((np.array([cell for cell, _ in found], np.int32), np.array([c for _, c in found], np.float64)))
    return rows.mapInArrow(_near(shared, rows.columns.index("u"), n), StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))]))


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, seed: int = 0, sample: int = FIT_SAMPLE) -> Index:
    """Index all rows. ``cells``: by default the square root of the number of rows, at most ``MOST_CELLS``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "retrieval")
    rows = scratch.table(units(vectors, id_col, vec_col), "units")
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(max(1, rows.count()))))
    fitted = uniform(rows, sample, seed, "id").select(array_to_vector("u").alias("features"))
    found = KMeans(k=cells, seed=seed, maxIter=10).fit(fitted).clusterCenters() if cells > 1 and not rows.isEmpty() else []
    dim = rows.select(F.size("u").alias("n")).first()
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(found)] or [(0, [0.0] * (dim["n"] if dim else 0))]
    centroids = scratch.table(spark.createDataFrame(centres, "cell int, c array<double>"), "centroids")
    placed = scratch.table(nearest_cells(rows, centroids, 1).select(F.col("cells")[0].alias("cell"), "id", "v"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    parts = scratch.table(sizes, "parts")
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row per cell is broadcast
    packed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("m"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"threadlake_index_{uuid.uuid4().hex}"
    out = packed.select("cell", "part", F.col("m.id").alias("ids"), F.flatten("m.v").alias("vs")).repartition(buckets, "cell", "part")
    out.write.bucketBy(buckets, "cell", "part").sortBy("cell", "part").option("path", scratch.path(name)).saveAsTable(name, format="parquet")
    scratch.drop("units", "placed")
    scratch.made = [m for m in scratch.made if m not in ("units", "placed")]
    return Index(name, centroids, parts, len(centres), scratch)


def _compare(k: int, digits: int):
    """A row is a part and a block of queries: for each of these its k best of the part, itself left out, by rounded cosine and then the lesser id."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vs, asked, qs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(4))
                q, x = qs.astype(np.float64).reshape(len(asked), -1), vs.astype(np.float64).reshape(len(ids), -1)
                q, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (q, x))
                s = np.round(q @ x.T, digits)
                s[asked[:, None] == ids[None, :]] = -np.inf
                n = min(k, len(ids))
                edge = np.partition(s, -n, axis=1)[:, -n]
                out = []
                for row, least in zip(s, edge, strict=True):
                    near = np.flatnonzero((row >= least) & np.isfinite(row))
                    near = near[np.lexsort((ids[near], -row[near]))][:n]
                    out.append((ids[near], row[near]))
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.float64()))], ["id", "matches", "cosines"])

    return run


class _Held:
    """Queries, and of what passes by the k nearest of each, by rounded cosine and then the lesser id."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, digits: int):
        self.asked, self.q = (np.concatenate(p) for p in zip(*blocks, strict=True))
        self.k, self.digits = k, digits
        self.ids, self.cosines = np.zeros((len(self.asked), k), np.int64), np.full((len(self.asked), k), -np.inf)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(self.asked), PART):
            piece = slice(at, at + PART)
            s, least = self.q[piece] @ x.T, self.cosines[piece, -1]
            if np.isneginf(least).any():
                s[self.asked[piece, None] == ids] = -np.inf
                n = min(self.k, len(ids))
                least = np.maximum(least, np.partition(s, -n, axis=1)[:, -n] if n == self.k else -np.inf)
            i, j = np.nonzero(s >= (least - 10.0**-self.digits)[:, None])
            other = np.isfinite(s[i, j]) & (ids[j] != self.asked[at + i])
            if other.any():
                self._take(i[other] + at, ids[j[other]], np.round(s[i[other], j[other]], self.digits))

    def _take(self, i: np.ndarray, ids: np.ndarray, cosines: np.ndarray) -> None:
        rows = np.unique(i)
        i, ids, cosines = np.concatenate((i, np.repeat(rows, self.k))), np.concatenate((ids, self.ids[rows].ravel())), np.concatenate((cosines, self.cosines[rows].ravel()))
        order = np.lexsort((ids, -cosines, i))
        i = i[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        nth = np.arange(len(i)) - np.repeat(starts, np.diff(starts, append=len(i)))
        top = nth < self.k
        self.ids[i[top], nth[top]], self.cosines[i[top], nth[top]] = ids[order][top], cosines[order][top]

    def told(self):
        for at in range(0, len(self.asked), PART):
            ids, cosines = self.ids[at : at + PART], self.cosines[at : at + PART]
            there = np.isfinite(cosines)
            ends = pa.array(np.concatenate(([0], np.cumsum(there.sum(1)))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[there])) for v in (ids, cosines)]
            yield pa.RecordBatch.from_arrays([pa.array(self.asked[at : at + PART]), *lists], ["id", "matches", "cosines"])


def _passed(k: int, digits: int):
    """The rows of a tile come together, its queries (side 0) before the parts of the index."""

    def run(batches):
        at, blocks, held = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                tile, side = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if tile != at:
                    if held:
                        yield from held.told()
                    at, blocks, held = tile, [], None
                ids, v = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3 + side))
                x = v.astype(np.float64).reshape(len(ids), -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                if side == 0:
                    blocks.append((ids, x))
                elif blocks:
                    held = held or _Held(blocks, k, digits)
                    held.see(ids, x)
        if held:
            yield from held.told()

    return run


def _exact(index: Index, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """Each query and its k best of each stripe of the index. The parts are dealt into ``STRIPES`` stripes, the queries into stripes of ``HELD`` at most; a tile, one of either, is a task's work,
    so a query is sent once per stripe of the index, and the index once per ``HELD`` queries. A task holds the tile's queries."""
    n, parts = queries.count(), index.parts.agg(F.coalesce(F.sum("parts"), F.lit(0)).alias("n")).first()["n"]
    tall, wide = max(1, -(-n // HELD)), max(1, min(STRIPES, parts))
    lists = index.scratch.spark.table(index.lists)
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // ASKED)))).cast("int")
    met = queries.groupBy(block.alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("m"))
    met = met.select(F.pmod("b", F.lit(tall)).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("w"), F.lit(0).alias("side"), F.col("m.id").alias("ids"), F.flatten("m.v").alias("qs"), F.lit(None).cast(lists.schema["vs"].dataType).alias("vs"))
    stripe = F.pmod(F.xxhash64("cell", "part"), F.lit(wide)).cast("int")
    passing = lists.select(F.explode(F.sequence(F.lit(0), F.lit(tall - 1))).alias("t"), stripe.alias("w"), F.lit(1).alias("side"), "ids", F.lit(None).cast(met.schema["qs"].dataType).alias("qs"), "vs")
    tiles = met.unionByName(passing).select((F.col("t") * wide + F.col("w")).alias("tile"), "side", "ids", "qs", "vs")
    return tiles.repartition(tall * wide, "tile").sortWithinPartitions("tile", "side").mapInArrow(_passed(k, digits), FOUND)


def _probed(index: Index, asked: DataFrame, k: int, probes: int, digits: int) -> DataFrame:
    """Each query and its k best of each part of its nearest cells. No indexed vector is moved."""
    queries = nearest_cells(asked, index.centroids, probes).select("id", "v", F.explode("cells").alias("cell"))
    at = queries.join(F.broadcast(index.parts), "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # blocks of queries: numbered by a hash within as many as an even share of all queries makes
    blocks = max(1, -(-asked.select("id").distinct().count() // ASKED))
    met = at.groupBy("cell", "part", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("m"))
    met = met.select("cell", "part", F.col("m.id").alias("asked"), F.flatten("m.v").alias("qs"))
    pairs = index.scratch.spark.table(index.lists).join(met.hint("merge"), ["cell", "part"])
    return pairs.select("ids", "vs", "asked", "qs").mapInArrow(_compare(k, digits), FOUND)


def search(index: Index, asked: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(id, match_id, cosine, rank): for each query its k nearest of the indexed rows in the ``probes`` nearest cells, rows with its own id left out; all cells, and so exact answers, by default.
    Cosines are rounded; of equal ones the lesser id comes first. A query's k best of each part, or stripe, are kept before anything is shuffled."""
    queries = units(asked, id_col, vec_col)
    best = _exact(index, queries.select("id", "v"), k, digits) if probes is None or probes >= index.cells else _probed(index, queries, k, probes, digits)
    each = best.select("id", F.explode(F.arrays_zip("matches", "cosines")).alias("x")).select("id", F.col("x.matches").alias("match_id"), F.col("x.cosines").alias("cosine")).distinct()
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "match_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (wanted, hit, recall): how many of the exact answers (id, match_id) were found."""
    got = found.select("id", "match_id", F.lit(1).alias("one"))
    return exact.join(got, ["id", "match_id"], "left").agg(F.count("*").alias("wanted"), F.count("one").alias("hit")).withColumn("recall", F.col("hit") / F.greatest("wanted", F.lit(1)))


def measured_probes(index: Index, asked: DataFrame, k: int, share: float = SHARE, sample: int = PROBE_SAMPLE, seed: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
    """The least number of cells that holds ``share`` of the exact answers of a bounded sample of the queries: the place, among a query's cells, of each answer's cell."""
    some = uniform(asked, sample, seed, id_col)
    exact = search(index, some, k, None, id_col, vec_col).select("id", "match_id")
    home = index.scratch.spark.table(index.lists).select("cell", F.explode("ids").alias("match_id"))
    order = nearest_cells(units(some, id_col, vec_col), index.centroids).select("id", "cells")
    place = exact.join(home, "match_id").join(order, "id").select(F.array_position("cells", F.col("cell")).alias("p"))
    counts = place.groupBy("p").count().orderBy("p").collect()  # a row per cell
    total, held = sum(r["count"] for r in counts), 0
    for r in counts:
        held += r["count"]
        if held >= share * total:
            return int(r["p"])
    return index.cells

