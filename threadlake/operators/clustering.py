"""Clustering: k sweep and fits (M2-M4), silhouette (M5), Lloyd step (M6), sizes and representatives (A3, W5), sweep checks (A10-A12), labels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.parsing import parse_label
from threadlake.functions.vectors import doubles, euclidean
from threadlake.operators.sampling import uniform
from threadlake.session import Scratch

SILHOUETTE_SAMPLE = 5000
BLOCK = 1024  # rows of a block, about
STRIPES = 12  # of blocks, any two of which are a task's work
STRIPE = 131_072  # rows of a stripe, about; beyond, there are more stripes
PIECE = 4096  # rows of a stripe that a block meets at a time
WEAK = 0.25
UNREADABLE = "unlabelled_cluster_"
STRICT_SUFFIX = "\n\nThe last answer could not be read. Give the JSON object and nothing before or after it."


def fit(vectors: DataFrame, k: int, seed: int, runs: int = 10, vec_col: str = "embedding") -> KMeansModel:
    """The best of ``runs`` seeded k-means fits by training cost."""
    data = vectors.select(array_to_vector(doubles(F.col(vec_col))).alias("features")).persist()
    try:
        return min((KMeans(k=k, seed=seed + i, featuresCol="features").fit(data) for i in range(runs)), key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()


def assign(vectors: DataFrame, model: KMeansModel, vec_col: str = "embedding") -> DataFrame:
    out = model.transform(vectors.withColumn("features", array_to_vector(doubles(F.col(vec_col)))))
    return out.withColumnRenamed("prediction", "cluster").drop("features")


def centroids(vectors: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """(cluster, centroid): means per place, aggregated map-side."""
    each = vectors.select(F.col(cluster_col).alias("cluster"), F.posexplode(doubles(F.col(vec_col))).alias("pos", "x"))
    means = each.groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest(vectors: DataFrame, centres: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance) by the nearest of k centroids, which travel with every row as one array; ties go to the lesser cluster."""
    few = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("cs"))  # one row of k centroids
    near = F.transform("cs", lambda c: F.struct(F.round(euclidean(F.col(vec_col), c["centroid"]), 9).alias("distance"), c["cluster"].alias("cluster")))
    best = F.array_min(near)
    return vectors.crossJoin(F.broadcast(few)).select(F.col(id_col), best["cluster"].alias("cluster"), best["distance"].alias("distance"))


def lloyd_step(vectors: DataFrame, cluster_col: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return nearest(vectors, centroids(vectors, cluster_col, vec_col), id_col, vec_col)


def distances(vectors: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """Each row with the distance to its own centroid; the k centroids are broadcast."""
    centres = centroids(vectors, cluster_col, vec_col).withColumnRenamed("cluster", "_c")
    return vectors.join(F.broadcast(centres), F.col(cluster_col) == F.col("_c")).withColumn("distance", euclidean(F.col(vec_col), F.col("centroid"))).drop("_c", "centroid")


def inertia(vectors: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    d = distances(vectors, cluster_col, vec_col)
    return d.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("distance") ** 2), 4).alias("inertia"))


def sizes(vectors: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    n = vectors.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count("*").alias("n"))
    total = vectors.agg(F.count("*").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("cluster", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def representatives(vectors: DataFrame, n: int = 12, cluster_col: str = "cluster", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The n rows of each cluster that are nearest to its centroid; a top-n per group before the shuffle."""
    d = distances(vectors, cluster_col, vec_col).withColumn("distance", F.round("distance", 9))
    rank = Window.partitionBy(cluster_col).orderBy("distance", id_col)
    return d.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def _packed(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """((b, labels, vs), number of blocks): rows dealt by a hash into blocks of about ``BLOCK``, as flat arrays."""
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("c", "v")).alias("m"))
    return scratch.table(dealt.select("b", F.col("m.c").alias("labels"), F.flatten("m.v").alias("vs")), "blocks"), blocks


class _Stripe:
    """Blocks of rows, which other blocks meet one by one: all distances are summed per row and cluster, for both sides."""

    def __init__(self, blocks: list[tuple[int, np.ndarray, np.ndarray]]):
        self.numbers, self.labels = [b for b, _, _ in blocks], [labels for _, labels, _ in blocks]
        self.x = np.concatenate([x for _, _, x in blocks])
        self.wide = np.column_stack((-2 * self.x, (self.x**2).sum(1), np.ones(len(self.x))))  # a product with (y, 1, y^2) is a squared distance
        self.kinds, self.counts, self.marks = _marks(np.concatenate(self.labels))
        self.sums: dict[int, np.ndarray] = {}
        self.met: dict[int, int] = {}

    def meet(self, labels: np.ndarray, y: np.ndarray, both: bool) -> np.ndarray:
        """The block's sums of distances to this stripe's rows per cluster of these; with ``both`` this stripe's rows also keep theirs to the block."""
        wide = np.column_stack((y, np.ones(len(y)), (y**2).sum(1))).T
        kinds, counts, marks = _marks(labels)
        out = np.zeros((len(y), len(self.kinds)))
        for c, n in zip(kinds.tolist() if both else (), counts.tolist(), strict=False):
            self.sums.setdefault(c, np.zeros(len(self.x)))
            self.met[c] = self.met.get(c, 0) + n
        for at in range(0, len(self.x), PIECE):
            piece = slice(at, at + PIECE)
            d = self.wide[piece] @ wide
            if d.min() < 1e-6:  # where the products' rounding shows: distances of such pairs are taken plainly
                i, j = np.nonzero(d < 1e-6)
                for k in range(0, len(i), 1 << 16):
                    i2, j2 = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    d[i2, j2] = ((self.x[at + i2] - y[j2]) ** 2).sum(1)
            np.sqrt(d, out=d)
            out += d.T @ self.marks[piece]
            if both:
                for c, total in zip(kinds.tolist(), (d @ marks).T, strict=True):
                    self.sums[c][piece] += total
        return out

    def told(self):
        """(block, labels, clusters, rows of these, sums) of its own blocks, from all blocks met."""
        at, kinds = 0, sorted(self.sums)
        for b, labels in zip(self.numbers, self.labels, strict=True):
            yield b, labels, kinds, [self.met[c] for c in kinds], np.column_stack([self.sums[c][at : at + len(labels)] for c in kinds])
            at += len(labels)


def _marks(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clusters, their rows, 0 or 1 per row and cluster)."""
    kinds, at, counts = np.unique(labels, return_inverse=True, return_counts=True)
    marks = np.zeros((len(labels), len(kinds)))
    marks[np.arange(len(labels)), at] = 1
    return kinds, counts, marks


SUMS = "b int, labels array<int>, cs array<int>, ns array<long>, totals array<double>"


def _distance_sums(stripes: int):
    """The blocks of two stripes come together, those of the first one before the others: per block of either its sums of distances to the other stripe, or, where both are one, to its own."""

    def row(b, labels, cs, ns, totals):
        lists = [pa.array([v], pa.list_(t)) for v, t in ((labels, pa.int32()), (cs, pa.int32()), (ns, pa.int64()), (totals.ravel(), pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *lists], ["b", "labels", "cs", "ns", "totals"])

    def told(pair, held, stripe):
        if pair // stripes == pair % stripes:
            stripe = _Stripe(held)
            for b, labels, x in held:
                yield row(b, labels, stripe.kinds, stripe.counts, stripe.meet(labels, x, False))
        elif stripe:
            for each in stripe.told():
                yield row(*each)

    def run(batches):
        at, held, stripe = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                pair, side, b = (batch.column(k)[i].as_py() for k in range(3))
                labels, vs = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (3, 4))
                x = vs.astype(np.float64).reshape(len(labels), -1)
                if pair != at:
                    if at is not None:
                        yield from told(at, held, stripe)
                    at, held, stripe = pair, [], None
                if side == 0:
                    held.append((b, labels, x))
                elif held:  # a stripe has a block at least, but a block of a hash may have no rows
                    stripe = stripe or _Stripe(held)
                    yield row(b, labels, stripe.kinds, stripe.counts, stripe.meet(labels, x, True))
        if at is not None:
            yield from told(at, held, stripe)

    return run


def _scores(batches):
    """(total, n): a block's sums come from every stripe in turn; the sum of its rows' scores, and the rows."""

    def told(labels, sums):
        kinds = np.array(sorted(sums))
        totals, ns = np.column_stack([sums[c][0] for c in kinds]), np.array([sums[c][1] for c in kinds])
        mine = labels[:, None] == kinds
        n = ns[mine.argmax(1)]
        a = totals[mine] / np.maximum(n - 1, 1)
        b = np.where(mine, np.inf, totals / ns).min(1)
        top = np.maximum(a, b)
        s = np.where(np.isinf(b), -1.0, np.where((n == 1) | (top == 0), 0.0, (b - a) / np.where((top == 0) | np.isinf(top), 1.0, top)))
        return pa.RecordBatch.from_arrays([pa.array([float(s.sum())]), pa.array([len(s)], pa.int64())], ["total", "n"])

    at, own, sums = None, None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.column(0)[i].as_py()
            labels, cs, ns, totals = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(1, 5))
            if b != at:
                if at is not None:
                    yield told(own, sums)
                at, own, sums = b, labels, {}
            for c, n, total in zip(cs.tolist(), ns.tolist(), totals.reshape(len(labels), -1).T, strict=True):
                before, m = sums.get(c, (0.0, 0))
                sums[c] = before + total, m + n
    if at is not None:
        yield told(own, sums)


def silhouette(vectors: DataFrame, cluster_col: str = "cluster", id_col: str = "vec_id", vec_col: str = "embedding", sample: int | None = SILHOUETTE_SAMPLE, seed: int = 0) -> DataFrame:
    """(silhouette, n): the mean Euclidean silhouette, a single member scoring 0 and one cluster alone -1; over all rows, or over a sample of a stated size.

    Every row meets every row, as the measure asks for: blocks are dealt into ``STRIPES`` stripes, and each pair of stripes is a task's work, which gives both sides their sums of distances
    per cluster. So what is shuffled is each vector once per stripe, and a sum per row, cluster and stripe: in proportion to the rows, until a stripe would have more than ``STRIPE``
    of them and there are more stripes. A task holds a stripe and a block. The number of distances is quadratic all the same.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(cluster_col).cast("int").alias("c"), F.col(vec_col).alias("v"))
    rows = rows if sample is None else uniform(rows, sample, seed, "id")
    held, blocks = _packed(rows, Scratch(vectors.sparkSession, "silhouette"))
    stripes = min(blocks, max(STRIPES, -(-blocks * BLOCK // STRIPE)))
    met = held.withColumn("s", F.pmod("b", F.lit(stripes))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    pair, side = F.least("s", "t") * stripes + F.greatest("s", "t"), (F.col("s") > F.col("t")).cast("int")
    met = met.select(pair.alias("pair"), side.alias("side"), "b", "labels", "vs").repartition(stripes * (stripes + 1) // 2, "pair").sortWithinPartitions("pair", "side")
    sums = met.mapInArrow(_distance_sums(stripes), SUMS).repartition("b").sortWithinPartitions("b")
    each = sums.mapInArrow(_scores, "total double, n long")
    return each.agg(F.coalesce(F.sum("total") / F.sum("n"), F.lit(-1.0)).alias("silhouette"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def sweep_k(vectors: DataFrame, ks: list[int], seed: int, runs: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SILHOUETTE_SAMPLE) -> DataFrame:
    """(k, silhouette, inertia) for every k below the number of rows. The vectors are held once for all fits, and the silhouette's sample is drawn once."""
    n = vectors.count()
    scratch = Scratch(vectors.sparkSession, "sweep")
    some = scratch.table(uniform(vectors.select(id_col, vec_col), sample, seed, id_col), "sample")
    data = vectors.select(array_to_vector(doubles(F.col(vec_col))).alias("features")).persist()
    out = []
    try:
        for k in ks:
            if k >= n:
                continue
            model = min((KMeans(k=k, seed=seed + i, featuresCol="features").fit(data) for i in range(runs)), key=lambda m: m.summary.trainingCost)
            score = silhouette(assign(some, model, vec_col), "cluster", id_col, vec_col, None).first()["silhouette"]
            out.append((k, float(score), float(model.summary.trainingCost)))
    finally:
        data.unpersist()
    return vectors.sparkSession.createDataFrame(out, "k int, silhouette double, inertia double")


def best_k(sweep: DataFrame) -> DataFrame:
    """The k of the greatest silhouette, the first listed of equals."""
    return sweep.orderBy(F.desc("silhouette"), "k").limit(1)


def sweep_flags(sweep: DataFrame) -> DataFrame:
    """One row: weak (no silhouette reaches the bound), and monotone (at least two, none above the one before)."""
    step = sweep.withColumn("before", F.lag("silhouette").over(Window.orderBy("k")))  # a dozen rows
    return step.agg((F.max("silhouette") < WEAK).alias("weak"), ((F.count("*") > 1) & F.coalesce(F.bool_and(F.col("silhouette") <= F.col("before")), F.lit(False))).alias("monotone"))


def label_clusters(prompts: DataFrame, complete: Callable[[Column], Column]) -> DataFrame:
    """(cluster_id, label, description, raw, cause): the parsed answer, that of one stricter retry, or a name that says so, with ``cause`` telling why the last answer could not be read.
    ``prompts``: cluster_id, prompt; ``complete`` is any column function of the prompt. A null answer is one that did not come."""
    why = lambda raw, p: F.when(raw.isNull(), F.lit("no answer")).otherwise(p["error"])
    rows = prompts.withColumn("raw1", complete(F.col("prompt"))).withColumn("p1", parse_label(F.col("raw1")))
    again = F.col("p1.label").isNull()
    rows = rows.withColumn("raw2", F.when(again, complete(F.concat(F.col("prompt"), F.lit(STRICT_SUFFIX))))).withColumn("p2", parse_label(F.col("raw2")))
    name = F.concat(F.lit(UNREADABLE), F.col("cluster_id").cast("string"))
    cause = F.when(again & F.col("p2.label").isNull(), why(F.col("raw2"), F.col("p2")))
    return rows.select(
        "cluster_id", F.coalesce("p1.label", "p2.label", name).alias("label"), F.coalesce("p1.description", "p2.description", F.lit("")).alias("description"), F.coalesce("raw2", "raw1").alias("raw"), cause.alias("cause")
    )


def label_warnings(labelled: DataFrame, ks: list[int], chosen: int) -> DataFrame:
    """(warning, detail): a k at the edge of the range, repeated labels, answers that could not be read."""
    repeated = labelled.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_label").alias("warning"), F.col("label").alias("detail"))
    failed = labelled.where(F.col("label").startswith(UNREADABLE)).select(F.lit("unreadable_answer").alias("warning"), F.concat_ws(": ", "label", "cause").alias("detail"))
    out = repeated.unionByName(failed)
    if chosen in (min(ks), max(ks)):
        out = out.unionByName(labelled.sparkSession.createDataFrame([("edge_of_range", str(chosen))], "warning string, detail string"))
    return out
