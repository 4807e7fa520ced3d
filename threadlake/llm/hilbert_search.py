"""Approximate nearest neighbours by shifted space-filling curves.

1. Equal vectors are one node: a vector that a third of all rows hold is looked for once, and its rows' ids are handed out at the end.
2. Each of several orderings projects the nodes by a random rotation of its own to a few places, scales these to even shares, shifts them by a random vector and takes the
   Hilbert key. Spark range-partitions and sorts the narrow (ordering, key, node) rows; a node's rank follows from the partitions' counts.
3. The half-width of the windows is measured: for a bounded sample of the queries the true neighbours are found by one scan, and the least width is taken at which the
   asked share of them lies in the query's window of some ordering. Vectors that lie in clusters need narrow windows; for vectors without any structure they grow until the share
   is met, up to the whole table.
4. Nodes go to blocks of each ordering, queries to all blocks that their window touches. A task streams a block's queries past its nodes, a matrix product at a
   time, and keeps the best of each; these are merged over blocks and orderings, scores taken anew from the original vectors.

For the largest inner product, vectors get one more place so that all have the same length (queries get 0 there), which turns it into nearness on a sphere.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import Scratch

ORDERINGS, PLACES = 8, 8
SHARE = 0.95  # of the sample's true neighbours that the windows have to hold
SAMPLE, FITTED = 256, 2048  # queries whose neighbours are found by a scan, and nodes that the scales of the projections are fitted on
SALTS = 16
LEAST_BLOCK, MOST_BLOCK = 256, 8192  # nodes of a block
ROWS_PER_TASK = 50_000  # narrow rows of a range partition
CURVE = "t int, key long, asks boolean, node long"
BEST = "asker long, nodes array<long>, reps array<long>, scores array<double>"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (a row of whole numbers below 2^bits) along the Hilbert curve, by Skilling's transposed form; bits times places is below 64."""
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):  # undo the rotations of each level, from the coarsest
        top, low = np.int64(1) << b, (np.int64(1) << b) - 1
        for i in range(len(x)):
            flip = (x[i] & top) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, (np.int64(1) << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


class Curves:
    """The orderings: rotations, scales and shifts, from a seed and a sample of vectors."""

    def __init__(self, sample: np.ndarray, longest: float, orderings: int, places: int, seed: int):
        self.longest, self.bits = longest, 62 // places
        rng = np.random.default_rng(seed)
        size = sample.shape[1] + 1
        self.turns = [np.linalg.qr(rng.normal(size=(size, min(places, size))))[0] for _ in range(orderings)]
        self.shifts = rng.random((orderings, min(places, size)))
        seen = [self.raised(sample) @ turn for turn in self.turns]
        self.means, self.widths = [y.mean(0) for y in seen], [np.maximum(y.std(0), 1e-12) for y in seen]

    def raised(self, x: np.ndarray) -> np.ndarray:
        """One more place, so that every vector has the length 1."""
        x = x / self.longest
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]), axis=1)

    @staticmethod
    def asked(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))), axis=1)

    def keys(self, t: int, raised: np.ndarray) -> np.ndarray:
        even = 1 / (1 + np.exp(-1.702 * np.clip((raised @ self.turns[t] - self.means[t]) / self.widths[t], -20, 20)))  # close to the normal distribution's shares
        return hilbert_keys(((even + self.shifts[t]) / 2 * (2**self.bits - 1)).astype(np.int64), self.bits)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, h1, h2): rows with an id whose vector is neither null nor all zero, and holds no null, NaN or infinite component; of the length that most such rows have (of two, the lesser)."""
    v = F.col(vec_col)
    x = v.cast("array<double>")
    fits = v.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    kept = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fits, F.lit(False)))
    size = kept.groupBy(F.size(vec_col).alias("s")).count().orderBy(F.desc("count"), "s").first()
    kept = kept.where(F.size(vec_col) == (size["s"] if size else 0))
    return kept.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))


def as_nodes(rows: DataFrame, asked: str, k: int) -> DataFrame:
    """(node, h1, h2, rep, ids, asks, v): a row per distinct vector, with the k + 1 least ids that hold it, as no query needs more of one vector."""
    held = rows.groupBy("h1", "h2", "id").agg(F.first(F.expr(asked)).alias("asks"))
    asks = held.groupBy("h1", "h2").agg(F.bool_or("asks").alias("asks"), F.min("id").alias("rep"))
    few = held.withColumn("rn", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("rn") <= k + 1)
    ids = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    return one.join(asks, ["h1", "h2"]).join(ids, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "rep", "ids", "asks", "v")


def _curves(curves: Curves):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, asks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            x = matrix(batch.column(2), batch.num_rows)
            raised, asked = curves.raised(x), curves.asked(x[asks])
            for t in range(len(curves.turns)):
                for rows, name, q in ((raised, node, False), (asked, node[asks], True)):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t), pa.int32()), pa.array(curves.keys(t, rows)), pa.array(np.full(n, q)), pa.array(name, pa.int64())], ["t", "key", "asks", "node"])

    return run


def _scan(ids: np.ndarray, q: np.ndarray, k: int):
    """Each task's best k nodes of every sampled query, themselves left out."""

    def run(batches):
        scores, names = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy(zero_copy_only=False)
                s = q @ matrix(batch.column(1), batch.num_rows).T
                s[ids[:, None] == node[None, :]] = -np.inf
                scores, names = np.concatenate((scores, s), axis=1), np.concatenate((names, np.broadcast_to(node, s.shape)), axis=1)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                scores, names = np.take_along_axis(scores, best, 1), np.take_along_axis(names, best, 1)
        ok = np.isfinite(scores)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, scores.shape[1])[ok.ravel()]), pa.array(names[ok]), pa.array(scores[ok])], ["asker", "node", "score"])

    return run


def true_neighbours(nodes: DataFrame, sample: list, k: int) -> DataFrame:
    """(asker, node, score): the k nearest nodes of each sampled one, by a scan."""
    ids, q = np.array([r["node"] for r in sample], np.int64), np.array([r["v"] for r in sample], np.float64)
    each = nodes.select("node", "v").mapInArrow(_scan(ids, q, k), "asker long, node long, score double")
    return each.withColumn("rn", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "node"))).where(F.col("rn") <= k).drop("rn")


def half_width(ranked: DataFrame, pairs: list[tuple[int, int]], share: float, least: int) -> int:
    """The least half-width at which ``share`` of the pairs (asker, node) lie in a window of some ordering. As many rows come back as the sample has pairs, for each ordering."""
    if not pairs:
        return least
    spark = ranked.sparkSession
    wanted = spark.createDataFrame([(a, True) for a in {a for a, _ in pairs}] + [(b, False) for b in {b for _, b in pairs}], "node long, asks boolean")
    at = {(r["t"], r["asks"], r["node"]): r["rank"] for r in ranked.join(F.broadcast(wanted), ["node", "asks"]).collect()}
    ts = {t for t, _, _ in at}
    off = sorted(min(abs(at[t, True, a] - at[t, False, b]) for t in ts) for a, b in pairs)
    return max(least, off[min(len(off) - 1, int(np.ceil(share * len(off))) - 1)])


def with_ranks(scratch: Scratch, curve: DataFrame, rows: int) -> DataFrame:
    """(t, asks, node, rank): each row's place in its ordering. Ties of the key, which may be many, are dealt out by a hash."""
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    order = ["t", "key", "tie", "asks"]
    spread = curve.withColumn("tie", F.xxhash64("node")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = scratch.table(spread.select("t", "asks", "node", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "curve")
    counts = placed.groupBy("t", "part").agg(F.count("*").alias("n"), F.min("pos").alias("first")).collect()  # a row per task, and one more per ordering
    starts = []
    for t, of_t in groupby(sorted(counts, key=lambda r: (r["t"], r["part"])), key=lambda r: r["t"]):
        before = 0
        for r in of_t:
            starts.append((t, r["part"], before - r["first"]))
            before += r["n"]
    offsets = F.broadcast(scratch.spark.createDataFrame(starts, "t int, part int, off long"))
    return placed.join(offsets, ["t", "part"]).select("t", "asks", "node", (F.col("pos") + F.col("off")).alias("rank"))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in extended precision, so that the same pair has the same score everywhere."""
    return (q * x).sum(-1, dtype=np.longdouble).astype(np.float64)


def best_of_block(q: np.ndarray, x: np.ndarray, node: np.ndarray, rep: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, reps, scores) of the k best rows of ``x`` for each query; equal scores by the lesser rep."""
    rough = q @ x.T
    n = min(k, rough.shape[1])
    edge = np.partition(rough, -n, axis=1)[:, -n]
    out = []
    for i, near in enumerate(rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]):  # all that may be among the best once summed exactly
        some = np.flatnonzero(near)
        score = _exact(q[i], x[some])
        best = np.lexsort((rep[some], -score))[:n]
        out.append((node[some][best], rep[some][best], score[best]))
    return out


def _rerank(k: int):
    """The rows come sorted by block, its nodes before its queries; a block's nodes are held, its queries stream past."""

    def run(batches):
        held_key, xs, nodes, reps, x = None, [], [], [], None
        for batch in batches:
            t, block, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(t):
                continue
            node, rep, v = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False), matrix(batch.column(5), batch.num_rows)
            edge = np.flatnonzero((t[1:] != t[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            found = []
            for lo, hi in zip([0, *edge], [*edge, len(t)], strict=True):
                key = (t[lo], block[lo])
                if key != held_key:
                    held_key, xs, nodes, reps, x = key, [], [], [], None
                if not asks[lo]:
                    xs.append(v[lo:hi])
                    nodes.append(node[lo:hi])
                    reps.append(rep[lo:hi])
                    continue
                if x is None and xs:
                    x, own, least = np.concatenate(xs), np.concatenate(nodes), np.concatenate(reps)
                    xs = []
                if x is not None:
                    for at in range(lo, hi, 512):
                        some = slice(at, min(at + 512, hi))
                        found += zip(node[some].tolist(), best_of_block(v[some], x, own, least, k), strict=True)
            cols = [pa.array([a for a, _ in found], pa.int64()), pa.array([b[0] for _, b in found], pa.list_(pa.int64())), pa.array([b[1] for _, b in found], pa.list_(pa.int64())), pa.array([b[2] for _, b in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["asker", "nodes", "reps", "scores"])

    return run


def nearest(vectors: DataFrame, asked: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", orderings: int = ORDERINGS, places: int = PLACES, share: float = SHARE, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of the rows for which the SQL condition ``asked`` on ``id`` holds, the k rows with the largest inner product found, all other ids'
    rows being candidates; fewer where there are no more. Equal scores go by the lesser id.

    Rows with a null id, and vectors that are null, all zero, of another length than most, or hold a null, NaN or infinite component, take no part; other columns
    are left out, whatever their names. Equal vectors are told apart by their ids alone. An id that repeats is one query and one candidate: of the pairs of its
    vectors the best counts. An empty table, or one without a query, gives an empty result.

    ``share`` is held on ``sample`` queries, drawn by a hash; all rows are indexed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hilbert")
    rows = usable(vectors, id_col, vec_col)
    nodes = scratch.table(as_nodes(rows, asked, k), "nodes")
    facts = nodes.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max(F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, e: s + e * e))).alias("longest")).first()
    if not facts["asks"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = lambda df, n: df.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n).select("node", "v").collect()
    curves = Curves(np.array([r["v"] for r in drawn(nodes, FITTED)], np.float64), facts["longest"], orderings, places, seed)
    ranked = with_ranks(scratch, nodes.select("node", "asks", "v").mapInArrow(_curves(curves), CURVE), orderings * (facts["n"] + facts["asks"]))
    pairs = [(r["asker"], r["node"]) for r in true_neighbours(nodes, drawn(nodes.where("asks"), sample), k).collect()]  # at most sample * k
    width = half_width(ranked, pairs, share, k + 1)

    # the blocks of each node, and those that a query's window touches
    size = min(max(width, LEAST_BLOCK), MOST_BLOCK)
    block = lambda rank: F.floor(rank / size).cast("long")
    last = F.when(F.col("asks"), block(F.col("rank") + width)).otherwise(block(F.col("rank")))
    first = F.when(F.col("asks"), block(F.greatest(F.col("rank") - width, F.lit(0)))).otherwise(block(F.col("rank")))
    spots = ranked.select("node", F.struct("t", "asks", first.alias("lo"), last.alias("hi")).alias("s")).groupBy("node").agg(F.collect_list("s").alias("spots"))  # two an ordering
    moved = nodes.select("node", "rep", "v").join(spots, "node").select("node", "rep", "v", F.explode("spots").alias("s"))
    moved = moved.select("s.t", F.explode(F.sequence("s.lo", "s.hi")).alias("block"), "s.asks", "node", "rep", "v")
    dealt = moved.repartition("t", "block").sortWithinPartitions("t", "block", "asks")
    found = scratch.table(dealt.mapInArrow(_rerank(k + 1), BEST), "found")

    each = found.select("asker", F.explode(F.arrays_zip("nodes", "reps", "scores")).alias("x")).select("asker", F.col("x.nodes").alias("node"), F.col("x.reps").alias("rep"), F.col("x.scores").alias("score"))
    once = each.groupBy("asker", "node").agg(F.max("score").alias("score"), F.first("rep").alias("rep"))
    top = lambda by: F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), by))
    near = once.withColumn("rn", top("rep")).where(F.col("rn") <= k + 1)
    near = near.join(nodes.select("node", "ids"), "node").select("asker", "score", F.explode("ids").alias("vec_id"))
    near = near.groupBy("asker", "vec_id").agg(F.max("score").alias("score"))  # an id may have several vectors
    near = near.withColumn("rn", top("vec_id")).where(F.col("rn") <= k + 1)
    lists = near.groupBy("asker").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))
    lists = nodes.select(F.col("node").alias("asker"), "h1", "h2").join(lists, "asker")

    # many queries may have one vector: both sides are salted
    lists = lists.select("h1", "h2", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    askers = rows.where(asked).select(F.col("id").alias("query_id"), "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = askers.join(lists.hint("merge"), ["h1", "h2", "salt"]).select("query_id", F.explode("near").alias("x")).where("x.vec_id <> query_id")
    out = out.groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg(F.max("x.score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
