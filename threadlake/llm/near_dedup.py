"""MinHash near-duplicate grouping by SuperMinHash signatures.

1. Every text becomes its set of five-word shingles, a SuperMinHash signature and band keys (one scan, map-side).
2. Equal sets are grouped first, so that copies cost one row each and never meet as pairs. Each distinct set is a node of its own.
3. In each bucket of equal band keys the least node is the centre; each other member is checked against it on whole
   sets, and union-find (distributed star contraction) groups the confirmed links.
4. A bucket whose members are then still in different groups may hold links that missed its centre. First each block of such a bucket
   compares its own members (work in proportion to the bucket) and the groups are joined again; then, in buckets of several blocks,
   the members outside the bucket's largest group are compared with all others. In either step each member first puts forward its best pair in one of its buckets only
   (as in Borůvka's spanning trees), so that most groups are one before all pairs that still cross groups, in all buckets, are. Whole signatures are compared, and what may reach the threshold
   (within five standard deviations of SuperMinHash, so less than one in a million true links is lost) is checked on whole sets as well.

Nothing is capped: a bucket of any size is dealt with in blocks of bounded size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.shingles import SuperMinHash, U, at_least, band_keys, set_key, shingle_set
from threadlake.operators.graph import connected_components
from threadlake.session import Scratch

ROWS = 7  # places of a band
MISS = 1e-6  # chance that a pair at the threshold shares no band
BLOCK = 1024  # members of a bucket that one task compares with as many others
SALTS = 16
BEST_ROUNDS = 2  # in which each member puts forward one pair of one bucket only, which mostly joins its group to others before all pairs are looked at
BROADCAST_IDS = 500_000  # rows of three numbers sent to all executors at most (12 MB); more are joined by a shuffle
SKETCH = "doc_id long, n_shingles long, set_key binary, text_key long, bands array<long>, sig binary"


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


@lru_cache(maxsize=4096)
def variance_factor(m: int, u: int) -> float:
    """The variance of SuperMinHash over that of MinHash for unions of u elements (Ertl 2017, theorem 1)."""
    if u < 2:
        return 0.0
    l = np.arange(1, m, dtype=float)
    # sum of l^u ((l+1)^u + (l-1)^u - 2 l^u), over (m-1)^(u-1) m^u (u-1), in logarithms
    scale = u * np.log(m) + (u - 1) * np.log(m - 1)
    with np.errstate(divide="ignore"):
        part = np.exp(u * np.log(l) + u * np.log(l + 1) - scale) + np.exp(u * np.log(l) + u * np.log(l - 1) - scale) - 2 * np.exp(2 * u * np.log(l) - scale)
    return float(min(1.0, max(0.0, 1 - part.sum() / (u - 1))))


def agreement_floor(m: int, n: int, percent: int) -> int:
    """Places on which a pair at the threshold agrees at least, five standard deviations below the mean; n: the larger set's size."""
    j = percent / 100
    u = int(2 ** math.ceil(math.log2(max(2, n / j))))  # rounded up, to the larger variance
    return max(0, math.floor(m * (j - 5 * math.sqrt(j * (1 - j) / m * variance_factor(m, u)))) - 1)


def _sketcher(percent: int, k: int):
    bands = bands_for(percent)
    places = bands * ROWS

    def run(batches):
        hasher = SuperMinHash(places)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 128):
                some = ids[at : at + 128]
                raw = texts[at : at + 128].to_pylist()
                sets = [shingle_set(t, k) for t in raw]
                full = [s for s in sets if len(s)]
                sig = hasher.signatures(full)
                keys, low = band_keys(sig, bands).view(np.int64), (sig & U(255)).astype(np.uint8)
                row = iter(range(len(full)))
                which = [next(row) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        batch.column(2)[at : at + 128],
                        pa.array([None if w is None else keys[w] for w in which], pa.list_(pa.int64())),
                        pa.array([None if w is None else low[w].tobytes() for w in which], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "text_key", "bands", "sig"],
                )

    return run


def _pack(batches):
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "z"])


def _verifier(percent: int, k: int):
    def run(batches):
        z = zstandard.ZstdDecompressor()

        @lru_cache(maxsize=16)
        def sets(packed: bytes) -> np.ndarray:
            return shingle_set(z.decompress(packed).decode("utf-8", "surrogatepass"), k)

        for batch in batches:
            a, b, za, zb = (batch.column(i) for i in range(4))
            ok = [at_least(sets(x), sets(y), percent) for x, y in zip(za.to_pylist(), zb.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(edges: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The edges whose whole sets reach the threshold."""
    right = texts.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    left = texts.select(F.col("id").alias("a"), F.col("z").alias("za"))
    return edges.join(right, "b").join(left, "a").select("a", "b", "za", "zb").mapInArrow(_verifier(percent, k), "a long, b long")


def _comparer(percent: int, best: bool = False):
    """Pairs of a block, of different groups, whose signatures may reach the threshold. ``members`` are compared with each other, or, where
    some have ``left``, those with all others. ``best``: of each member's pairs only the one that agrees most."""

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for row in batch.to_pylist():
                part = row["members"]
                ids = np.array([m["id"] for m in part], np.int64)
                group = np.array([m["component"] for m in part], np.int64)
                size = np.array([m["n"] for m in part], np.int64)
                bands = None if best else np.array([m["bands"] for m in part], np.int32)
                left = np.array([m.get("left") for m in part], bool)
                sig = np.frombuffer(b"".join(m["sig"] for m in part), np.uint8).reshape(len(part), -1)
                floor = np.array([agreement_floor(sig.shape[1], int(2 ** math.ceil(math.log2(max(1, n)))), percent) for n in size])
                for x in np.flatnonzero(left) if left.any() else range(len(part)):
                    y = np.flatnonzero((group != group[x]) & (best | (~(left & (ids <= ids[x])) & (left[x] | (ids > ids[x])))))
                    y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
                    agree = (sig[y] == sig[x]).sum(axis=1)
                    some = agree >= np.minimum(floor[y], floor[x])
                    if not best:  # a pair that meets in several bands is told of in the first, by 32 bits of the keys that make buckets (a false match: 1 in 10^8)
                        some &= (bands[y] == bands[x]).argmax(axis=1) == row["band"]
                    y, agree = y[some], agree[some]
                    y = y[[agree.argmax()]] if best and len(y) else y
                    out_a += np.minimum(ids[y], ids[x]).tolist()
                    out_b += np.maximum(ids[y], ids[x]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _blocks(of: str):
    """How many blocks of at most ``BLOCK`` members on average a column's number of members makes, and a member's own."""
    count = F.ceil(F.col(of) / BLOCK).cast("long")
    return count, F.pmod(F.xxhash64("id", F.lit(of)), count)


def _with_groups(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of the buckets that hold several groups, with their group."""
    now = members.where("size > 2").join(groups, "id", "left").select("key", "band", "id", "size", F.coalesce("component", "id").alias("component"))
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return now.join(mixed, "key", "left_semi")


def _one_bucket(members: DataFrame, nth: int) -> DataFrame:
    """Each member in one of its buckets: first the largest, then one drawn by hashes of the keys, so that members which share most buckets mostly draw the same."""
    order = F.struct("size", "key", "band") if nth == 0 else F.struct(F.xxhash64("key", F.lit(nth)).alias("draw"), "size", "key", "band")
    return members.groupBy("id").agg(F.max(order).alias("b"), F.min("component").alias("component")).select("b.key", "b.band", "id", "b.size", "component")


def _item(best: bool, left: bool):
    """What a task needs of a member; best pairs need no bands."""
    return F.struct("id", "component", "n", *([] if best else ["bands"]), "sig", F.lit(left).alias("left"))


def _within_blocks(members: DataFrame, reps: DataFrame, best: bool) -> DataFrame:
    """One row per block of each bucket, each member in one."""
    full = members.join(reps, "id").withColumn("i", _blocks("size")[1])
    return full.groupBy("key", "band", "i").agg(F.collect_list(_item(best, False)).alias("members")).select("key", "band", "members")


def _across_blocks(members: DataFrame, reps: DataFrame, best: bool, scratch: Scratch) -> DataFrame:
    """One row per block of the members outside a bucket's largest group and block of all its members, for buckets of several blocks.
    The work grows with those outside times the bucket, not with its square."""
    some = scratch.table(members, "several")
    sizes = some.groupBy("key", "component").agg(F.count("*").alias("c"))
    most = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
    full = some.join(most, "key").join(reps, "id")
    (n_left, own_left), (n_all, own_all) = _blocks("outside"), _blocks("size")
    out = full.withColumn("is_left", F.col("component") != F.col("largest"))
    lefts = out.where("is_left").select("key", "band", own_left.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), n_all - 1)).alias("j"), _item(best, True).alias("m"))
    # a left member of the same block pair is dealt once: as a left one
    rest = out.select("key", "band", F.explode(F.sequence(F.lit(0).cast("long"), n_left - 1)).alias("i"), own_all.alias("j"), F.when(F.col("is_left"), own_left).alias("own"), _item(best, False).alias("m")).where("own IS NULL OR own <> i").drop("own")
    return lefts.unionByName(rest).groupBy("key", "band", "i", "j").agg(F.collect_list("m").alias("members")).select("key", "band", "members")


def _joined(groups: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """The groups after further links. The links are taken between groups, so that what is contracted is as small as what is new."""
    of = lambda end: groups.select(F.col("id").alias(end), F.col("component").alias(f"{end}_group"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
    over = scratch.table(connected_components(ends, "a", "b", scratch), "over").select(F.col("id").alias("component"), F.col("component").alias("least"))
    fresh = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id"))).distinct().join(groups.select("id"), "id", "left_anti")
    every = groups.unionByName(fresh.select("id", F.col("id").alias("component")))
    return every.join(over, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``, which may have any other columns.

    Texts link where the Jaccard similarity of their k-word shingle sets is at least ``percent`` / 100; a component is what
    links reach, named by its least id; ``kept`` marks the row that names it. A null or empty text has no shingles and links
    with nothing. A text of fewer than k words is one shingle. A row with a null id has the component null and is kept. Rows
    that repeat an id are told apart by their sets: each row gets its own set's group. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))  # tells texts under one id apart
    sketch = scratch.table(rows.mapInArrow(_sketcher(percent, k), SKETCH), "sketch")

    some = sketch.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    own = scratch.table(some.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "sets")
    firsts = some.join(own.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
    # a node per distinct set: ids do not serve, as one may have several sets. Numbered in the written table, so that they stay
    nodes = scratch.table(firsts.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").alias("rep"), "set_key", "text_key", "n_shingles", "bands", "sig"), "nodes")
    marks = F.transform("bands", lambda key: (key.bitwiseAND(F.lit(2**32 - 1)) - F.lit(2**31)).cast("int"))
    reps = nodes.select("id", F.col("n_shingles").alias("n"), marks.alias("bands"), "sig")

    # buckets: band number and key in one; sizes are counted map-side, and a key that many nodes share is split by adaptive execution in the join
    member = nodes.select("id", F.posexplode("bands").alias("band", "key")).select("id", "band", F.xxhash64("band", "key").alias("key"))
    size = member.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = scratch.table(member.join(size, "key").select("key", "band", "id", "centre", "size"), "members")
    edges = scratch.table(members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "edges")

    wanted = scratch.table(nodes.join(members.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("node"), F.col("rep").alias("id"), "text_key"), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    wanted = F.broadcast(wanted) if few else wanted
    kept_texts = rows.join(wanted, ["id", "text_key"]).select(F.col("node").alias("id"), "text").mapInArrow(_pack, "id long, z binary")
    texts = scratch.table(kept_texts, "texts", "none")
    if texts.groupBy("id").count().where("count > 1").limit(1).count():  # rows that repeat id and text
        texts = scratch.table(texts.groupBy("id").agg(F.min("z").alias("z")), "texts-once", "none")

    links = scratch.table(_verify(edges, texts, percent, k), "links")
    groups = scratch.table(connected_components(links, "a", "b", scratch), "groups")
    told, pool = edges, members
    rounds = [(across, nth) for across in (False, True) for nth in (*range(BEST_ROUNDS), None)]
    for n, (across, nth) in enumerate(rounds):
        # a bucket of one group stays so: each round looks at what the one before left open
        open_ = scratch.table(_with_groups(pool.where(F.col("size") > BLOCK) if across else pool, groups), f"open-{n}")
        if open_.isEmpty():
            break
        pool, best = open_.drop("component"), nth is not None
        ask = _one_bucket(open_, nth) if best else open_
        dealt = _across_blocks(ask, reps, best, scratch) if across else _within_blocks(ask, reps, best)
        maybe = scratch.table(dealt.mapInArrow(_comparer(percent, best), "a long, b long").distinct().join(told, ["a", "b"], "left_anti"), f"maybe-{n}")
        more = scratch.table(_verify(maybe, texts, percent, k), f"more-{n}")
        told = told.unionByName(maybe)
        if not more.isEmpty():
            groups = scratch.table(_joined(groups, more, scratch), f"groups-{n}")
    placed = nodes.select("id", "set_key", "rep").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.table(placed.join(least, "component").select("set_key", "component_id"), "named")

    # copies of one set may be a third of all rows: salted
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    spread = some.select("set_key", salt.alias("salt")).distinct()
    named = spread.join(named, "set_key")
    out = sketch.withColumn("salt", salt).join(named, ["set_key", "salt"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns as they were. Rows with a null id stay, and an id
    that rows repeat goes only where none of its rows is kept. Null and empty texts stay; an empty table gives an empty result."""
    found = near_duplicates(docs, id_col, **options)
    gone = found.groupBy(F.col("doc_id").alias(id_col)).agg(F.bool_or("kept").alias("kept")).where("not kept").select(id_col)
    return docs.join(gone, id_col, "left_anti")
