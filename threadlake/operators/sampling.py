"""Reproducible sampling: seeded uniform draws (W6, W9), pool guard (W8), two strata with round robin over buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import BUCKETS, matched_buckets
from threadlake.session import Scratch


def draw(seed: int, id_col: Column) -> Column:
    """A seed's order of the ids: uniform, and the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def uniform(rows: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """``n`` rows without replacement; a top-n over the hash order, merged map-side."""
    return rows.orderBy(draw(seed, F.col(id_col)), id_col).limit(n)


def round_robin(candidates: DataFrame, names: list[str], quota: int, id_col: str) -> DataFrame:
    """(id, bucket): the buckets in turn, each giving the first of its candidates that none has given yet, until ``quota`` are taken or none is left.

    ``candidates`` (id, bucket, rn): at most ``quota`` of each bucket in its order, which are enough for any outcome. One row holds them all, and a fold over the turns takes them.
    """
    kind = dict(candidates.dtypes)[id_col]
    empty = F.array().cast(f"array<{kind}>")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == n, F.struct("rn", F.col(id_col).alias("id"))))), lambda c: c["id"]) for n in names]
    held = candidates.agg(F.array(*[F.coalesce(x, empty) for x in lists]).alias("lists"))
    start = F.array().cast(f"array<struct<id:{kind},bucket:int>>")

    def turn(taken, t):
        bucket = F.pmod(t, F.lit(len(names)))
        free = F.get(F.filter(F.get("lists", bucket), lambda c: ~F.exists(taken, lambda x: x["id"] == c)), F.lit(0))
        more = F.array(F.struct(free.alias("id"), bucket.alias("bucket")))
        return F.when((F.size(taken) < quota) & free.isNotNull(), F.concat(taken, more)).otherwise(taken)

    turns = F.sequence(F.lit(0), F.lit(max(0, quota * len(names) - 1)))
    chosen = held.select(F.explode(F.aggregate(turns, start, turn)).alias("x"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("x.bucket"))
    return chosen.select(F.col("x.id").alias(id_col), name.alias("bucket"))


def two_strata(pool: DataFrame, n_a: int = 100, n_b: int = 100, seed: int = 20260909, id_col: str = "tweet_id", text_col: str = "text_scrubbed", patterns: dict[str, str] = BUCKETS) -> DataFrame:
    """``pool`` rows drawn, with ``stratum`` and ``sample_reason``.

    A is uniform. B goes round the pattern buckets over the rest and is topped up at random. No row passes through the driver. Raises ValueError when the pool is too small.
    """
    if pool.limit(n_a + n_b).count() < n_a + n_b:
        raise ValueError(f"the pool has fewer than {n_a + n_b} rows")
    scratch = Scratch(pool.sparkSession, "strata")
    a = scratch.table(uniform(pool, n_a, seed, id_col).select(id_col, F.lit("A").alias("stratum"), F.lit("uniform_random").alias("sample_reason")), "a")
    rest = pool.join(F.broadcast(a.select(id_col)), id_col, "left_anti")  # n_a rows
    order = draw(seed + 1, F.col(id_col))
    marked = rest.select(id_col, F.explode(matched_buckets(F.col(text_col), patterns)).alias("bucket"))
    best = marked.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(order, id_col))).where(F.col("rn") <= n_b)
    b = scratch.table(round_robin(best, list(patterns), n_b, id_col).select(id_col, F.lit("B").alias("stratum"), F.col("bucket").alias("sample_reason")), "b")
    missing = n_b - b.count()
    left = rest.select(id_col).join(F.broadcast(b.select(id_col)), id_col, "left_anti")  # n_b rows at most
    more = uniform(left, missing, seed + 2, id_col).select(id_col, F.lit("B").alias("stratum"), F.lit("random_topup").alias("sample_reason"))
    drawn = scratch.table(a.unionByName(b).unionByName(more), "drawn")
    return pool.join(F.broadcast(drawn), id_col)  # n_a + n_b rows


def counts_by_reason(sample: DataFrame) -> DataFrame:
    """A5: (stratum, sample_reason, n)."""
    return sample.groupBy("stratum", "sample_reason").agg(F.count("*").alias("n"))
