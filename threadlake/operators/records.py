"""Append-only logs: latest record per key (A8), override join (J5), progress (A9), open tasks (P9), cache lookups (J8, S12), call counts (A4), quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key; last means the greatest ``seq``. Aggregates map-side, so a hot key costs one row per task."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_r")).select(key, "_r.*")


def is_labelled():
    return F.col("label_intent").isNotNull() & F.col("label_action").isNotNull()


def override(sample: DataFrame, labels: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Sample rows, replaced whole where a label record has their key: a null in the record wins."""
    cols = [c for c in sample.columns if c != key]
    other = labels.select(key, F.struct(*cols).alias("_l"))
    out = sample.join(other, key, "left")
    return out.select(key, *[F.when(F.col("_l").isNotNull(), F.col("_l")[c]).otherwise(F.col(c)).alias(c) for c in cols])


def unlabelled(sample: DataFrame, labels: DataFrame, key: str = "tweet_id") -> DataFrame:
    return sample.join(labels.where(is_labelled()), key, "left_anti")


def progress(sample: DataFrame, labels: DataFrame, key: str = "tweet_id") -> DataFrame:
    done = labels.where(is_labelled()).select(key, F.lit(True).alias("_done")).distinct()
    return sample.join(done, key, "left").agg(F.count_if(F.coalesce("_done", F.lit(False))).alias("done"), F.count("*").alias("total"))


def cache_lookup(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """The first cached answer of each call in the order of its chain, disabled providers skipped. ``calls``: call_id, chain array<struct<provider, model, enabled, key>>."""
    tries = calls.select("call_id", F.posexplode("chain").alias("pos", "c")).where("c.enabled").select("call_id", "pos", F.col("c.key").alias("key"))
    hits = tries.join(cache.select("key", "provider", "model", "text"), "key")
    rank = Window.partitionBy("call_id").orderBy("pos")
    return hits.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1").drop("_rn", "key")


def cache_misses(calls: DataFrame, cache: DataFrame) -> DataFrame:
    return calls.join(cache_lookup(calls, cache), "call_id", "left_anti")


def calls_by_model(cache: DataFrame) -> DataFrame:
    return cache.groupBy(F.concat_ws("/", "provider", "model").alias("model")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model")


def per_stratum(scored: DataFrame) -> DataFrame:
    """Accuracy of ``predicted`` against ``label_intent`` per stratum; strata are never pooled."""
    return scored.where("label_intent is not null").groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("label_intent")).cast("double")), 6).alias("accuracy"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labellings of the same rows."""
    n = pairs.count()
    agree = pairs.where(F.col(a) == F.col(b)).count()
    left = pairs.groupBy(F.col(a).alias("label")).agg(F.count("*").alias("x"))
    right = pairs.groupBy(F.col(b).alias("label")).agg(F.count("*").alias("y"))
    chance = left.join(right, "label").agg((F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)) / F.lit(float(max(1, n)) ** 2)).alias("pe"))
    po = agree / max(1, n)
    return chance.select(F.lit(n).cast("long").alias("n"), F.round(F.when(F.col("pe") == 1, 1.0).otherwise((po - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))
