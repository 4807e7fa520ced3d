"""Distributed selection against sorted values, with brackets small enough to take several rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.operators import selection, threads


def interpolated(values, share):
    v = sorted(values)
    at = share * (len(v) - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    return float(v[lo]) if v[lo] == v[hi] else (hi - at) * v[lo] + (at - lo) * v[hi]


@pytest.mark.parametrize("kind", ["even", "hot", "two", "one", "skewed"])
def test_equals_sorted_values(spark, kind):
    rng = np.random.default_rng(1)
    v = {
        "even": rng.integers(0, 10**15, 20_000), "hot": np.where(rng.random(20_000) < 0.4, 5 * 10**14, rng.integers(0, 10**15, 20_000)),
        "two": rng.integers(0, 2, 20_000), "one": np.full(500, 7), "skewed": (rng.pareto(0.5, 20_000) * 1000).clip(0, 1e17).astype(np.int64),
    }[kind]
    df = spark.createDataFrame([(int(x),) for x in v] + [(None,)], "v long").repartition(5).persist()
    for share in (0.0, 0.25, 0.39, 0.41, 0.7, 0.99999, 1.0):
        assert selection.exact_quantile(df, "v", share, last=200).first()["cut"] == interpolated(v, share)
        assert selection.exact_quantile(df, "v", share).first()["cut"] == interpolated(v, share)


def test_bracket_is_small(spark):
    df = spark.range(300_000).select((F.col("id") * 7919 % 1_000_003).alias("v"))
    low, high, below = selection.bracket(df, "v", (210_000, 210_001), 300_000, last=500)
    assert df.where(F.col("v") < low).count() == below <= 210_000
    assert df.where(F.col("v").between(low, high)).count() <= 500


def test_no_task_aggregates_all_values(spark):
    rows = spark.range(1000).select("id", F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    cut = threads.split_instant(rows, 0.7, "ts")
    assert "percentile" not in cut._jdf.queryExecution().toString()
    assert threads.assign_time_split(rows, 0.7, "ts").where("in_training_window").count() == 700
    assert threads.split_instant(rows.limit(0), 0.7, "ts").first()["cut"] is None
