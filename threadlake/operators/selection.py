"""Exact quantiles by distributed selection (A2): no task ever holds all values.

The wanted ranks are bracketed by approximate percentiles, the rows below the bracket are counted, and the same is done within the bracket, until it is small. Only the last
bracket is sorted. A bracket shrinks to about a 5000th a round, so that a trillion rows take three.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAST = 100_000  # distinct values of the bracket that one task sorts at most
ACCURACY = 10_000  # approximate percentiles are off by at most a row in so many


def bracket(values: DataFrame, col: str, ranks: tuple[int, int], n: int, last: int = LAST) -> tuple[int, int, int]:
    """(low, high, rows below low): a range of values that holds the rows of both ranks, counted from 0, and at most ``last`` distinct values. ``col``: longs without nulls."""
    v, below, inside = F.col(col), 0, n
    ends = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.approx_count_distinct(v).alias("d")).first()
    low, high, kinds = ends["lo"], ends["hi"], ends["d"]
    while low < high and inside > last and kinds > last // 2:
        held = values.where(v.between(low, high))
        share = [(ranks[0] - below) / inside - 1 / ACCURACY, (ranks[1] - below + 1) / inside + 1 / ACCURACY]
        lo, hi = held.agg(F.approx_percentile(v, [min(1.0, max(0.0, s)) for s in share], ACCURACY).alias("p")).first()["p"]
        c = held.agg(F.count_if(v < lo).alias("under"), F.count_if(v.between(lo, hi)).alias("within"), F.approx_count_distinct(F.when(v.between(lo, hi), v)).alias("d")).first()
        under, within = below + c["under"], c["within"]
        if ranks[0] < under:  # the estimate was too high or too low: that side stays as it was
            lo, within, under = low, within + c["under"], below
        if ranks[1] >= under + within:
            within, hi = inside - (under - below), high
        if (lo, hi) == (low, high):
            break
        low, high, below, inside, kinds = lo, hi, under, within, c["d"]
    return low, high, below


def exact_quantile(values: DataFrame, col: str, share: float, last: int = LAST) -> DataFrame:
    """One row (cut double): the linearly interpolated quantile of a column of longs, nulls left out; null where there is none. Equal to ``percentile``, but in several jobs of
    bounded memory: extrema, then two scans a round, then the values of the last bracket, counted map-side."""
    values = values.select(F.col(col).cast("long").alias("v")).where("v IS NOT NULL")
    n = values.count()
    if not n:
        return values.sparkSession.createDataFrame([(None,)], "cut double")
    at = share * (n - 1)
    ranks = math.floor(at), math.ceil(at)
    low, high, below = bracket(values, "v", ranks, n, last)
    counts = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v")) + F.lit(below))  # the last bracket
    pick = [F.min(F.when(F.col("upto") > r, F.col("v"))).cast("double") for r in ranks]
    two = upto.agg(pick[0].alias("a"), pick[1].alias("b"))
    between = (F.lit(float(ranks[1])) - F.lit(at)) * F.col("a") + (F.lit(at) - F.lit(float(ranks[0]))) * F.col("b")
    return two.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("cut"))
