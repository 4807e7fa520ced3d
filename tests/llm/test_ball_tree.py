"""Ball-tree clustering against plain exact rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import ball_tree, registry

SIZE = 4


def plain(rows, k, rounds, size=SIZE):
    """The contract's rounds, row by row."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [list(v) for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min(range(len(cs)), key=lambda c: (dist(v, cs[c]), c))
    for _ in range(rounds):
        at = [place(v) for _, v in kept]
        for c in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if own:
                cs[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted(((i, place(v), dist(v, cs[place(v)])) for i, v in kept), key=str), cs


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")


@pytest.mark.parametrize("shape", ["even", "clustered", "copies"])
def test_equals_plain_rounds(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, SIZE))
    if shape == "clustered":
        x = x * 0.05 + rng.normal(size=(6, SIZE))[rng.integers(0, 6, 700)] * 3
    if shape == "copies":
        x[:300] = x[0]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    placed, cs = ball_tree.cluster(frame(spark, rows).repartition(3), 5, 3, size=SIZE)
    want, centroids = plain(rows, 5, 3)
    assert sorted(map(tuple, placed.collect()), key=str) == want
    assert cs == centroids


def test_odd_rows(spark):
    rows = [(1, None), (2, [1.0, None, 0.0, 0.0]), (3, [float("nan"), 0.0, 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0, 0.0]), (5, [1.0]), (6, []), (None, [0.5, 0.5, 0.5, 0.5])]
    rows += [(7, [1.0, 2.0, 3.0, 4.0])] * 3 + [(7, [-1.0, -2.0, -3.0, -4.0]), (8, [0.1, 0.2, -0.3, -0.0])]
    placed, cs = ball_tree.cluster(frame(spark, rows), 5, 3, size=SIZE)
    want, centroids = plain(rows, 5, 3)
    assert sorted(map(tuple, placed.collect()), key=str) == want
    assert cs == centroids
    out = ball_tree.report(placed, cs)
    assert out.count() == 6
    assert out.agg(F.max("inertia")).first()[0] == sum(d for _, _, d in want)


def test_empty_table_and_large_numbers(spark):
    placed, cs = ball_tree.cluster(frame(spark, [(1, None)]), size=SIZE)
    assert placed.count() == 0 and cs == [] and ball_tree.report(placed, cs).count() == 0
    rows = [(1, [2e6, -2e6, 2e6, -2e6]), (2, [-2e6, 2e6, -2e6, 2e6]), (3, [0.0, 0.0, 0.0, 1.0])]
    placed, cs = ball_tree.cluster(frame(spark, rows), 2, 1, size=SIZE)
    assert sorted(map(tuple, placed.collect()), key=str) == plain(rows, 2, 1)[0]
    with pytest.raises(Exception, match="fit a long"):
        ball_tree.cluster(frame(spark, [(1, [1e30, 0.0, 0.0, 0.0])]), size=SIZE)


def test_whole_balls_are_assigned_without_their_rows():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0, 0], [6400, 0, 0, 0], [0, 6400, 0, 0]])
    x = (centres[rng.integers(0, 3, 2000)] + rng.integers(-64, 64, (2000, 4))).astype(np.int64)
    _, starts, pivots, radii, sums = ball_tree.build(x)
    owner, leaf = ball_tree.filtered(pivots, radii, centres.astype(np.int64))
    whole = owner >= 0
    sizes = starts[:, 1] - starts[:, 0]
    assert sizes[whole].sum() + sizes[leaf].sum() == len(x)
    assert sizes[whole].sum() > 0.9 * len(x)  # most rows are never looked at
    assert (sums[0] == x.sum(0)).all()


def test_query_equals_its_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = sorted(con.execute(registry.ORACLE["op13_centroid_clustering"]).fetchall())
    got = registry.op13_centroid_clustering(spark, path)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == want
