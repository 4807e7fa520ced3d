"""Nearest neighbours by Hilbert windows against brute force: recall, scores, ties, odd rows."""

import math

import numpy as np
import pytest

from threadlake.llm import hilbert_search, registry

ASKED = "id % 20 = 0"


def brute(rows, k=20):
    """{query id: [(score, id)]} by whole inner products."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            best = out.setdefault(q, {})
            for i, w in ok:
                if i != q and len(w) == len(v):
                    s = math.fsum(a * b for a, b in zip(v, w, strict=True))
                    best[i] = max(s, best.get(i, -math.inf))
    return {q: sorted(((s, i) for i, s in b.items()), key=lambda r: (-r[0], r[1]))[:k] for q, b in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hit = sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items())
    return hit / max(1, sum(map(len, want.values())))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, score int")


def test_hilbert_keys_are_a_curve():
    """Each cell once, and each step goes to a neighbouring cell."""
    for places, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * places, indexing="ij"), -1).reshape(-1, places)
        keys = hilbert_search.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("kind", ["clusters", "even", "lengths"])
def test_recall(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    n, d = 3000, 16
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = x * 0.1 + rng.normal(size=(60, d))[rng.integers(0, 60, n)]
    if kind == "lengths":
        x *= rng.uniform(0.5, 2, (n, 1))
    monkeypatch.setattr(hilbert_search, "LEAST_BLOCK", 32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows)
    got = found(hilbert_search.nearest(frame(spark, rows).repartition(4), ASKED, sample=64))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.9
    for q, g in got.items():
        assert g == sorted(g, key=lambda r: (-r[0], r[1])) and q not in [i for _, i in g]
        assert all(abs(s - math.fsum(a * b for a, b in zip(rows[q][1], rows[i][1], strict=True))) < 1e-12 for s, i in g)


def test_narrow_windows_where_vectors_lie_in_clusters(spark):
    """Then a query meets a small part of the rows only."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16)) * 0.02 + rng.normal(size=(100, 16))[rng.integers(0, 100, 4000)]
    nodes = spark.createDataFrame([(i, i % 20 == 0, v.tolist()) for i, v in enumerate(x)], "node long, asks boolean, v array<double>")
    curves = hilbert_search.Curves(x[:500], float(np.linalg.norm(x, axis=1).max()), 8, 8, 1)
    scratch = hilbert_search.Scratch(spark, "test")
    ranked = hilbert_search.with_ranks(scratch, nodes.mapInArrow(hilbert_search._curves(curves), hilbert_search.CURVE), 8 * 4200)
    assert sorted(r["rank"] for r in ranked.where("t = 3").collect()) == list(range(4200))
    sample = nodes.where("asks").limit(64).collect()
    pairs = [(r["asker"], r["node"]) for r in hilbert_search.true_neighbours(nodes, sample, 20).collect()]
    assert len(pairs) == 64 * 20
    assert hilbert_search.half_width(ranked, pairs, 0.95, 21) < 400


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(1000, 1400)]  # a hot vector, queries among its rows
    rows += [(2000, [0.5, 0.5, 0.0, 0.0]), (2000, [0.0, 0.0, 9.0, 9.0]), (2001, [0.0, 0.0, 9.0, 9.0]), (2001, [0.0, 0.0, 9.0, 9.0])]  # repeated ids and rows
    odd = [(40000, None), (40020, []), (40040, [0.0] * 4), (40060, [1.0, None, 0.0, 0.0]), (40080, [float("nan"), 1.0, 0.0, 0.0]), (40100, [float("inf"), 1.0, 0.0, 0.0]), (40120, [1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    want = brute(rows)
    got = found(hilbert_search.nearest(frame(spark, rows + odd), ASKED))  # narrow enough that one block holds all: exact
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [i for _, i in got[q]] == [i for _, i in w]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in w], rtol=0, atol=1e-12)


def test_few_and_no_rows(spark):
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 1.0])]
    assert found(hilbert_search.nearest(frame(spark, few), ASKED)) == {0: [(4.0, 1), (3.0, 20)], 20: [(3.0, 0), (3.0, 1)]}
    for rows in ([], few[1:2]):
        out = hilbert_search.nearest(frame(spark, rows), ASKED)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0


def test_query_recall(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows)
    df = registry.op11_nearest_neighbours(spark, path)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = found(df)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
