"""The inverted-list index and the near-duplicate screen against brute force."""

import numpy as np
import pytest

from threadlake.operators import retrieval, screening

VEC = "vec_id long, embedding array<float>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(e) for e in v]) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], VEC)


def brute(x, asked, k):
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = np.round(u @ u[q], 6)
        s[q] = -9
        out[q] = [(int(i), s[i]) for i in np.lexsort((np.arange(len(x)), -s))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append((r["match_id"], r["cosine"]))
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    return rng.normal(size=(2500, 16)) * 0.3 + rng.normal(size=(30, 16))[rng.integers(0, 30, 2500)]


def test_all_cells_give_exact_answers(spark, clustered, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 20)  # several parts a cell
    monkeypatch.setattr(retrieval, "ASKED", 16)
    v = frame(spark, clustered).repartition(4)
    index = retrieval.build(v)
    got, want = found(retrieval.search(index, v.where("vec_id % 20 = 0"), 5)), brute(clustered, range(0, 2500, 20), 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([c for _, c in got[q]], [c for _, c in want[q]], atol=2e-6)
    assert spark.table(index.lists).selectExpr("sum(size(ids)) AS n").first()["n"] == 2500  # every row is indexed
    assert index.parts.selectExpr("max(parts) AS p").first()["p"] > 1


def test_few_probes_reach_the_measured_share(spark, clustered):
    v = frame(spark, clustered)
    index, asked = retrieval.build(v), v.where("vec_id % 20 = 0")
    probes = retrieval.measured_probes(index, asked, 5)
    assert probes < index.cells / 2
    exact = retrieval.search(index, asked, 5)
    seen = retrieval.recall(retrieval.search(index, asked, 5, probes), exact).first()
    assert seen["wanted"] == 625 and seen["recall"] >= 0.9
    plan = retrieval.search(index, asked, 5, probes)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Bucketed: true" in plan


def test_copies_odd_rows_and_an_empty_index(spark):
    x = np.ones((40, 3))
    rows = spark.createDataFrame([(i, [1.0, 1.0, 1.0]) for i in range(40)] + [(50, None), (51, [0.0, 0.0, 0.0]), (52, [float("nan"), 1.0, 1.0]), (None, [1.0, 0.0, 0.0])], VEC)
    index = retrieval.build(rows)
    assert found(retrieval.search(index, rows.where("vec_id IN (0, 5, 50, 51)"), 3)) == brute(x, [0, 5], 3)
    empty = retrieval.build(rows.limit(0))
    assert retrieval.search(empty, rows, 3).count() == 0
    index.drop()
    assert not spark.catalog.tableExists(index.lists)


def test_screen_finds_every_planted_pair(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    golden = []
    for i in range(300):  # cosines from 0.90 to 0.999 with one indexed vector each
        c, other = rng.uniform(0.9, 0.999), rng.normal(size=32)
        other -= (other @ x[i]) * x[i]
        golden.append(c * x[i] + np.sqrt(1 - c * c) * other / np.linalg.norm(other))
    indexed = np.concatenate((x, np.repeat(x[:1], 400, axis=0)))  # copies of one vector
    want = {}
    g = np.array(golden, np.float32).astype(np.float64)
    y = indexed.astype(np.float32).astype(np.float64)
    for i, v in enumerate(g):
        s = np.round(y @ v / (np.linalg.norm(y, axis=1) * np.linalg.norm(v)), 6)
        if s.max() > 0.95:
            want[10_000 + i] = int(s.argmax())
    got = screening.near_screen(frame(spark, golden, range(10_000, 10_300)), frame(spark, indexed))
    assert {r["id"]: r["best_id"] for r in got.collect()} == want and 100 < len(want) < 300
    # a row isn't near itself, but near its copy
    both = frame(spark, indexed)
    assert {r["id"]: r["best_id"] for r in screening.near_screen(both.where("vec_id IN (0, 1, 3000)"), both).collect()} == {0: 3000, 3000: 0}


def test_screen_report(spark):
    scored = spark.createDataFrame([(1, "A", "x", "x"), (2, "A", "x", "y"), (3, "B", "y", "y"), (4, "B", None, "y"), (5, "A", "x", None)], "vec_id long, stratum string, label_intent string, predicted string")
    near = spark.createDataFrame([(1, 9, 0.99), (3, 9, 0.97)], "id long, best_id long, cosine double")
    got = {r["stratum"]: tuple(r)[1:] for r in screening.screen_report(scored, near).collect()}
    assert got == {"A": (3, 1, 0.333333, 0.0), "B": (1, 1, 1.0, None)}
    assert screening.keys_for(0.95) > screening.keys_for(0.99)


def sent(spark, monkeypatch, column):
    """How many rows with this column go to the tasks' Python, per call."""
    out, frame = [], type(spark.range(0))
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (out.append(self.count()) if column in self.columns else None, run(self, *a, **k))[1])
    return out


def test_screen_deals_vectors_not_pairs(spark, monkeypatch):
    """Vectors so near that all share their buckets: a row per vector and key, where pairs would be 40 times as many."""
    rng = np.random.default_rng(5)
    x = 1 + rng.normal(size=(400, 8)) * 1e-3
    out = sent(spark, monkeypatch, "key")
    got = screening.near_screen(frame(spark, x).where("vec_id % 10 = 0"), frame(spark, x), 0.95, digits=12).collect()
    assert out == [440 * screening.keys_for(0.95)]
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    assert len(got) == 40 and all(abs(s[r["id"], r["best_id"]] - s[r["id"]].max()) < 1e-11 for r in got)


@pytest.mark.parametrize(("held", "tall"), [(10_000, 1), (40, 4)])
def test_exact_answers_copy_a_query_once_per_stripe(spark, clustered, monkeypatch, held, tall):
    for name, value in (("PART", 20), ("ASKED", 16), ("STRIPES", 3), ("HELD", held)):
        monkeypatch.setattr(retrieval, name, value)
    v = frame(spark, clustered)
    index = retrieval.build(v)
    out = sent(spark, monkeypatch, "tile")
    got, want = found(retrieval.search(index, v.where("vec_id % 20 = 0"), 5)), brute(clustered, range(0, 2500, 20), 5)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    parts = index.parts.selectExpr("sum(parts) AS n").first()["n"]
    assert parts > 100 and out == [8 * 3 + parts * tall]  # 8 blocks of queries


def test_exact_answers_with_fewer_rows_than_wanted(spark):
    x = np.array([[1.0, 0], [0, 1], [1, 1]])
    v = frame(spark, x)
    assert found(retrieval.search(retrieval.build(v), v, 5)) == brute(x, range(3), 2)


def test_nearest_cells_are_products(spark):
    rng = np.random.default_rng(6)
    u, c = rng.normal(size=(30, 4)), rng.normal(size=(9, 4))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(u)], "id long, u array<double>")
    cells = spark.createDataFrame([(10 + i, r.tolist()) for i, r in enumerate(c)], "cell int, c array<double>")
    near = retrieval.nearest_cells(rows, cells, 3)
    want = 10 + np.argsort(((u[:, None] - c) ** 2).sum(2) - (u**2).sum(1)[:, None], axis=1)[:, :3]
    assert [r["cells"] for r in near.orderBy("id").collect()] == want.tolist()
    assert "zip_with" not in near._jdf.queryExecution().toString()
