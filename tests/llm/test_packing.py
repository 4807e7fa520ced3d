"""Packing against one best fit of everything: never more sequences, fewer where best fit leaves room."""

import random
from collections import Counter

import pytest

from threadlake.llm import packing
from threadlake.session import Scratch, table


def best_fit_count(sizes, capacity=1024):
    return len(packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity))


def test_patterns_are_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.choice([7, 30, 1024])
        sizes = [rng.randrange(1, capacity + 1) if rng.random() < 0.7 else rng.randrange(1, 4) for _ in range(rng.randrange(1, 400))]
        groups = packing.patterns(Counter(sizes), capacity)
        assert sum(n for _, n in groups) == best_fit_count(sizes, capacity)
        held = Counter()
        for contents, n in groups:
            assert sum(size * each for size, each in contents) <= capacity
            for size, each in contents:
                held[size] += n * each
        assert held == Counter(sizes)
        assert len(groups) <= 4 * len(set(sizes)) + 1


def made(spark, sizes):
    rows = [(i, 0, 0, n, i) for i, n in enumerate(sizes)]
    return Scratch(spark, "test").table(spark.createDataFrame(rows, packing.PIECES).repartition(5), "pieces")


def counted(spark, monkeypatch, sizes, **options):
    monkeypatch.setattr(packing, "pieces", lambda *a, **k: made(spark, sizes))
    bins = {}
    for r in packing.pack(spark.range(0), **options).collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert sorted(d for b in bins.values() for _, _, d in b) == list(range(len(sizes)))
    for b in bins.values():
        end = 0
        for offset, length, _ in sorted(b):
            assert offset == end
            end += length
        assert end <= 1024
    return len(bins)


def test_each_piece_has_its_bin(spark):
    rng = random.Random(1)
    sizes = [rng.choice([1024, 500, 300, 24, rng.randrange(1, 1025)]) for _ in range(900)]
    bins = {}
    for r in packing._seeded(made(spark, sizes), 1024, 20).collect():  # a length's pieces are numbered in several parts
        bins.setdefault(r["bin"], []).append(r["length"])
    assert sum(map(len, bins.values())) == 900 and len(bins) == best_fit_count(sizes)
    assert max(map(sum, bins.values())) <= 1024


@pytest.mark.parametrize("kind", ["triplets", "middling", "any", "large", "ones"])
def test_never_more_than_one_best_fit(spark, monkeypatch, kind):
    """Over several blocks and levels; where best fit leaves room the islands need fewer."""
    rng = random.Random(4)
    sizes = []
    for _ in range(150):
        a, b = rng.randrange(256, 512), rng.randrange(256, 412)
        sizes += {"triplets": [a, b, 1024 - a - b], "middling": [rng.randrange(200, 500) for _ in range(3)], "any": [rng.randrange(1, 1025) for _ in range(3)], "large": [rng.randrange(600, 700)], "ones": [1, 1, 1024]}[kind]
    count = counted(spark, monkeypatch, sizes, block=100)
    assert -(-sum(sizes) // 1024) <= count <= best_fit_count(sizes)
    if kind in ("triplets", "middling"):
        assert count < best_fit_count(sizes)


def test_query_needs_no_more_than_one_best_fit(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    rows = packing.pack(docs).select("length", "sequence_id").collect()
    sizes = [r["length"] for r in rows]
    assert len({r["sequence_id"] for r in rows}) <= best_fit_count(sizes)
