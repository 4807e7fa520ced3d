"""Periodic runs against brute force: the pieces on random and nested repetitions, the query on whole tables of sf0.001."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlake.llm import periodic_runs, registry

PATH = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    """All (start, end, least period), period by period."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((b, e, q) for (b, e), q in out.items())


@st.composite
def nested(draw):
    rng = random.Random(draw(st.integers(0, 10**9)))
    letters = rng.choice([1, 2, 2, 3, 5])
    t = [rng.randrange(letters)]
    while len(t) < rng.randrange(1, 200):
        a = rng.randrange(len(t))
        t += t[a : rng.randrange(a + 1, len(t) + 1)] * rng.randrange(1, 6) if rng.random() < 0.8 else [rng.randrange(letters)]
    return t[:300]


@settings(max_examples=300, deadline=None)
@given(nested(), st.sampled_from([(24, 3), (3, 3), (6, 3), (12, 4)]))
def test_runs_equal_brute_force(text, bounds):
    assert periodic_runs.find_runs(text, *bounds) == brute(text, *bounds)
    words = [[b"w%d" % x for x in text], [], [b"v%d" % x for x in reversed(text)]]
    assert periodic_runs.runs_of_documents(words, *bounds) == [brute(w, *bounds) for w in words]


def test_lpf_equals_its_definition():
    rng = random.Random(2)
    for _ in range(60):
        t = [rng.randrange(3) for _ in range(rng.randrange(1, 60))] + [9]
        length, place = periodic_runs.longest_previous(*periodic_runs.suffix_array(np.array(t)))
        common = lambda i, j: next((k for k in range(len(t)) if i + k >= len(t) or t[i + k] != t[j + k]), 0)
        for i in range(len(t)):
            assert length[i] == max((common(i, j) for j in range(i)), default=0)
            assert not length[i] or common(i, place[i]) == length[i] and place[i] < i
        cut = periodic_runs.blocks(length, place)
        assert [s for s, _, _ in cut][1:] == [e for _, e, _ in cut][:-1] and cut[-1][1] == len(t)


def expected(doc_id, text, plant=True):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for b, e, q in runs for i in range(b + q, e)}
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    figures = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{b},{e - b},{q}\n" for b, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text").collect()
    got = registry.op12_periodic_runs(spark, PATH)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {k for c, k in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    found = {r["doc_id"]: tuple(r) for r in got.collect()}
    # brute force is quadratic: the longest documents are left to the random texts above
    some = [r for r in rows if len((r["text"] or "").split()) < 2500]
    assert len(found) == len(rows) and len(some) > 0.9 * len(rows)
    assert [found[r["doc_id"]] for r in some] == [expected(r["doc_id"], r["text"]) for r in some]
    assert sum(1 for r in found.values() if r[1]) > 5


def test_odd_rows(spark, tmp_path):
    long = "a b c " * 40_000 + "z " + "q r s t " * 9
    texts = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, "x " * 30), (None, None), (5, "x y " * 12), (5, "x y " * 12), (5, "one"), (6, long), (7, "é é é é " * 20), (8, "w " * 23), (9, "w\x1fw w\x1fw " * 15)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, runs int, collapsed int")
    got = sorted(((r["doc_id"], [(x["start"], x["start"] + x["length"], x["period"]) for x in r["runs"]], r["n_words"]) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    fast = lambda t: [(0, 120_000, 3), (120_001, 120_037, 4)] if t == long else brute(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = sorted(((i, fast(t), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in texts), key=str)
    assert got == want
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {str(tuple(r)) for r in registry.op12_periodic_runs(spark, str(tmp_path)).where("doc_id <> 6").collect()}
    assert rows == {str(expected(i, t)) for i, t in texts if i not in (None, 6)}
    assert registry.op12_periodic_runs(spark, str(tmp_path)).where("doc_id is null").count() == 2


def test_ties_of_the_best_run(spark):
    runs = [(0, 30, 2), (50, 45, 3), (120, 24, 8)]
    df = spark.createDataFrame([(runs,), (runs[::-1][:1],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and r[0]["start"] for r in df.select(periodic_runs.best_run(df.runs)).collect()] == [0, 120, None]


def test_a_run_too_short_to_find_its_words_again_is_refused():
    with pytest.raises(ValueError):
        periodic_runs.seed_words(24, 2)
