import random

import pytest

from threadlake.operators.graph import brand_connected_ids, connected_components, thread_roots
from threadlake.operators.threads import merge_parts

MSG = "tweet_id long, author_id string, in_response_to_tweet_id long, created_at timestamp, text string"


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, i) for i in range(501, 540)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_brand_connected_through_phantoms(spark):
    rows = [(1, "brand", 99), (2, "u", 99), (3, "u", None), (4, "u", 3), (5, "u", 98)]
    m = spark.createDataFrame(rows, "tweet_id long, author_id string, in_response_to_tweet_id long")
    assert {r["id"] for r in brand_connected_ids(m, "brand").collect()} == {1, 2, 99}
    with pytest.raises(ValueError, match="nobody"):
        brand_connected_ids(m, "nobody")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, None), (2, 1), (3, 1), (4, 3)], {1: 1, 2: 1, 3: 1, 4: 1}),
        ([(5, 777)], {5: 5}),
        ([(7, 7)], {7: 7}),
        ([(1, 2), (2, 1)], {1: 1, 2: 1}),
        ([(1, 5), (5, 6), (6, 5), (9, 8), (8, None)], {1: 5, 5: 5, 6: 5, 9: 8, 8: 8}),
        ([(i, i - 1 if i else None) for i in range(30)], dict.fromkeys(range(30), 0)),
        ([(i, (i + 1) % 11) for i in range(11)] + [(50 + i, 49 + i if i else 3) for i in range(9)], dict.fromkeys([*range(11), *range(50, 59)], 0)),
    ],
)
def test_thread_roots(spark, rows, want):
    m = spark.createDataFrame(rows, "tweet_id long, in_response_to_tweet_id long")
    assert {r["id"]: r["thread_id"] for r in thread_roots(m).collect()} == want


def ts(n):
    import datetime

    return datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=n)


def test_merge_chain_with_fork_and_cycle(spark):
    rows = [
        (1, "u", None, ts(0), "hello"), (2, "b", 1, ts(1), "one (1/3)"), (3, "b", 2, ts(2), "two (2/3)"), (4, "b", 3, ts(3), "three (3/3)"),
        (5, "b", 2, ts(9), "late fork"), (6, "b", 7, ts(1), "x (1/2)"), (7, "b", 6, ts(2), "y (2/2)"), (8, "u", 2, ts(4), "to a part"),
        (10, "b", 1, ts(8), "a (1/3)"), (11, "b", 10, ts(7), "b (2/3)"), (12, "b", 11, ts(6), "c"),
    ]
    got = {r["tweet_id"]: (r["text"], r["in_response_to_tweet_id"]) for r in merge_parts(spark.createDataFrame(rows, MSG), "b").collect()}
    assert got == {
        1: ("hello", None), 4: ("one two three (3/3)", 1), 5: ("late fork", 2), 6: ("x (1/2)", 7), 7: ("y (2/2)", 6), 8: ("to a part", 2), 12: ("a b c", 1),
    }
    with pytest.raises(ValueError):
        merge_parts(spark.createDataFrame([rows[0], rows[0]], MSG), "b")
