import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import records, threads
from threadlake.operators.sampling import round_robin, two_strata, uniform
from threadlake.plans.discover import discover
from threadlake.plans.golden import compiled, golden_sample
from threadlake.plans.ingest import ingest
from threadlake.sources import files

CSV = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,u1,True,Tue Oct 31 22:10:47 +0000 2017,"hello, @brand
second ""line""",2,
2,brand,False,Tue Oct 31 22:11:47 +0000 2017,part one (1/2),3,1.0
3,brand,False,2017-10-31T22:12:45Z,part two (2/2),,2
4,u2,True,Tue Oct 31 22:20:47 +0000 2017,other brand,,
5,u3,True,not-a-date,cites a phantom,,900
5,u3,True,Tue Oct 31 22:30:47 +0000 2017,good date too late,,900
6,brand,False,Tue Oct 31 22:40:47 +0000 2017,also the phantom,,900
7,u4,True,Tue Oct 31 22:50:47 +0000 2017,mail me at a@b.co,,6
'''


def test_ingest(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(CSV)
    rows, counters = ingest(spark, str(path), "brand")
    got = {r["tweet_id"]: r.asDict() for r in rows.collect()}
    assert sorted(got) == [1, 3, 6, 7]
    assert got[1]["text"] == 'hello, @brand\nsecond "line"'
    assert got[3]["text"] == "part one part two (2/2)" and got[3]["in_response_to_tweet_id"] == 1 and got[3]["thread_id"] == 1
    assert got[7]["thread_id"] == 6 and got[7]["text_scrubbed"] == "mail me at [EMAIL]"
    n = {r["counter"]: r["n"] for r in counters.collect()}
    assert (n["total_rows"], n["brand_connected_ids"], n["duplicates_dropped"], n["undated_dropped"], n["multipart_merged"], n["rows"]) == (8, 7, 1, 1, 1, 4)
    assert n["threads"] == 2


def test_numbers_and_dates(spark):
    rows = spark.createDataFrame([("12.0",), ("x",), ("",), ("9007199254740993",), (None,)], "s string")
    assert [r[0] for r in rows.select(files.to_long(F.col("s"))).collect()] == [12, None, None, 9007199254740993, None]


def frame(spark, n=120):
    t0 = datetime.datetime(2020, 1, 1)
    words = ["refund please", "cancel it", "my seat", "wheelchair and also", "plain"]
    rows = []
    for i in range(n):
        rows.append((2 * i, i, f"u{i}", "True", t0 + datetime.timedelta(hours=i), words[i % 5], i < n // 3))
        rows.append((2 * i + 1, i, "brand", "false", t0 + datetime.timedelta(hours=i, minutes=5), f"reply {i}", i < n // 3))
    return spark.createDataFrame(rows, "tweet_id long, thread_id long, author_id string, inbound string, created_at timestamp, text_scrubbed string, in_training_window boolean")


def test_golden(spark):
    m = frame(spark)
    a, b = golden_sample(m, "brand", 20, 20).collect(), golden_sample(m, "brand", 20, 20).collect()
    assert sorted(r["tweet_id"] for r in a) == sorted(r["tweet_id"] for r in b)
    assert len({r["tweet_id"] for r in a}) == 40 and sum(r["stratum"] == "A" for r in a) == 20
    assert all(r["reference_reply"] == f"reply {r['thread_id']}" for r in a)
    assert {r["tweet_id"] for r in golden_sample(m, "brand", 20, 20, seed=1).collect()} != {r["tweet_id"] for r in a}
    with pytest.raises(ValueError):
        golden_sample(m, "brand", 60, 60)


def taken_in_turn(found, names, quota):
    queues, chosen = {n: [i for b, i in found if b == n] for n in names}, {}
    while len(chosen) < quota and any(queues.values()):
        for n in names:
            while queues[n] and queues[n][0] in chosen:
                queues[n].pop(0)
            if queues[n] and len(chosen) < quota:
                chosen[queues[n].pop(0)] = n
    return chosen


def test_round_robin_exhausts_and_skips(spark):
    def fold(found, names, quota):
        place = {n: 0 for n in names}
        rows = []
        for b, i in found:
            place[b] += 1
            rows.append((i, b, place[b]))
        return {r["id"]: r["bucket"] for r in round_robin(spark.createDataFrame(rows, "id long, bucket string, rn int"), names, quota, "id").collect()}

    found = [("a", 1), ("a", 2), ("b", 1), ("c", 5)]
    assert fold(found, ["a", "b", "c"], 10) == {1: "a", 5: "c", 2: "a"}
    assert fold(found, ["a", "b", "c"], 2) == {1: "a", 5: "c"}
    assert fold([], ["a", "b"], 3) == {}
    rng = random.Random(3)
    for _ in range(15):
        names, quota = list("abcde")[: rng.randrange(1, 6)], rng.randrange(1, 12)
        found = [(n, i) for n in names for i in rng.sample(range(25), rng.randrange(0, quota + 1))]
        assert fold(found, names, quota) == taken_in_turn(found, names, quota)


def test_topup(spark):
    pool = spark.createDataFrame([(i, "plain" if i else "refund") for i in range(10)], "tweet_id long, text_scrubbed string")
    got = two_strata(pool, 2, 5).collect()
    assert len(got) == 7 and sum(r["sample_reason"] == "random_topup" for r in got) >= 4
    assert uniform(pool, 3, 1, "tweet_id").count() == 3


def test_first_turns_keep_null_text_and_ties(spark):
    t = datetime.datetime(2020, 1, 1)
    rows = [(2, 1, "u", "1", t, "later id", True), (1, 1, "u", "True", t, None, True), (3, 2, "u", "False", t, "not inbound", True)]
    m = spark.createDataFrame(rows, frame(spark, 1).schema)
    assert [(r["tweet_id"], r["text_scrubbed"]) for r in threads.first_turns(m).collect()] == [(1, None)]


def test_straddling(spark):
    t = datetime.datetime(2020, 1, 1)
    rows = [(1, 1, "u", "1", t, "open", True), (2, 1, "u", "1", t, "follow-up", False)]
    m = spark.createDataFrame(rows, frame(spark, 1).schema)
    assert threads.straddling_threads(m).collect()[0].asDict() == {"thread_id": 1, "n_train": 1, "n_eval": 1}
    assert threads.first_turns(m, training=False).first()["tweet_id"] == 2


def test_label_log(spark, tmp_path):
    base = {"thread_id": 1, "text": "t", "created_at": "c", "stratum": "A", "sample_reason": "r", "notes": ""}
    log = [base | {"tweet_id": 1, "label_intent": "x", "label_action": "auto"}, base | {"tweet_id": 2, "label_intent": None}, base | {"tweet_id": 1, "label_intent": "y", "label_action": None}]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, log)) + '\n\n{"tweet_id": 3, "thr')
    rows = files.read_jsonl(spark, str(path), files.LABEL, files.LABEL_REQUIRED)
    assert rows.count() == 3
    seq = rows.withColumn("seq", F.monotonically_increasing_id())
    sample = spark.createDataFrame([(1, "s1"), (2, "s2"), (9, "s9")], "tweet_id long, label_intent string").join(rows.drop("label_intent").limit(0), "tweet_id", "left").select(*[c.split()[0] for c in files.LABEL.split(", ")])
    got = {r["tweet_id"]: (r["label_intent"], r["label_action"]) for r in compiled(sample, seq).collect()}
    assert got == {1: ("y", None), 2: (None, None), 9: ("s9", None)}
    first = rows.where("label_intent = 'x'")
    assert records.progress(sample, first).first().asDict() == {"done": 1, "total": 3}
    assert {r["tweet_id"] for r in records.unlabelled(sample, first).collect()} == {2, 9}


def test_cache(spark):
    cache = spark.createDataFrame([("k2", "p2", "m2", "hit2"), ("k3", "p3", "m3", "hit3")], "key string, provider string, model string, text string")
    chain = "array<struct<provider:string,model:string,enabled:boolean,key:string>>"
    calls = spark.createDataFrame([(1, [("p1", "m1", True, "k1"), ("p2", "m2", False, "k2"), ("p3", "m3", True, "k3")]), (2, [("p1", "m1", True, "k1")])], f"call_id long, chain {chain}")
    assert [(r["call_id"], r["text"]) for r in records.cache_lookup(calls, cache).collect()] == [(1, "hit3")]
    assert [r["call_id"] for r in records.cache_misses(calls, cache).collect()] == [2]
    assert {r["model"]: r["n"] for r in records.calls_by_model(cache).collect()} == {"p2/m2": 1, "p3/m3": 1}


def test_discover(spark):
    t = datetime.datetime(2020, 1, 1)
    words = ["late flight delay", "refund my money", "lovely crew thanks"]
    rows = [(i, i, "u", "1", t, f"{words[i % 3]} {words[i % 3]} {i % 4}", True) for i in range(36)]
    m = spark.createDataFrame(rows, frame(spark, 1).schema)
    out = discover(m, files.hashing_embedder(), lambda p: F.when(p.contains("refund"), F.lit("no json")).otherwise(F.lit('{"label": "same", "description": "d"}')), [2, 3, 50], seed=1)
    assert {r["k"] for r in out["sweep"].collect()} == {2, 3}
    labels = sorted(r["label"] for r in out["clusters"].collect())
    assert len(labels) == 3 and labels[:2] == ["same", "same"] and labels[2].startswith("unlabelled_cluster_")
    kinds = {r["warning"] for r in out["warnings"].collect()}
    assert {"duplicate_label", "unreadable_answer"} <= kinds
    made = json.loads(out["taxonomy"].first()[0])
    assert made["chosen_k"] == 3 and made["intents"][-1]["label"] == "other"


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    full, made = files.embed_cached(texts, None, files.hashing_embedder(8), "m")
    assert full.count() == 3 and made.count() == 2
    again, more = files.embed_cached(texts.union(spark.createDataFrame([(4, "c")], texts.schema)), made, files.hashing_embedder(8), "m")
    assert again.count() == 4 and more.count() == 1
