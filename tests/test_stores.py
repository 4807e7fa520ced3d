"""The response cache, the embedding store, sorted sinks and the streamed table."""

import pytest
from pyspark.sql import functions as F

from threadlake.operators import records
from threadlake.sources import files
from threadlake.sources.embedding_store import EmbeddingStore
from threadlake.sources.response_cache import CacheMiss, ResponseCache
from threadlake.sources.versions import VersionLog
from threadlake.streaming.latest import LatestTable

CHAIN = "array<struct<provider:string,model:string,enabled:boolean,key:string>>"


def answers(spark, *rows):
    return spark.createDataFrame([(k, "p", m, t, 1, 2, "2024", 3) for k, m, t in rows], files.CACHE)


def texts_of(cache):
    return {r["key"]: r["text"] for r in cache.read().collect()}


def test_cache_survives_a_reload_and_the_last_record_wins(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path))
    cache.put(answers(spark, ("k1", "m", "one"), ("k2", "m", "two"), ("k1", "m", "one again")).coalesce(1))
    cache.put(answers(spark, ("k2", "n", "newer")))
    again = ResponseCache(spark, str(tmp_path))
    assert texts_of(again) == {"k1": "one again", "k2": "newer"}
    assert {r["model"]: r["n"] for r in records.calls_by_model(again.read()).collect()} == {"p/m": 1, "p/n": 1}
    for _ in range(3):
        again.compact()
    again.put(answers(spark, ("k3", "m", "three")))
    assert texts_of(ResponseCache(spark, str(tmp_path))) == {"k1": "one again", "k2": "newer", "k3": "three"}
    assert len([p for p in tmp_path.iterdir() if p.name.startswith(("base", "part"))]) == 3  # the base, the one before it and a part


def test_torn_lines_of_a_log_are_left_out(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text(answers(spark, ("k1", "m", "ok")).toJSON().first() + '\n\n{"key": "k2", "provi')
    cache = ResponseCache(spark, f"{tmp_path}/c")
    cache.adopt(str(log))
    assert texts_of(cache) == {"k1": "ok"}


def test_read_only_cache_writes_nothing(spark, tmp_path):
    cache = ResponseCache(spark, f"{tmp_path}/c", read_only=True)
    cache.put(answers(spark, ("k1", "m", "held")))
    assert texts_of(cache) == {"k1": "held"} and not (tmp_path / "c").exists()
    with pytest.raises(PermissionError):
        cache.compact()
    assert texts_of(ResponseCache(spark, f"{tmp_path}/c")) == {}


def test_missing_answers_raise(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path))
    cache.put(answers(spark, ("k3", "m", "hit")))
    calls = spark.createDataFrame([(1, [("p", "m", True, "k1"), ("p", "m", False, "k2"), ("p", "m", True, "k3")]), (2, [("p", "m", False, "k3")])], f"call_id long, chain {CHAIN}")
    assert [(r["call_id"], r["text"]) for r in cache.lookup(calls).collect()] == [(1, "hit")]
    assert cache.require(calls.where("call_id = 1")).count() == 1
    with pytest.raises(CacheMiss, match=r"\[2\]"):
        cache.require(calls)


def test_versions(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path))
    assert log.latest() == (0, {})
    log.commit(1, {"a": 1})
    with pytest.raises(FileExistsError):
        log.commit(1, {"a": 2})
    (tmp_path / "_versions" / "000000000002.json").write_text('{"a": ')  # torn
    assert log.latest() == (2, {"a": 1})
    log.commit(3, {"a": 3})
    assert log.latest() == (3, {"a": 3})
    assert not list((tmp_path / "_versions").glob(".draft*"))


class Encoder:
    def __init__(self, extra=0):
        self.calls, self.extra = 0, extra

    def __call__(self, rows):
        self.calls += 1
        out = rows.withColumn("embedding", F.array(F.length(F.coalesce("text", F.lit(""))).cast("double"), F.lit(0.1)))
        return out if not self.extra else out.unionByName(out.limit(self.extra))


def sets(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "place long, text string")


def test_embedding_key(spark, tmp_path):
    key = lambda *texts, model="m", dtype="float": EmbeddingStore(spark, str(tmp_path), model, dtype).key(sets(spark, *texts))
    keys = [key("a", "b"), key("b", "a"), key("a"), key("a", "b", model="n"), key("a", "b", dtype="double"), key("a", None), key("a", "")]
    assert len(set(keys)) == len(keys) and key("a", "b") == keys[0]
    with pytest.raises(ValueError):
        EmbeddingStore(spark, str(tmp_path), "m", "int")


def test_embeddings_are_made_once(spark, tmp_path):
    store, encode = EmbeddingStore(spark, str(tmp_path), "m"), Encoder()
    texts = sets(spark, "bag", "flight", None)
    first = sorted(store.embed(texts, encode).collect())
    assert sorted(store.embed(texts.repartition(3), encode).collect()) == first and encode.calls == 1
    assert [r["embedding"][0] for r in first] == [3.0, 6.0, 0.0] and dict(store.embed(texts, encode).dtypes)["embedding"] == "array<float>"
    store.embed(texts.limit(0), encode)
    assert encode.calls == 2


def test_wrong_row_count_is_refused_and_not_stored(spark, tmp_path):
    store, texts = EmbeddingStore(spark, str(tmp_path), "m"), sets(spark, "a", "b")
    with pytest.raises(ValueError, match="3 vectors for 2 texts"):
        store.embed(texts, Encoder(1))
    with pytest.raises(ValueError, match="0 vectors for 2 texts"):
        store.embed(texts, lambda rows: rows.withColumn("embedding", F.lit(None)))
    encode = Encoder()
    assert store.embed(texts, encode).count() == 2 and encode.calls == 1


@pytest.mark.parametrize("harm", ["garbage", "gone", "other rows", "torn version"])
def test_corrupt_segments_are_made_again(spark, tmp_path, harm):
    store, texts, encode = EmbeddingStore(spark, str(tmp_path), "m"), sets(spark, "bag missing", "late"), Encoder()
    want = sorted(store.embed(texts, encode).collect())
    (home,) = tmp_path.iterdir()
    (segment,) = home.glob("segment-*")
    if harm == "garbage":
        for p in segment.glob("*.parquet"):
            p.write_bytes(b"not parquet")
    if harm == "gone":
        for p in segment.glob("*.parquet"):
            p.unlink()
    if harm == "other rows":
        store._segment(str(segment)).limit(1).write.mode("append").parquet(str(segment))
    if harm == "torn version":
        (home / "_versions" / "000000000001.json").write_text("{")
    for p in home.rglob(".*.crc"):
        p.unlink()
    assert sorted(store.embed(texts, encode).collect()) == want and encode.calls == 2
    assert sorted(store.embed(texts, encode).collect()) == want and encode.calls == 2


def test_sorted_sink(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), "id")
    files.write_sorted(rows, f"{tmp_path}/s", ["v", "id"], 7)
    ranges = sorted(files.file_ranges(spark, f"{tmp_path}/s", "v").collect(), key=lambda r: r["file"])
    assert len(ranges) == 7 and sum(r["n"] for r in ranges) == 5000
    assert all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:], strict=False))
    for r in ranges:
        v = [x["v"] for x in spark.read.parquet(f"{tmp_path}/s/{r['file']}").collect()]
        assert v == sorted(v)
    files.write_sorted(rows.limit(0), f"{tmp_path}/e", ["v"])
    assert spark.read.schema("v long").parquet(f"{tmp_path}/e").count() == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = LatestTable(str(tmp_path), "k long, v string, seq long", "k", "seq", buckets=8)
    batch = lambda *rows: spark.createDataFrame(rows, "k long, v string, seq long")
    table.upsert(batch(*[(i, "first", 1) for i in range(100)]), 0)
    before = VersionLog(spark, str(tmp_path)).latest()[1]["buckets"]
    table.upsert(batch((7, "second", 2), (7, "late", 0)), 1)
    after = VersionLog(spark, str(tmp_path)).latest()[1]["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    table.upsert(batch((7, "again", 9)), 1)  # the same epoch, run once more
    rows = {r["k"]: r["v"] for r in table.read(spark).collect()}
    assert len(rows) == 100 and rows[7] == "second" and rows[8] == "first"
    for epoch in range(2, 6):
        table.upsert(batch((7, f"v{epoch}", epoch)), epoch)
    assert {r["k"]: r["v"] for r in table.read(spark).collect()}[7] == "v5"
    kept = [p for p in tmp_path.glob("e*/_bucket=*")]
    assert len(kept) <= 8 + 1  # of bucket 7's versions, the last two


def test_empty_batch(spark, tmp_path):
    table = LatestTable(str(tmp_path), "k long, v string, seq long", "k", "seq")
    table.upsert(spark.createDataFrame([], "k long, v string, seq long"), 0)
    assert table.read(spark).count() == 0
