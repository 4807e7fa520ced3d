"""The pipeline's stages one after the other against brute force, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_operators import brute_components, brute_lines

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    toxic = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{DIR}/labels.parquet' WHERE toxic = 1").fetchall()}
    before, out = seen["toxicity"]
    gone = set(before) - {r["doc_id"] for r in out.collect()}
    clean = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{DIR}/labels.parquet' WHERE toxic = 0").fetchall()}
    assert not gone & clean and len(gone) <= 4 * len(toxic) + 5
    assert len(gone & toxic) >= 0.5 * len(toxic)
    before, out = seen["line_dedup"]
    ids = sorted(before)
    rename = {i: n for n, i in enumerate(ids)}
    want = brute_lines([before[i] for i in ids])
    assert {rename[r["doc_id"]]: r["text"] for r in out.collect()} == {n: w[2] for n, w in enumerate(want)}
    before, out = seen["near_dedup"]
    ids = sorted(before)
    assert {r["doc_id"] for r in out.collect()} == {ids[c] for c in brute_components([before[i] for i in ids], 80)[1]}
    before, out = seen["packing"]
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(before)
    sums = {r["s"] for r in out.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "s").collect()}
    assert max(sums) <= 1024


def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and extra columns with names that the stages use inside."""
    line = "This line is in all of the documents of this table, and longer than forty signs."
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(None, "no id at all", "en", "s", 12), (1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", None, len(long)), (4, long + " more", "en", "s", None)]
    rows += [(5, "one row twice", "en", "s", 13)] * 2 + [(i, f"{line}\n{i} and what is its own: {i * i} {i * 7} {i * 31}", "en", "s", 1) for i in range(6, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_lines", "_dropped", "_id", "id", "key", "score", "label", "hits", "kept"):
        df = df.withColumn(c, F.lit("mine"))
    return df


@pytest.mark.parametrize("stage", P.STAGES, ids=lambda s: s[0])
def test_odd_rows(spark, stage):
    name, f = stage
    docs = odd(spark)
    out = f(spark, docs, DIR)
    got = out.collect()
    assert f(spark, docs.limit(0), DIR).count() == 0
    if name == "packing":
        assert {r["doc_id"] for r in got} == {None, *range(1, 12)} and sum(r["doc_id"] == 5 for r in got) == 2
        return
    assert out.columns == docs.columns and all(r["score"] == "mine" and r["_dropped"] == "mine" for r in got)
    want = sorted(r["doc_id"] or 0 for r in docs.collect() if not (name == "near_dedup" and r["doc_id"] == 4))
    assert sorted(r["doc_id"] or 0 for r in got) == want
    if name == "line_dedup":
        assert sum("This line" in (r["text"] or "") for r in got) == 1


def test_toxic_documents_go(spark):
    """Documents with an insult from the labelled ones, as it is, dotted and with blanks, in texts that stay without it."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    plain = "The report of the group was read in the house and then it was sent to them."
    texts = [plain, f"{plain} You clown, go.", f"{plain} You c.l.o.w.n, go.", f"{plain} You c l o w n, go."]
    planted = spark.createDataFrame([(10**6 + i, t, "en", "planted", len(t)) for i, t in enumerate(texts)], docs.schema)
    assert labels.where("toxic = 1").count() > 0
    left = {r["doc_id"] for r in P.drop_toxic(spark, docs.unionByName(planted), DIR).where("source = 'planted'").collect()}
    assert left == {10**6}


def test_near_copies_at_the_stages_own_threshold(spark):
    """Similarity 0.82: a near copy here, though not at op4's 0.85."""
    words = [f"w{i}" for i in range(204)]
    other = [*words]
    for at in (30, 80, 130, 180):
        other[at] = "new"
    texts = [" ".join(words), " ".join(other), "something else that is not like them"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = ({tuple(w[i : i + 5]) for i in range(200)} for w in (words, other))
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    assert {r["doc_id"] for r in P.drop_near_copies(spark, docs, DIR).collect()} == {0, 2}


def test_a_passage_of_one_item_is_dealt_with(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    texts = ["nothing of the kind", f"before it {item} after it", " ".join(item.split()[:9]), " ".join(item.split()[:7])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in P.drop_contaminated(spark, docs, DIR).collect()} == {0, 3}
