"""The splittable scan against the reader that takes a file in one task."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from threadlake.sources import files
from threadlake.sources.quoted_csv import scan_csv

NAMES = files.RAW.replace(" string", "").split(", ")


def write(path, rows, end="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(NAMES)
        out.writerows(rows)


def made(n, seed):
    rng = random.Random(seed)
    texts = ["plain", 'say ""hi""', "two\nlines", '"\n"\n"', "a,b\n\n,c", "", "ü €\n\"quoted\"", "x" * 300, 'ends with "', "\n\n\n"]
    return [(i, f"u{i % 7}", i % 2 == 0, "Tue Oct 31 22:10:47 +0000 2017", "".join(rng.choice(texts) for _ in range(rng.randrange(1, 4))), "", i - 1) for i in range(n)]


def old(spark, path):
    return spark.read.schema(files.RAW).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_equal_one(spark, tmp_path, small_splits, end):
    path = f"{tmp_path}/raw.csv"
    write(path, made(400, 1), end)
    text = spark.read.text(path)
    assert text.rdd.getNumPartitions() > 20
    got = scan_csv(spark, path, files.RAW)
    want = [tuple(r) for r in old(spark, path).collect()]
    assert [tuple(r)[:-1] for r in sorted(got.collect(), key=lambda r: r["_row"])] == want and len(want) == 400


def test_several_files_keep_their_order(spark, tmp_path, small_splits):
    for i in range(3):
        write(f"{tmp_path}/part-{i}.csv", made(60, i))
    got = sorted(scan_csv(spark, str(tmp_path), files.RAW).collect(), key=lambda r: r["_row"])
    assert len(got) == 180
    for i in range(3):
        assert [tuple(r)[:-1] for r in got[60 * i : 60 * i + 60]] == [tuple(r) for r in old(spark, f"{tmp_path}/part-{i}.csv").collect()]


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text(",".join(NAMES) + "\n")
    (tmp_path / "open.csv").write_text(",".join(NAMES) + '\n1,a,True,x,ok,,\n2,a,True,x,"never\nclosed,,\n3,b,True,x,t,,\n')
    (tmp_path / "short.csv").write_text(",".join(NAMES) + "\n1,a\n\n2,b,True,x,t,,1,more\n")
    count = {p: scan_csv(spark, f"{tmp_path}/{p}.csv", files.RAW).count() for p in ("empty", "header", "open", "short")}
    assert count == {"empty": 0, "header": 0, "open": 2, "short": 2}


def test_long_record_over_many_splits(spark, tmp_path, small_splits):
    path = f"{tmp_path}/raw.csv"
    rows = [(1, "a", True, "x", "line\n" * 3000, "", ""), (2, "b", True, "x", "t", "", "")]
    write(path, rows)
    got = {r["tweet_id"]: r["text"] for r in scan_csv(spark, path, files.RAW).collect()}
    assert got == {"1": "line\n" * 3000, "2": "t"}


def test_first_copy_in_file_order(spark, tmp_path, small_splits):
    from threadlake.operators.threads import keep_first

    path = f"{tmp_path}/raw.csv"
    write(path, [(i % 50, f"copy{i // 50}", True, "x", "t\nu", "", "") for i in range(200)])
    first = keep_first(files.scan_messages(spark, path), "tweet_id", ["_row"])
    assert first.count() == 50 and first.where(F.col("author_id") != "copy0").count() == 0
