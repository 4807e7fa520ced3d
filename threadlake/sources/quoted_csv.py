"""A splittable scan of CSV files with quoted line ends.

Whether a line begins inside quotes is known from all quotes before it in its file. Each split of a file is read as plain lines by a task of its own, which counts quotes from the split's
beginning on; the splits' totals, one row each, are summed over the splits before, and tell every line the parity at which it really begins. A record begins at a
line of even parity and goes on up to the line that closes its quotes. Records of one line, by far the most, are parsed where they are read; only lines of longer ones are shuffled, by
the place where their record begins, also across splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "file string, block long, n long, line string, quoted boolean, odd boolean, start0 long, start1 long"


def _count_quotes(batches):
    """The lines of a task, which come in the order of their file split by split: the line's number in its split, whether the quotes of its split before it are odd, whether its own are, and the last line
    at or before it that begins a record if the split begins outside (start0) or inside (start1) quotes, -1 where it is in a split before."""
    key, n, odd, last = None, 0, 0, [-1, -1]
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, lines = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2)
        quotes = pc.fill_null(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        numbers, before, starts = np.empty(len(quotes), np.int64), np.empty(len(quotes), np.int64), [np.empty(len(quotes), np.int64) for _ in range(2)]
        for lo, hi in zip([0, *cuts], [*cuts, len(quotes)], strict=True):
            if (files[lo], blocks[lo]) != key:
                key, n, odd, last = (files[lo], blocks[lo]), 0, 0, [-1, -1]
            numbers[lo:hi] = np.arange(n, n + hi - lo)
            sums = odd + np.cumsum(quotes[lo:hi])
            before[lo:hi] = (sums - quotes[lo:hi]) % 2
            for p in range(2):
                begins = np.where(before[lo:hi] == p, numbers[lo:hi], -1)
                starts[p][lo:hi] = np.maximum(np.maximum.accumulate(begins), last[p])
                last[p] = int(starts[p][hi - 1])
            n, odd = n + hi - lo, int(sums[-1] % 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(numbers), lines, pa.array(before == 1), pa.array(quotes % 2 == 1), *[pa.array(x) for x in starts]],
            ["file", "block", "n", "line", "quoted", "odd", "start0", "start1"],
        )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, line, quoted, odd, start0, start1) of all lines, cut at \\n only."""
    text = spark.read.option("lineSep", "\n").text(path)
    at = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return at.mapInArrow(_count_quotes, LINE)


def split_facts(rows: DataFrame) -> DataFrame:
    """(file, block, inside, from_block, from_n): whether a split begins inside quotes, and where the record that is open at its beginning begins. A row per split."""
    each = rows.groupBy("file", "block").agg(F.sum(F.col("odd").cast("int")).alias("odd"), F.max("start0").alias("last0"), F.max("start1").alias("last1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = each.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    last = F.when(F.col("inside"), F.col("last1")).otherwise(F.col("last0"))
    known = known.withColumn("open", F.last(F.when(last >= 0, F.struct("block", last.alias("n"))), ignorenulls=True).over(before))
    return known.select("file", "block", "inside", F.col("open.block").alias("from_block"), F.col("open.n").alias("from_n"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, record): each record's text, and the file, split and line where it begins."""
    rows = lines(spark, path)
    known = rows.join(split_facts(rows), ["file", "block"])
    quoted = F.col("quoted") != F.col("inside")
    known = known.withColumn("begins", ~quoted).withColumn("ends", quoted == F.col("odd")).withColumn("start", F.when(F.col("inside"), F.col("start1")).otherwise(F.col("start0")))
    whole = known.where("begins AND ends").select("file", "block", "n", F.col("line").alias("record"))
    here = F.col("start") >= 0
    part = known.where("NOT (begins AND ends)").select("file", F.when(here, F.col("block")).otherwise(F.col("from_block")).alias("b0"), F.when(here, F.col("start")).otherwise(F.col("from_n")).alias("n0"), F.struct("block", "n", "line").alias("l"))
    joined = part.groupBy("file", "b0", "n0").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("record"))
    return whole.unionByName(joined.select("file", F.col("b0").alias("block"), F.col("n0").alias("n"), "record"))


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` by place, and ``_row``, a struct that orders the records as in the files. Each file has a header; blank records are left out, and a quote that is never closed makes the rest of its
    file one record."""
    rows = records(spark, path).where(~((F.col("block") == 0) & (F.col("n") == 0)))
    text = F.regexp_replace("record", "\r$", "")
    rows = rows.select("file", "block", "n", text.alias("record")).where(F.trim("record") != "")
    parsed = rows.select(F.from_csv("record", schema, {"escape": '"', "maxCharsPerColumn": "-1"}).alias("r"), F.struct("file", "block", "n").alias("_row"))
    return parsed.select("r.*", "_row")
