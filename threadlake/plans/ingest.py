"""From the raw log to the brand's slice: scan, connect, dedupe, merge, thread, split, scrub; and the counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.text import scrub
from threadlake.operators.graph import brand_connected_ids, thread_roots
from threadlake.operators.threads import assign_time_split, keep_first, merge_parts
from threadlake.session import Scratch
from threadlake.sources.files import scan_index, scan_messages, write_sorted


def ingest(spark: SparkSession, csv_path: str, brand: str, train_share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(slice, counters); the slice's files are sorted by date. The first copy of an id in file order counts, and goes if its date can't be read; only then are rows without a date dropped."""
    scratch = Scratch(spark, "ingest")
    index = scan_index(spark, csv_path)
    keep = scratch.table(brand_connected_ids(index, brand).select(F.col("id").alias("tweet_id")), "keep")
    raw = scratch.table(scan_messages(spark, csv_path, keep), "raw")
    first = scratch.table(keep_first(raw, "tweet_id", ["_row"]).drop("_row"), "first")
    dated = scratch.table(first.where(F.col("created_at").isNotNull()), "dated")
    merged = scratch.table(merge_parts(dated, brand), "merged")
    threads = thread_roots(merged)
    rows = merged.join(threads.withColumnRenamed("id", "tweet_id"), "tweet_id")
    rows = assign_time_split(rows, train_share).withColumn("text_scrubbed", scrub(F.col("text"), (brand,)))
    write_sorted(rows, scratch.path("slice"), ["created_at", "tweet_id"])
    rows = spark.read.schema(rows.schema).parquet(scratch.path("slice"))
    counts = {"rows_read": index, "connected_ids": keep, "rows_kept": raw, "distinct_rows": first, "dated_rows": dated, "merged_rows": merged}
    stats = {k: v.count() for k, v in counts.items()}
    done = rows.agg(F.count_if("in_training_window").alias("t"), F.countDistinct("thread_id").alias("n")).first()
    counters = [
        ("total_rows", stats["rows_read"]), ("brand_connected_ids", stats["connected_ids"]), ("duplicates_dropped", stats["rows_kept"] - stats["distinct_rows"]), ("undated_dropped", stats["distinct_rows"] - stats["dated_rows"]),
        ("multipart_merged", stats["dated_rows"] - stats["merged_rows"]), ("rows", stats["merged_rows"]), ("threads", done["n"]), ("training_rows", done["t"]),
    ]
    return rows, spark.createDataFrame(counters, "counter string, n long")
