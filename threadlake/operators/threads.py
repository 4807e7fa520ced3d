"""Message-log operators: keep-first dedupe (W3), multi-part merge (G3), time split (A2), first turns (W1, W2), reference replies (J4), QA on the split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import has_part_suffix, strip_part_suffix
from threadlake.operators.selection import exact_quantile
from threadlake.session import Scratch


def is_true(value: Column) -> Column:
    """A loosely stored boolean: true, True, 1."""
    return F.lower(value.cast("string")).isin("true", "1")


def keep_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key. Ordered rows make it deterministic, which ``dropDuplicates`` is not."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_turns(messages: DataFrame, training: bool | None = None, pick: Column | None = None) -> DataFrame:
    """The first customer message of each thread, whole rows; ``training`` filters the window before the pick, ``pick`` replaces the customer predicate."""
    rows = messages.where(is_true(F.col("inbound")) if pick is None else pick)
    if training is not None:
        rows = rows.where(F.col("in_training_window") if training else ~F.col("in_training_window"))
    return keep_first(rows, "thread_id", ["created_at", "tweet_id"])


def first_replies(messages: DataFrame, brand: str) -> DataFrame:
    """(thread_id, reference_reply): the brand's earliest message of each thread, whether before or after the customer's."""
    found = first_turns(messages, pick=F.col("author_id") == brand)
    return found.select("thread_id", F.col("text_scrubbed").alias("reference_reply"))


def attach_reference_replies(sample: DataFrame, messages: DataFrame, brand: str) -> DataFrame:
    return sample.join(first_replies(messages, brand), "thread_id", "left")


def split_instant(messages: DataFrame, train_share: float = 0.7, ts_col: str = "created_at") -> DataFrame:
    """One row: the exact, linearly interpolated quantile of the timestamps, in microseconds, by distributed selection."""
    return exact_quantile(messages.select(F.unix_micros(F.col(ts_col).cast("timestamp")).alias("us")), "us", train_share)


def assign_time_split(messages: DataFrame, train_share: float = 0.7, ts_col: str = "created_at") -> DataFrame:
    """Adds ``in_training_window``: rows up to the quantile. The split is by row, so a thread may straddle it."""
    cut = split_instant(messages, train_share, ts_col)  # one row
    return messages.crossJoin(F.broadcast(cut)).withColumn("in_training_window", F.unix_micros(F.col(ts_col).cast("timestamp")) <= F.col("cut")).drop("cut")


def straddling_threads(messages: DataFrame) -> DataFrame:
    """(thread_id, n_train, n_eval) of threads with rows on both sides of the cut."""
    n = messages.groupBy("thread_id").agg(F.count_if("in_training_window").alias("n_train"), F.count_if(~F.col("in_training_window")).alias("n_eval"))
    return n.where("n_train > 0 AND n_eval > 0")


def duplicate_ids(rows: DataFrame, key: str = "tweet_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def part_links(messages: DataFrame, brand: str) -> DataFrame:
    """(cid, pid): the brand's continuation of a brand message that ends in a part mark; of several the earliest counts."""
    parts = messages.where((F.col("author_id") == brand) & has_part_suffix(F.col("text"))).select(F.col("tweet_id").alias("pid"))
    own = messages.where(F.col("author_id") == brand).select(F.col("tweet_id").alias("cid"), F.col("in_response_to_tweet_id").alias("pid"), "created_at")
    links = own.join(parts, "pid").where("cid <> pid")
    return keep_first(links, "pid", ["created_at", "cid"]).select("cid", "pid")


def chain_places(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, head, place) of every member of a chain, heads at place 0, by pointer doubling; members of link cycles are left out.

    ``links``: (cid, pid), paths in which each id has at most one link either way.
    """
    ids = links.select(F.col("cid").alias("id")).union(links.select(F.col("pid").alias("id"))).distinct()
    cur = ids.join(links.withColumnRenamed("cid", "id"), "id", "left").select("id", F.coalesce("pid", "id").alias("head"), F.when(F.col("pid").isNull(), 0).otherwise(1).cast("long").alias("place"))
    cur, n = scratch.table(cur, "chain-0"), 0
    size = cur.count()
    while 2**n <= max(1, size):
        far = cur.select(F.col("id").alias("head"), F.col("head").alias("head2"), F.col("place").alias("place2"))
        nxt = scratch.table(cur.join(far, "head").select("id", F.col("head2").alias("head"), (F.col("place") + F.col("place2")).alias("place")), f"chain-{n + 1}")
        scratch.drop(f"chain-{n}")
        same = nxt.join(nxt.where("place = 0").select(F.col("id").alias("head")), "head", "left_anti").limit(1).count() == 0
        cur, n = nxt, n + 1
        if same:
            break
    heads = cur.where("place = 0").select(F.col("id").alias("head"))
    return cur.join(heads, "head", "left_semi")


def merge_parts(messages: DataFrame, brand: str) -> DataFrame:
    """Chains of multi-part replies become their last row, with the head's parent and all texts in order, part marks stripped but for the last.

    Raises ValueError on repeated ids. Links inside a cycle are ignored. A reply to a merged part is left as it is.
    """
    if duplicate_ids(messages).limit(1).count():
        raise ValueError("tweet_id repeats")
    scratch = Scratch(messages.sparkSession, "merge")
    links = scratch.table(part_links(messages, brand), "links")
    places = scratch.table(chain_places(links, scratch), "places")
    parts = places.join(messages.select(F.col("tweet_id").alias("id"), F.col("text").alias("t"), F.col("in_response_to_tweet_id").alias("up")), "id")
    last = Window.partitionBy("head")
    parts = parts.withColumn("final", F.max("place").over(last))
    piece = F.when(F.col("place") < F.col("final"), strip_part_suffix(F.coalesce("t", F.lit("")))).otherwise(F.coalesce("t", F.lit("")))
    merged = parts.groupBy("head").agg(
        F.max_by("id", "place").alias("tweet_id"), F.min_by("up", "place").alias("_up"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("t")))), lambda x: x["t"]), " ")).alias("_text"),
    ).drop("head")
    gone = places.join(merged.select(F.col("tweet_id").alias("id")), "id", "left_anti").select(F.col("id").alias("tweet_id"))
    rows = messages.join(gone, "tweet_id", "left_anti").join(merged, "tweet_id", "left")
    hit = F.col("_text").isNotNull()
    rows = rows.withColumn("text", F.when(hit, F.col("_text")).otherwise(F.col("text"))).withColumn("in_response_to_tweet_id", F.when(hit, F.col("_up")).otherwise(F.col("in_response_to_tweet_id")))
    return rows.select(*messages.columns)
