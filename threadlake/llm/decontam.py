"""Benchmark decontamination. DataFrame operations only.

The benchmark's word windows form a hash set that is broadcast (its size is checked). Every document is scanned as an array of words; the hashes of its
windows are looked up, hits are verified on the words themselves, and the hit words, or contaminated documents, can be removed. A set
beyond ``BROADCAST_WINDOWS`` no longer travels in the plan: window hashes, not words, are then joined with it (by a broadcast up to
``BROADCAST_HASHES``, by a shuffle beyond), and only documents with a hit are read again for their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.line_dedup import ascii_lower, free_name
from threadlake.session import Scratch

BROADCAST_WINDOWS = 50_000  # windows in the broadcast set at most; their hashes travel in the plan, 8 bytes each
BROADCAST_HASHES = 1_000_000  # hashes and lengths that a join broadcasts at most (12 MB)
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and all that is not ASCII; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NO_WORD, -1), lambda w: w != "")


def window_hash(w: Column, at: Column, length: int) -> Column:
    """The hash of ``length`` words from ``at``, counted from 0. Words are taken one by one: a slice would copy the whole array each time."""
    return F.xxhash64(*[F.get(w, at + k) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(hash, window, len, items): each distinct window once, with the sorted ids, as strings, of the items that have it."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
    each = items.select("item", F.least(n, F.lit(size)).alias("len"), F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    hashed = F.lit(None).cast("long")
    for length in range(1, size + 1):
        hashed = F.when(F.col("len") == length, window_hash(F.col("window"), F.lit(0), length)).otherwise(hashed)
    return each.groupBy("window", "len").agg(F.array_sort(F.collect_set("item")).alias("items")).select(hashed.alias("hash"), "window", "len", "items")


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, broadcast_limit: int = BROADCAST_WINDOWS, hash_limit: int = BROADCAST_HASHES) -> DataFrame:
    """(id, n_words, hits, items) per distinct id of ``docs``: the sorted places, from 0, of hit words, and the sorted item ids.

    A window is ``size`` consecutive words of an item, or all words of a shorter one; an item without words has none. A document word in
    any occurrence of a window is hit. A null or empty text has no words. Rows that repeat an id are one document to this
    scan (the most words, all hits); a null id is an id of its own. Empty tables are fine.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    windows = scratch.table(benchmark_windows(benchmark, item_col, item_text_col, size), "windows")
    lengths = [r["len"] for r in windows.select("len").distinct().collect()]  # at most ``size`` values
    few = windows.limit(broadcast_limit + 1).count() <= broadcast_limit
    known: dict[int, list[int]] = {n: [] for n in lengths}
    for r in windows.select("len", "hash").distinct().collect() if few else ():
        known[r["len"]].append(r["hash"])

    base = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    starts = lambda length: F.when(F.size("w") >= length, F.sequence(F.lit(0), F.size("w") - length)).otherwise(F.array().cast("array<int>"))

    def place(i: Column, length: int) -> Column:
        return F.struct(i.alias("at"), F.lit(length).alias("len"), window_hash(F.col("w"), i, length).alias("hash"))

    def with_words(i: Column, length: int) -> Column:
        return place(i, length).withField("window", F.array(*[F.get("w", i + k) for k in range(length)]))

    def looked_up(length: int) -> Column:
        return F.transform(F.filter(starts(length), lambda i: window_hash(F.col("w"), i, length).isin(known[length])), lambda i: with_words(i, length))

    def hashed(length: int) -> Column:
        return F.transform(starts(length), lambda i: place(i, length))

    # one place of length 0 stands for the document itself; its hash only spreads the rows
    itself = F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.xxhash64("id").alias("hash"), F.array().cast("array<string>").alias("window"))
    if few:
        hits = [looked_up(n) for n in lengths]
        each = base.select("id", F.size("w").alias("n_words"), F.explode(F.concat(F.array(itself), *hits)).alias("p")).select("id", "n_words", "p.*")
    else:
        hashes = scratch.table(windows.select("len", "hash").distinct(), "hashes")
        small = hashes.limit(hash_limit + 1).count() <= hash_limit
        every = base.select("id", F.explode(F.concat(*[hashed(n) for n in lengths])).alias("p")).select("id", "p.at", "p.len", "p.hash")
        seen = every.join(F.broadcast(hashes) if small else hashes, ["len", "hash"]).select("id", "len", "at").distinct()
        seen = scratch.table(seen.groupBy("id").agg(F.collect_list(F.struct("len", "at")).alias("seen")).select(F.col("id").alias("_id"), "seen"), "seen")
        again = base.join(seen, F.col("id").eqNullSafe(F.col("_id"))).select("id", F.size("w").alias("n_words"), "w", F.explode("seen").alias("s"))
        # a row that repeats an id may be shorter than the one that was hit
        again = again.where(F.col("s.at") + F.col("s.len") <= F.col("n_words"))
        chosen = F.coalesce(*[F.when(F.col("s.len") == n, with_words(F.col("s.at"), n)) for n in lengths])
        again = again.select("id", "n_words", chosen.alias("p")).select("id", "n_words", "p.*")
        each = base.select("id", F.size("w").alias("n_words"), itself.alias("p")).select("id", "n_words", "p.*").unionByName(again)
    # verified on the words
    found = windows.select("hash", "len", "window", "items")
    met = each.join(F.broadcast(found) if few else found, ["hash", "len", "window"], "left").where("len = 0 OR items IS NOT NULL")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.when(F.col("len") > 0, F.struct("at", "len"))), lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))
    return met.groupBy("id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        covered.alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def contaminated(found: DataFrame, at_least: int = 2) -> DataFrame:
    return found.withColumn("contaminated", F.size("items") >= at_least)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", at_least: int = 2, **options) -> DataFrame:
    """``docs`` without those that hold windows of ``at_least`` items; all columns, of any names, and all other rows as they were.

    Whole texts are scanned. A null or empty text holds none and stays. Rows that repeat an id are one document, so that all of them go or stay, and so are rows
    with a null id. Empty tables are fine: without items all stay.
    """
    id_ = free_name("_id", docs.columns)
    bad = contaminated(scan(docs, benchmark, id_col, **options), at_least).where("contaminated").select(F.col("id").alias(id_))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(id_)), "left_anti")


def drop_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``text_col`` rebuilt without the hit words: the words that stay, as they were scanned, joined by a blank. Documents without a hit keep their text, null
    ones too; other columns of any names stay. Rows that repeat an id lose the places hit in any of them."""
    id_, hits_ = free_name("_id", docs.columns), free_name("_hits", docs.columns)
    hit = scan(docs, benchmark, id_col, text_col, **options).where(F.size("hits") > 0).select(F.col("id").alias(id_), F.col("hits").alias(hits_))
    out = docs.join(hit, F.col(id_col).eqNullSafe(F.col(id_)), "left")
    stay = F.filter(F.transform(words(F.col(text_col)), lambda w, i: F.when(~F.array_contains(F.col(hits_), i), w)), lambda w: w.isNotNull())
    return out.withColumn(text_col, F.when(F.col(hits_).isNull(), F.col(text_col)).otherwise(F.array_join(stay, " "))).drop(id_, hits_)
