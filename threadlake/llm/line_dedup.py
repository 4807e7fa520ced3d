"""Line dedup by levelled sorted runs of line keys. DataFrame operations only.

A run is a table of (key, number of documents, largest document), bucketed and sorted by key, so that it is merge-joined as it lies, without a
shuffle. Documents come in batches. A batch's keys are merge-anti-joined with each run; what no run has is written as a run of level 0, so
that a key is in one run only, and the rest, which is far less, goes to a table of updates. When ``fan`` runs stand on a level they are
merged into one run of the next level, so that n batches leave O(log n) runs.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.session import Scratch

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16
RUN = "hi long, lo int, n_docs long, last_doc long"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same, faster, where a text is all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(lines: Column, least: int) -> Column:
    """For each line a struct (hi, lo), 96 bits of hash of its stripped lower-cased form; null where that is shorter than ``least``."""

    # one step per array: within one lambda each use of a value would compute it again
    bare = F.transform(lines, lambda x: F.when(F.length(x) >= least, F.btrim(x, F.lit(SPACE))))
    low = F.transform(bare, lambda x: F.when(F.length(x) >= least, ascii_lower(x)))
    return F.transform(low, lambda x: F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("hi"), F.hash(x).alias("lo"))))


class Runs:
    """The levelled runs, as bucketed tables in the shared folder, and the updates to their keys."""

    def __init__(self, scratch: Scratch, fan: int = 4):
        self.scratch, self.fan = scratch, fan
        self.spark = scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = self.updates = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def all(self) -> DataFrame | None:
        """Runs and updates."""
        out = self.runs()
        if self.updates:
            out.append(self.scratch.read("updates", RUN))
        return functools.reduce(DataFrame.unionByName, out) if out else None

    def totals(self) -> DataFrame | None:
        """Each key's total: of the run that has it and its updates, which alone are shuffled."""
        out = self.runs()
        if self.updates:
            more = self.merged(self.scratch.read("updates", RUN)).select("hi", "lo", F.col("n_docs").alias("n2"), F.col("last_doc").alias("l2"))
            more = self.scratch.table(more, "grown")
            out = [r.join(more.hint("merge"), ["hi", "lo"], "left").select("hi", "lo", (F.col("n_docs") + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "l2").alias("last_doc")) for r in out]
        return functools.reduce(DataFrame.unionByName, out) if out else None

    def _write(self, run: DataFrame, level: int) -> str:
        name = f"threadlake_run_{uuid.uuid4().hex}"
        self.made += 1
        run = run.select("hi", "lo", "n_docs", "last_doc").repartition(self.buckets, "hi", "lo").sortWithinPartitions("hi", "lo")
        run.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", self.scratch.path(name)).option("compression", "zstd").saveAsTable(name, format="parquet")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(*names)

    def drop(self) -> None:
        self._drop([name for level in self.levels for name in level])

    @staticmethod
    def merged(run: DataFrame) -> DataFrame:
        return run.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch, one row per key and document: what no run has makes a run, the rest are updates."""
        keys = batch.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        have = self.runs()
        if not have:
            self._write(keys, 0)
        else:
            fresh = self.scratch.table(keys, f"batch-{self.made}")
            new = fresh
            for run in have:
                new = new.join(run.hint("merge"), ["hi", "lo"], "left_anti")
            made = self.spark.table(self._write(new, 0))
            self.scratch.append(fresh.join(made.hint("merge"), ["hi", "lo"], "left_anti").select("hi", "lo", "n_docs", "last_doc"), "updates")
            self.updates += 1
            self.scratch.drop(f"batch-{self.made - 1}")
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                self.compact(level)

    def compact(self, level: int) -> None:
        """Merge a level's runs, which have no key in common, into one of the next."""
        names = self.levels[level]
        self.levels[level] = []
        self._write(functools.reduce(DataFrame.unionByName, [self.spark.table(n) for n in names]), level + 1)
        self._drop(names)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, in_docs: int = 5, batches: int = 4) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``, and two more columns, counts of lines: ``_lines`` and ``_dropped`` (with underscores behind them where
    ``docs`` has such columns, which stay as they are like all others).

    Texts are split at \\n. Lines whose key (stripped of white space at the ends, A-Z lower-cased) has at least ``least`` code points and is in
    at least ``in_docs`` documents go, except in the largest id that holds the key. A null or empty text is one empty line
    and becomes empty. A row with a null id counts for no key and keeps its lines. Rows that repeat an id are one document. An empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.array_distinct(F.filter(line_keys(lines, least), lambda k: k.isNotNull())).alias("keys"))
    held = held.where(F.size("keys") > 0).select("doc", F.explode("keys").alias("k")).select("doc", "k.hi", "k.lo")
    held = scratch.table(held, "held")
    runs = Runs(scratch)
    for b in range(batches):
        # rows that repeat an id fall in one batch, and count once
        runs.add(held.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b).distinct())
    often = scratch.table(runs.totals().where(F.col("n_docs") >= in_docs), "often")
    runs.drop()

    # a key may be in a third of all documents: both sides are salted. Spark doesn't see that the salted table is 16 times the one it is made of, and would broadcast it
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    keys = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = held.withColumn("salt", salt).join(keys.hint("merge"), ["hi", "lo", "salt"]).where("doc <> last_doc")
    doc_, gone_, kept_ = (free_name(n, docs.columns) for n in ("_doc", "_gone", "_kept"))
    lines_, dropped_ = (free_name(n, docs.columns) for n in ("_lines", "_dropped"))
    gone = gone.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias(gone_)).withColumnRenamed("doc", doc_)
    out = docs.join(gone, F.col(id_col).cast("long") == F.col(doc_), "left").drop(doc_)
    zipped = F.arrays_zip(lines.alias("line"), line_keys(lines, least).alias("key"))
    stay = F.transform(F.filter(zipped, lambda x: x["key"].isNull() | ~F.array_contains(F.col(gone_), x["key"])), lambda x: x["line"])
    kept = F.when(F.col(gone_).isNull(), lines).otherwise(stay)
    out = out.withColumn(kept_, kept).withColumn(lines_, F.size(lines)).withColumn(dropped_, F.col(lines_) - F.size(kept_))
    return out.withColumn(text_col, F.array_join(kept_, "\n")).drop(kept_, gone_)
