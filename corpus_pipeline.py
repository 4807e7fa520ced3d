"""The training-data pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next stage's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import decontam, line_dedup, near_dedup, packing, toxicity
from threadlake.session import Scratch, table


SIMILAR = 80  # percent of shared five-word shingles that makes two documents of the pipeline near copies; op4's query has a threshold of its own


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go, all others stay as they are. A null or empty text scores as one without words; repeated rows go or stay together;
    null ids and columns of other names are like any others; an empty table gives an empty one."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines all repeat elsewhere stay, with the text that is left; n_chars follows the text. A null text becomes empty; rows with a null id keep
    their lines; rows that repeat an id are one document; an empty table gives an empty one."""
    out = line_dedup.dedup_lines(docs)
    dropped = line_dedup.free_name("_dropped", docs.columns)
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least id stays. Null and empty texts, which are like nothing, and null ids stay; of rows that repeat an id all stay or go; an
    empty table gives an empty one."""
    return near_dedup.keep_one(docs, percent=SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that holds a window of any benchmark item goes; that two items are needed is the flag of op7 alone. Null and empty texts stay; rows that
    repeat an id, a null one too, go or stay together; an empty table gives an empty one."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), at_least=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed. A null text is an empty one, of one token; null and repeated ids are packed like any others; an empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL can't express the classifier, the tokeniser and the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
