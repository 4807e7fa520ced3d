"""The golden set: draw two strata from the evaluation window, attach replies, compile with the label log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.records import latest_per_key, override
from threadlake.operators.sampling import two_strata
from threadlake.operators.threads import attach_reference_replies, first_turns


def golden_sample(messages: DataFrame, brand: str, n_a: int = 100, n_b: int = 100, seed: int = 20260909) -> DataFrame:
    """Rows of the label log's schema, still unlabelled."""
    pool = first_turns(messages, training=False)
    drawn = attach_reference_replies(two_strata(pool, n_a, n_b, seed), messages, brand)
    empty = lambda kind: F.lit(None).cast(kind)
    return drawn.select(
        "tweet_id", "thread_id", F.col("text_scrubbed").alias("text"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss'+00:00'").alias("created_at"), "stratum", "sample_reason", "reference_reply",
        empty("string").alias("label_intent"), empty("string").alias("label_action"), empty("string").alias("label_reason"), empty("boolean").alias("reference_is_good"), F.lit("").alias("notes"),
    )


def compiled(sample: DataFrame, log: DataFrame, seq: str = "seq") -> DataFrame:
    """The sample with the latest label record of each message in its place."""
    return override(sample, latest_per_key(log, "tweet_id", seq).select(*sample.columns))
