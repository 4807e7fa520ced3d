"""Taxonomy tables: validation (V1-V9), tiers (J6, P10, L6), shares (A7), prompt block (A14), prevalence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import is_snake_case

SCHEMA = "label string, description string, source string, risk_tier string, approx_share double, note string"
TIERS = ("auto_ok", "review", "always_escalate")
SOURCES = ("cluster", "keyword")
ACTIONS = ("auto", "escalate")
# Why a message is escalated.
REASONS = ("high_risk_intent", "needs_account_access", "policy_or_compensation", "angry_or_repeat_contact", "ambiguous_request", "other")

# The curated intents, with their tiers and shares.
CURATED = [
    ("praise_thanks", "The writer is pleased with what was done and asks for nothing.", "cluster", "auto_ok", 0.200),
    ("travel_excitement", "Looking forward to a journey; nothing is asked for.", "cluster", "auto_ok", 0.101),
    ("flight_disruption", "A flight is late, cancelled, held on the ground, or a connection was lost.", "cluster", "review", 0.351),
    ("service_complaint", "Anger at how staff behave or that nobody answers, without a concrete wish.", "cluster", "review", 0.181),
    ("fees_and_charges", "A charge for a change, a bag or something unforeseen is contested.", "cluster", "review", 0.091),
    ("baggage_issue", "A bag is missing, late or broken, or had to be checked at the gate.", "cluster", "review", 0.075),
    ("refund_or_compensation", "Money, a voucher or amends are asked for.", "keyword", "always_escalate", 0.031),
    ("booking_change", "A booking is to be moved to another time or called off.", "keyword", "review", 0.048),
    ("seat_or_upgrade", "About which seat one has, another seat or a better class.", "keyword", "review", 0.081),
    ("checkin_boarding", "Check-in doesn't work, or a boarding pass or gate is in question.", "keyword", "review", 0.083),
    ("loyalty_miles", "About points, status or the member's account.", "keyword", "review", 0.023),
    ("accessibility_medical", "Help because of a disability, an illness or a wheelchair.", "keyword", "always_escalate", 0.005),
    ("other", "None of the intents above.", "cluster", "review", None),
]


def curated(spark) -> DataFrame:
    return spark.createDataFrame([(*r, None) for r in CURATED], SCHEMA)


def violations(intents: DataFrame) -> DataFrame:
    """(rule, detail) for all that is wrong; an empty result means valid."""
    one = lambda rule, rows, detail: rows.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    total = intents.agg(F.count("*").alias("n"), F.count_if(F.col("label") == "other").alias("others"))
    parts = [
        one("repeated_label", intents.groupBy("label").agg(F.count("*").alias("n")).where("n > 1"), F.col("label")),
        one("no_other", total.where("others = 0"), F.col("others")),
        one("too_few", total.where("n < 2"), F.col("n")),
        one("not_snake_case", intents.where(~F.coalesce(is_snake_case(F.col("label")), F.lit(False))), F.col("label")),
        one("unknown_tier", intents.where(~F.coalesce(F.col("risk_tier").isin(*TIERS), F.lit(False))), F.col("label")),
        one("unknown_source", intents.where(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))), F.col("label")),
    ]
    return reduce(DataFrame.unionByName, parts)


def share_violations(intents: DataFrame, within: float = 0.03) -> DataFrame:
    """(rule, detail) for wrong shares: one outside 0 to 1, or an intent other than ``other`` without one; cluster shares that don't sum to 1 within ``within``, as they are a partition (V7);
    keyword shares that sum to 1 or more, as they overlap on a denominator of their own and must not pass for a partition (V8); and a listing of both whose shares sum to 1 or less, so that it would
    pass for one (V9). Without shares at all nothing is wrong."""
    share = F.col("approx_share")
    given = intents.where(share.isNotNull())
    of = lambda source: F.round(F.sum(F.when(F.col("source") == source, share)), 6)
    sums = given.agg(of("cluster").alias("cluster"), of("keyword").alias("keyword"), F.round(F.sum(F.when(F.col("source").isin(*SOURCES), share)), 6).alias("both"))  # one row
    missing = intents.where(share.isNull() & (F.col("label") != "other")).crossJoin(F.broadcast(given.agg((F.count("*") > 0).alias("any")))).where("any")
    rule = lambda name, rows, detail: rows.select(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))
    parts = [
        rule("share_out_of_range", given.where((share < 0) | (share > 1)), F.col("label")),
        rule("no_share", missing, F.col("label")),
        rule("cluster_shares_sum", sums.where(F.abs(F.round(F.col("cluster") - 1, 6)) > within), F.col("cluster")),
        rule("keyword_shares_sum", sums.where("keyword >= 1"), F.col("keyword")),
        rule("all_shares_sum", sums.where("cluster IS NOT NULL AND keyword IS NOT NULL AND both <= 1"), F.col("both")),
    ]
    return reduce(DataFrame.unionByName, parts)


def shares(intents: DataFrame) -> DataFrame:
    """(source, n, share) summed per source; cluster shares are a partition, keyword shares overlap."""
    return intents.groupBy("source").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("approx_share"), F.lit(0.0)), 6).alias("share"))


def with_tier(rows: DataFrame, intents: DataFrame, intent_col: str = "label_intent") -> DataFrame:
    """Adds ``risk_tier``; an intent that the taxonomy lacks raises. The taxonomy is a hand-made table and broadcast."""
    known = F.broadcast(intents.select(F.col("label").alias("_label"), "risk_tier"))
    out = rows.join(known, F.col(intent_col) == F.col("_label"), "left")
    bad = F.col(intent_col).isNotNull() & F.col("_label").isNull()
    return out.withColumn("risk_tier", F.when(bad, F.raise_error(F.concat(F.lit("unknown intent: "), F.col(intent_col))).cast("string")).otherwise(F.col("risk_tier"))).drop("_label")


def action(chosen: Column, tier: Column) -> Column:
    """The label's action: an intent that always escalates does so whatever was chosen."""
    return F.when(tier == "always_escalate", F.lit("escalate")).otherwise(chosen)


def label_violations(labels: DataFrame, intents: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """(rule, id) of label records that break a rule (L6): an intent that the taxonomy lacks, an action that there isn't, an intent that always escalates without it, an escalation without a reason
    or with one that there isn't, a reason without an escalation. Records without intent and action aren't labelled yet and break none."""
    known = F.broadcast(intents.select(F.col("label").alias("_label"), F.col("risk_tier").alias("_tier")))  # a hand-made table
    rows = labels.where(F.col("label_intent").isNotNull() | F.col("label_action").isNotNull()).join(known, F.col("label_intent") == F.col("_label"), "left")
    reason, escalated = F.coalesce("label_reason", F.lit("")), F.coalesce(F.col("label_action") == "escalate", F.lit(False))
    rules = {
        "unknown_intent": F.col("label_intent").isNotNull() & F.col("_label").isNull(),
        "unknown_action": F.col("label_action").isNotNull() & ~F.col("label_action").isin(*ACTIONS),
        "not_escalated": (F.col("_tier") == "always_escalate") & ~escalated,
        "no_reason": escalated & (reason == ""),
        "unknown_reason": escalated & (reason != "") & ~reason.isin(*REASONS),
        "reason_without_escalation": ~escalated & (reason != ""),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for name, wrong in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.col(id_col).alias("id"))


def view(intents: DataFrame) -> DataFrame:
    """(label, tier, source, share, description) to be read by people (L7): shares in percent with one place, a dash where there is none."""
    share = F.when(F.col("approx_share").isNull(), F.lit("-")).otherwise(F.format_string("%.1f%%", F.col("approx_share") * 100))
    return intents.select("label", F.col("risk_tier").alias("tier"), "source", share.alias("share"), "description")


def summary(intents: DataFrame) -> DataFrame:
    """One row below the view: (intents, cluster_total, always_escalate)."""
    always = F.array_join(F.array_sort(F.collect_list(F.when(F.col("risk_tier") == "always_escalate", F.col("label")))), ", ")
    total = F.coalesce(F.sum(F.when(F.col("source") == "cluster", F.col("approx_share"))), F.lit(0.0))
    return intents.agg(F.count("*").alias("intents"), F.format_string("%.1f%%", total * 100).alias("cluster_total"), always.alias("always_escalate"))


def always_escalate(intents: DataFrame) -> DataFrame:
    return intents.where(F.col("risk_tier") == "always_escalate").select("label")


def prompt_block(intents: DataFrame) -> DataFrame:
    """One row: the lines ``- label: description`` in label order."""
    pair = F.array_sort(F.collect_list(F.struct("label", "description")))
    return intents.agg(F.array_join(F.transform(pair, lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["description"])), "\n").alias("block"))


def prevalence(rows: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """(bucket, n, share) of each pattern over all rows, in one scan. The shares overlap."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(low.rlike(f"(?U){p}")).alias(name) for name, p in patterns.items()])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("bucket"), F.col(name).alias("n")) for name in patterns]))
    return counts.select("total", each.alias("b")).select("b.bucket", "b.n", F.round(F.col("b.n") / F.greatest("total", F.lit(1)), 6).alias("share"))
