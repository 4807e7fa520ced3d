"""Intent discovery: first training turns, vectors, k sweep, clusters, representatives, labels, taxonomy proposal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import numbered
from threadlake.operators import clustering
from threadlake.operators.sampling import uniform
from threadlake.operators.threads import first_turns
from threadlake.session import Scratch
from threadlake.sources.files import audit_json, taxonomy_json

PROMPT = "Below are {n} customer messages that lie close to each other in embedding space.\n\n{messages}\n\nWhat do their writers want? Answer as a JSON object with two strings: label, in snake_case and at most three words long, and description, a single sentence."


def discover(messages: DataFrame, embed: Callable[[DataFrame], DataFrame], complete: Callable[[Column], Column], ks: list[int], seed: int = 0, sample: int | None = 15_000, k: int | None = None, shown: int = 12) -> dict[str, DataFrame]:
    """Tables ``sweep``, ``flags``, ``clusters``, ``warnings``, ``taxonomy`` and ``audit``. ``embed`` adds a unit vector column ``embedding`` to (tweet_id, text)."""
    scratch = Scratch(messages.sparkSession, "discover")
    firsts = first_turns(messages, training=True).select("tweet_id", F.col("text_scrubbed").alias("text"))
    firsts = firsts if sample is None else uniform(firsts, sample, seed, "tweet_id")
    vectors = scratch.table(embed(firsts), "vectors")
    sweep = clustering.sweep_k(vectors, ks, seed, id_col="tweet_id")
    chosen = k if k is not None else clustering.best_k(sweep).first()["k"]
    placed = scratch.table(clustering.assign(vectors, clustering.fit(vectors, chosen, seed)), "placed")
    top = clustering.representatives(placed, shown, id_col="tweet_id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    shown_rows = top.groupBy(F.col("cluster").alias("cluster_id")).agg(texts.alias("representatives"))
    body = F.replace(F.replace(F.lit(PROMPT), F.lit("{n}"), F.size("representatives").cast("string")), F.lit("{messages}"), numbered(F.col("representatives")))
    labelled = clustering.label_clusters(shown_rows.select("cluster_id", body.alias("prompt")), complete)
    size = clustering.sizes(placed).select(F.col("cluster").alias("cluster_id"), F.col("n").alias("size"))
    clusters = scratch.table(labelled.join(size, "cluster_id").join(shown_rows, "cluster_id"), "clusters")
    return {"sweep": sweep, "flags": clustering.sweep_flags(sweep), "clusters": clusters, "warnings": clustering.label_warnings(clusters, ks, chosen), "taxonomy": taxonomy_json(clusters), "audit": audit_json(clusters, sweep)}
