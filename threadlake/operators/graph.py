"""Graph operators over edge DataFrames: connected components, brand reachability (G1), thread roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each u has one v, and no vertex is on both sides."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every vertex of an edge, with component the least vertex that it reaches.

    Alternates large-star and small-star contraction until the edges are stars around the least vertices. Minima are
    aggregated map-side before they are joined back, so that a hub's neighbours never meet in one group. Each round is
    written to the shared folder. Self-loops and repeated edges are fine; null ends are dropped.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct()
    )
    e = scratch.table(e, "star-0")
    n = 0
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"large-{n}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"star-{n + 1}")
        scratch.drop(f"large-{n}", f"star-{n}")
        n += 1
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def reply_edges(messages: DataFrame, id_col: str = "tweet_id", parent_col: str = "in_response_to_tweet_id") -> DataFrame:
    """Child-parent edges; a cited parent is a vertex even where no row has it, and a message without a parent a loop."""
    return messages.select(F.col(id_col).alias("src"), F.coalesce(parent_col, id_col).alias("dst"))


def brand_connected_ids(messages: DataFrame, brand: str, id_col: str = "tweet_id", parent_col: str = "in_response_to_tweet_id", author_col: str = "author_id") -> DataFrame:
    """G1: (id, component) of all vertices, phantom parents included, in a component that holds a brand-authored row.

    Raises ValueError when the brand authored nothing.
    """
    if messages.where(F.col(author_col) == brand).limit(1).count() == 0:
        raise ValueError(f"no message by {brand!r}")
    edges = reply_edges(messages, id_col, parent_col)
    linked = connected_components(edges)
    alone = edges.select(F.col("src").alias("id")).distinct().join(linked.select("id"), "id", "left_anti")
    every = linked.unionByName(alone.select("id", F.col("id").alias("component")))
    own = messages.where(F.col(author_col) == brand).select(F.col(id_col).alias("id")).distinct()
    hit = every.join(own, "id", "left_semi").select("component").distinct()
    return every.join(hit, "component", "left_semi").select("id", "component")


def thread_roots(messages: DataFrame, id_col: str = "tweet_id", parent_col: str = "in_response_to_tweet_id") -> DataFrame:
    """(id, thread_id) by pointer doubling; a parent that is no row makes its child a root, a cycle's root is its least member.

    Every round joins the pointers to themselves, so depth n takes log2(n) rounds, until every pointer stands on a root. A round
    that brings no further row to its root proves that the rest leads into cycles; from then on only the rest is doubled, until each
    pointer has passed its whole cycle.
    """
    scratch = Scratch(messages.sparkSession, "roots")
    ids = messages.select(F.col(id_col).alias("id"), F.col(parent_col).alias("p"))
    have = ids.select(F.col("id").alias("p"), F.lit(True).alias("known")).distinct()
    nxt = F.when(F.col("known"), F.col("p")).otherwise(F.col("id"))
    cur = ids.join(have, "p", "left").select("id", nxt.alias("nxt"), F.col("id").alias("mn"), (nxt == F.col("id")).alias("ok"))
    cur, rounds, before, done = scratch.table(cur, "0"), 0, None, None
    while True:
        # where each pointer's own pointer leads, whether that is a root, and the least id from there on
        end = cur.select(F.col("id").alias("nxt"), F.col("nxt").alias("end"), F.col("mn").alias("end_mn"), F.col("ok").alias("end_ok"))
        met = cur.join(end, "nxt")
        left = met.where("NOT end_ok").count()
        if left == 0:
            found = met.select("id", F.col("end").alias("thread_id"))
            return found if done is None else done.unionByName(found)
        if done is None and left == before:
            done = met.where("end_ok").select("id", F.col("end").alias("thread_id"))
            cur = scratch.table(met.where("NOT end_ok").select("id", "nxt", "mn", "ok"), "cyclic")
            continue
        if done is not None and 2**rounds >= left:
            # nxt lies on the cycle, and the least of the hops from there covers the cycle
            return done.unionByName(met.select("id", F.col("end_mn").alias("thread_id")))
        before = left
        cur = scratch.table(met.select("id", F.col("end").alias("nxt"), F.least("mn", "end_mn").alias("mn"), (F.col("ok") | F.col("end_ok")).alias("ok")), str(rounds + 1))
        rounds += 1
