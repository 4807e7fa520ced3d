"""Scans and sinks: raw CSV (S1-S4), parquet (S5), JSON lines (S6, S7, S12), CSV out (S8), taxonomy JSON (S9), config (S10), embeddings (S11), frozen caches.

Deleting the raw file after an ingest (S14) is left to the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.sources.quoted_csv import scan_csv

RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string"
LABEL = "tweet_id long, thread_id long, text string, created_at string, stratum string, sample_reason string, reference_reply string, label_intent string, label_action string, label_reason string, reference_is_good boolean, notes string"
LABEL_REQUIRED = ["tweet_id", "thread_id", "text", "created_at", "stratum", "sample_reason"]
CACHE = "key string, provider string, model string, text string, prompt_tokens int, completion_tokens int, created_at string, latency_ms int"
CACHE_REQUIRED = [c.split()[0] for c in CACHE.split(", ")]


def to_long(value: Column) -> Column:
    """Numbers as pandas reads them, ``12.0`` too; anything else is null."""
    return F.coalesce(value.try_cast("long"), value.try_cast("double").try_cast("long"))


def parse_created_at(value: Column) -> Column:
    """``Tue Oct 31 22:10:47 +0000 2017``, else ISO 8601, else null. The weekday is cut, as its pattern letter is not supported."""
    return F.coalesce(F.try_to_timestamp(F.substring(value, 5, 1000), F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp(value))


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """All seven columns as strings, and ``_row`` that orders them as in the files; quoted line ends and doubled quotes are read, each file by as many tasks as it has splits."""
    return scan_csv(spark, path, RAW)


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """The narrow pass: three columns, so that the reader parses no others."""
    rows = scan_raw(spark, path).select("tweet_id", "author_id", "in_response_to_tweet_id")
    return rows.select(to_long(F.col("tweet_id")).alias("tweet_id"), "author_id", to_long(F.col("in_response_to_tweet_id")).alias("in_response_to_tweet_id"))


def scan_messages(spark: SparkSession, path: str, keep_ids: DataFrame | None = None) -> DataFrame:
    """The wide pass: typed rows, of the ids in ``keep_ids`` (tweet_id) where that is given."""
    rows = scan_raw(spark, path)
    typed = rows.select(
        to_long(F.col("tweet_id")).alias("tweet_id"), "author_id", "inbound", parse_created_at(F.col("created_at")).alias("created_at"),
        "text", "response_tweet_id", to_long(F.col("in_response_to_tweet_id")).alias("in_response_to_tweet_id"), "_row",
    )
    return typed if keep_ids is None else typed.join(keep_ids, "tweet_id", "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Records of a JSON-lines log; torn and blank lines, and records without a required field, are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in required)))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One file, for people to read; the rows are a hand-sized sample."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_sorted(rows: DataFrame, path: str, by: list[str], partitions: int | None = None) -> None:
    """Files whose ranges of ``by`` don't overlap, each sorted, so that files in the order of their names are the sorted table and readers prune by the least and greatest values. No task
    sorts more than its range; add a column that tells rows apart where many share a value, as equal rows fall in one range."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def file_ranges(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(file, n, lo, hi) of each file of a sorted table."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi"))


def freeze(spark: SparkSession, path: str, to: str, schema: str = CACHE) -> None:
    """Copy a log into gzip files."""
    spark.read.schema(schema).json(path).write.mode("overwrite").option("compression", "gzip").json(to)


def taxonomy_json(clusters: DataFrame) -> DataFrame:
    """One JSON text: the intents by cluster, then ``other``, and how many clusters there were. Columns: cluster_id, label, description, size."""
    intent = F.struct("cluster_id", "label", "description", "size")
    every = clusters.agg(F.array_sort(F.collect_list(intent)).alias("found"), F.count("*").alias("chosen_k"))
    other = F.array(F.struct(F.lit("other").alias("label"), F.lit("Does not fit any intent above.").alias("description"), F.lit(None).cast("int").alias("cluster_id")))
    intents = F.concat(F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["description"].alias("description"), x["cluster_id"].cast("int").alias("cluster_id"))), other)
    return every.select(F.to_json(F.struct(intents.alias("intents"), "chosen_k")).alias("taxonomy"))


def audit_json(clusters: DataFrame, sweep: DataFrame) -> DataFrame:
    """One JSON text that shows what a taxonomy comes from (S9): the sweep by k, how many clusters were chosen, and each cluster with its size, representatives and the model's raw answer. As many
    rows as there are k and clusters are brought together."""
    fields = [c for c in ("cluster_id", "label", "description", "size", "representatives", "raw", "cause") if c in clusters.columns]
    of_sweep = sweep.agg(F.array_sort(F.collect_list(F.struct("k", "silhouette", "inertia"))).alias("k_sweep"))
    of_clusters = clusters.agg(F.count("*").alias("chosen_k"), F.array_sort(F.collect_list(F.struct(*fields))).alias("clusters"))
    return of_sweep.crossJoin(F.broadcast(of_clusters)).select(F.to_json(F.struct("k_sweep", "chosen_k", "clusters")).alias("audit"))  # one row each


def write_taxonomy(clusters: DataFrame, sweep: DataFrame, path: str) -> None:
    """The proposal and its audit as two folders of a text file each, ``taxonomy`` and ``audit``."""
    for name, one in (("taxonomy", taxonomy_json(clusters)), ("audit", audit_json(clusters, sweep))):
        one.coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def load_config(path: str) -> dict:
    """A JSON file, or YAML where that library is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


CONFIG = {"project": dict, "providers": dict, "roles": dict, "embedding": dict, "data": dict, "golden": dict}


def config_problems(config: dict) -> list[str]:
    """All that is wrong with a configuration (S10); empty if it can be used."""
    bad = [f"{name} is missing" for name in CONFIG if name not in config]
    bad += [f"{name} isn't a mapping" for name, kind in CONFIG.items() if name in config and not isinstance(config[name], kind)]
    if bad:
        return bad
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)

    def check(where: str, value, ok: bool, want: str) -> None:
        if not ok:
            bad.append(f"{where} is {value!r}, not {want}")

    for name, p in config["providers"].items():
        for limit in ("rpm", "tpm"):
            check(f"providers.{name}.{limit}", p.get(limit), number(p.get(limit)) and p[limit] > 0, "a positive number")
    for name, role in config["roles"].items():
        chain = [role.get("primary"), *role.get("fallbacks", [])]
        for ref in chain:
            whole = isinstance(ref, dict) and {"provider", "model"} <= ref.keys()
            check(f"roles.{name}", ref, whole, "a provider and a model")
            if whole:
                check(f"roles.{name}.provider", ref["provider"], ref["provider"] in config["providers"], f"one of {sorted(config['providers'])}")
    e, d, g = config["embedding"], config["data"], config["golden"]
    check("embedding.model", e.get("model"), isinstance(e.get("model"), str) and e["model"] != "", "a name")
    check("embedding.dim", e.get("dim"), isinstance(e.get("dim"), int) and e["dim"] > 0, "a positive whole number")
    check("embedding.dtype", e.get("dtype"), e.get("dtype") in ("float16", "float32", "float64"), "a type of floating-point numbers")
    check("data.split_quantile", d.get("split_quantile"), number(d.get("split_quantile")) and 0 < d["split_quantile"] < 1, "between 0 and 1")
    check("data.near_duplicate_cosine", d.get("near_duplicate_cosine"), number(d.get("near_duplicate_cosine")) and 0 < d["near_duplicate_cosine"] <= 1, "above 0 and at most 1")
    sizes = [g.get(k) for k in ("size", "stratum_a", "stratum_b")]
    check("golden", g, all(isinstance(x, int) and x >= 0 for x in sizes) and sizes[0] == sizes[1] + sizes[2], "a size that is the sum of both strata")
    return bad


def checked_config(path: str) -> dict:
    """``load_config``; raises ValueError, with all that is wrong."""
    config = load_config(path)
    problems = config_problems(config) if isinstance(config, dict) else ["it isn't a mapping"]
    if problems:
        raise ValueError(f"{path}: " + "; ".join(problems))
    return config


def roles_view(spark: SparkSession, config: dict) -> DataFrame:
    """(role, place, provider, model, enabled, rpm, tpm): each role's chain in its order."""
    rows = []
    for name, role in config["roles"].items():
        for place, ref in enumerate([role["primary"], *role.get("fallbacks", [])]):
            p = config["providers"][ref["provider"]]
            rows.append((name, place, ref["provider"], ref["model"], bool(p.get("enabled", True)), float(p["rpm"]), float(p["tpm"])))
    return spark.createDataFrame(rows, "role string, place int, provider string, model string, enabled boolean, rpm double, tpm double")


def embed_cached(texts: DataFrame, cache: DataFrame | None, embed: Callable[[DataFrame], DataFrame], model: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with ``embedding``, the new cache rows). The cache is keyed by the text's hash; only misses reach ``embed``, which adds a column ``embedding``."""
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("\0", F.lit(model), F.coalesce(F.col(text_col), F.lit(""))), 256))
    want = keyed.select("key", text_col).dropDuplicates(["key"])
    have = cache if cache is not None else None
    misses = want if have is None else want.join(have, "key", "left_anti")
    made = embed(misses).select("key", F.col("embedding").cast("array<float>").alias("embedding"))
    every = made if have is None else have.select("key", "embedding").unionByName(made)
    return keyed.join(every, "key").drop("key"), made


def hashing_embedder(dim: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A deterministic stand-in for a sentence model: signed hashed word counts, unit length. Built-in functions only."""
    from threadlake.functions.vectors import l2_normalize

    def embed(rows: DataFrame, text_col: str = "text") -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
        # a word's place from 1 on, with its sign; the texts are split and hashed once, as the places are the one element of an array
        spot = lambda w: (F.pmod(F.xxhash64(w), F.lit(dim)) + 1).cast("int") * F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1).otherwise(-1)
        share = lambda spots, i: (F.size(F.filter(spots, lambda p: p == i)) - F.size(F.filter(spots, lambda p: p == -i))).cast("double")
        counts = F.transform(F.array(F.transform(words, spot)), lambda spots: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: share(spots, i)))[0]
        return rows.withColumn("embedding", l2_normalize(counts).cast("array<float>"))

    return embed
