"""The named queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import ball_tree, chat, decontam, hilbert_search, license_scan, line_dedup, media, near_dedup, packing, periodic_runs, sharding, toxicity, url_filter
from threadlake.session import Scratch, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "url_match.host", "url_match.path", "url_match.rule", "url_match.verdict")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.by_document(docs, license_scan.scan(docs))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n = F.size("items")
    return decontam.contaminated(found).select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hit"), n.cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "sharding")
    out = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch.path("map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_trees(chat.chains(rows.unionByName(probe))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 20 = 0")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(docs.select("doc_id", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("text")))
    best, milli = periodic_runs.best_run(F.col("runs")), F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))
    digests = [periodic_runs.runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256")]
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), *digests)
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.report(*ball_tree.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_license_scan, op3_best_fit_packing, op4_near_dedup, op5_line_dedup, op6_media_columns, op7_decontamination, op8_sharding, op9_chat_formatting, op10_toxicity, op11_nearest_neighbours, op12_periodic_runs, op13_centroid_clustering)}

_BARE = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = f"""
lines AS (SELECT doc_id, u.line, u.n, {_LOWER.format(_BARE)} AS k
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {{docs}}) d, LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS n) u),
often AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL AND l.doc_id <> o.last) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE o.k IS NULL OR l.doc_id = o.last), '') AS text
         FROM lines l LEFT JOIN often o ON l.k = o.k GROUP BY l.doc_id)"""

def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds over (vector, place) rows, one pair of common table expressions a round."""
    parts = [
        "vec AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"first AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vec ORDER BY h LIMIT {k}))",
        "x AS MATERIALIZED (SELECT vec_id, unnest(v) AS a, generate_subscripts(v, 1) AS i FROM vec)",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS b, generate_subscripts(v, 1) AS i FROM first)",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT vec_id, c, sum((a - b) * (a - b)) AS d FROM x JOIN c{n} USING (i) GROUP BY ALL)")
        parts.append(f"p{n} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY vec_id)")
        if n < rounds:
            new = f"SELECT c, i, CAST((sum(a) - ((sum(a) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS b FROM x JOIN p{n} USING (vec_id) GROUP BY c, i"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.b, o.b) AS b FROM c{n} o LEFT JOIN ({new}) m USING (c, i))")
    digest = f"SELECT c, sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c"
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM p{rounds} JOIN ({digest}) USING (c)"""


ORACLE = {
    "op13_centroid_clustering": _clustering_sql(),
    "op1_url_filter": f"""
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op4_near_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, spot) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN ends e ON r.spot = e.a),
least AS (SELECT id, min(spot) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON id = doc_id""",
    "op9_chat_formatting": r"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM said),
sized AS (SELECT *, 13 + length(regexp_replace(role, '<\||\|>|</s>|<s>|\[INST\]|\[/INST\]|\\', '+\0', 'g')) + length(role) - length(replace(role, chr(10), ''))
          + length(regexp_replace(text, '<\||\|>|</s>|<s>|\[INST\]|\[/INST\]|\\', '+\0', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id""",
    "op5_line_dedup": f"WITH {LINES_SQL.format(docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept",
    "op7_decontamination": f"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, v.item FROM places p JOIN wins v ON p.win = v.win AND p.n = v.n),
cover AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS spot FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(m.n_items, 0) >= 2 AS contaminated
FROM words w LEFT JOIN cover c USING (doc_id) LEFT JOIN named m USING (doc_id)""",
}
