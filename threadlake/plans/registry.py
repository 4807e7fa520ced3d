"""Named queries over the driver's tables and the same in SQL.

The message log is derived from ``conversations``: ids by conversation and turn, each turn replying to the one before, assistants as the brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.functions.parsing import error_detail, parse_label
from threadlake.functions.vectors import l2_normalize
from threadlake.operators import budget, clustering, graph, records, retrieval, sampling, screening, taxonomy, threads
from threadlake.session import Scratch, table
from threadlake.sources.embedding_store import EmbeddingStore
from threadlake.sources.files import file_ranges, parse_created_at, write_sorted
from threadlake.sources.response_cache import ResponseCache

BRAND = "brand"
SEED = 20260909
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PATTERNS = {"question": r"\?", "shouting": r"!!", "license": r"licen[sc]ed?", "url": r"https?://|www\.", "digits": r"\d{5,}"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    tid = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        tid.alias("tweet_id"), F.when(F.col("role") == "assistant", F.lit(BRAND)).otherwise(F.concat(F.lit("u"), F.col("conv_id").cast("string"))).alias("author_id"),
        (F.col("role") == "user").alias("inbound"), F.timestamp_micros((F.lit(1704067200) + (F.col("conv_id") * 60 + F.col("turn")) * 60) * 1000000).alias("created_at"),
        "text", F.when(F.col("turn") > 0, tid - 1).alias("in_response_to_tweet_id"), F.col("conv_id").alias("thread_id"), F.col("text").alias("text_scrubbed"),
    )


MSG = """m AS (SELECT conv_id*1000+turn AS tweet_id, CASE WHEN role='assistant' THEN 'brand' ELSE 'u' || conv_id END AS author_id, role='user' AS inbound,
 1704067200 + (conv_id*60+turn)*60 AS ts, text, CASE WHEN turn>0 THEN conv_id*1000+turn-1 END AS parent, conv_id AS thread_id FROM conversations)"""
FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, tweet_id) AS rn FROM m WHERE inbound) WHERE rn=1)"
REPLY = "r AS (SELECT thread_id, text AS reply FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, tweet_id) AS rn FROM m WHERE author_id='brand') WHERE rn=1)"
SPLIT = "cut AS (SELECT quantile_cont(ts * 1000000, 0.7) AS cut FROM m), s AS (SELECT m.*, ts * 1000000 <= cut AS train FROM m, cut)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("text_scrubbed", T.scrub(F.col("text"), (BRAND,)))
    return threads.attach_reference_replies(threads.first_turns(m), m, BRAND).select("thread_id", "tweet_id", "text_scrubbed", "reference_reply")


@query(f"WITH {MSG}, {FIRST} SELECT thread_id, tweet_id, text FROM f")
def first_turn_per_thread(spark, sf_dir):
    return threads.first_turns(messages(spark, sf_dir)).select("thread_id", "tweet_id", "text")


@query(f"WITH {MSG}, {FIRST}, {REPLY} SELECT f.thread_id, f.tweet_id, r.reply AS reference_reply FROM f LEFT JOIN r USING (thread_id)")
def reference_reply(spark, sf_dir):
    m = messages(spark, sf_dir)
    return threads.attach_reference_replies(threads.first_turns(m), m, BRAND).select("thread_id", "tweet_id", "reference_reply")


# every seventh conversation's turn 2 cites a missing message that the next conversation's turn 1 cites too, so that components cross threads
_BROKEN = "CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN -(conv_id + 1) WHEN conv_id % 7 = 1 AND turn = 1 THEN -conv_id WHEN turn > 0 THEN conv_id*1000+turn-1 END"


def _broken(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return messages(spark, sf_dir).drop("in_response_to_tweet_id").join(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("tweet_id"), F.expr(_BROKEN).alias("in_response_to_tweet_id")), "tweet_id")


@query(f"""WITH RECURSIVE n AS (SELECT conv_id*1000+turn AS id, {_BROKEN} AS p, role='assistant' AS own FROM conversations),
e AS (SELECT id AS a, p AS b FROM n WHERE p IS NOT NULL UNION SELECT p, id FROM n WHERE p IS NOT NULL UNION SELECT id, id FROM n),
w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
c AS (SELECT a AS id, min(b) AS component FROM w GROUP BY a)
SELECT id, component FROM c WHERE component IN (SELECT c.component FROM c JOIN n USING (id) WHERE n.own)""")
def brand_components(spark, sf_dir):
    return graph.brand_connected_ids(_broken(spark, sf_dir), BRAND)


@query(f"""WITH RECURSIVE n AS (SELECT conv_id*1000+turn AS id, {_BROKEN} AS p FROM conversations),
u AS (SELECT n.id, CASE WHEN k.id IS NOT NULL THEN n.p END AS p FROM n LEFT JOIN n k ON n.p = k.id),
w(id, spot, up) AS (SELECT id, id, p FROM u UNION ALL SELECT w.id, u.id, u.p FROM w JOIN u ON w.up = u.id)
SELECT id, spot AS thread_id FROM w WHERE up IS NULL""")
def thread_roots(spark, sf_dir):
    return graph.thread_roots(_broken(spark, sf_dir))


# turns of every fifth conversation all belong to the brand and carry part marks but for the last
_PARTS = "CASE WHEN conv_id % 5 = 0 THEN text || ' (' || (turn + 1) || '/9)' ELSE text END"


@query(f"""WITH RECURSIVE m AS (SELECT conv_id*1000+turn AS id, CASE WHEN conv_id % 5 = 0 OR role='assistant' THEN 'brand' ELSE 'u' END AS author, conv_id*60+turn AS ts,
 {_PARTS} AS text, CASE WHEN turn>0 THEN conv_id*1000+turn-1 END AS p FROM conversations),
link AS (SELECT cid, pid FROM (SELECT c.id AS cid, q.id AS pid, row_number() OVER (PARTITION BY q.id ORDER BY c.ts, c.id) AS rn FROM m c JOIN m q ON c.p=q.id
  WHERE c.author='brand' AND q.author='brand' AND regexp_matches(q.text, '\\s*\\(\\d+/\\d+\\)\\s*$')) WHERE rn=1),
ch(tail, cur, k) AS (SELECT id, id, 0 FROM m WHERE id NOT IN (SELECT pid FROM link) UNION ALL SELECT ch.tail, l.pid, ch.k+1 FROM ch JOIN link l ON ch.cur=l.cid)
SELECT ch.tail AS tweet_id, coalesce((array_agg(m.p ORDER BY k DESC))[1], -1) AS parent, CASE WHEN max(k) = 0 THEN max(m.text) ELSE trim(string_agg(CASE WHEN k>0 THEN regexp_replace(m.text, '\\s*\\(\\d+/\\d+\\)\\s*$', '') ELSE m.text END, ' ' ORDER BY -k)) END AS text
FROM ch JOIN m ON m.id=ch.cur GROUP BY ch.tail""")
def multipart_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("tweet_id"), F.expr(_PARTS).alias("marked"), F.expr("conv_id % 5 = 0").alias("own"))
    m = messages(spark, sf_dir).join(c, "tweet_id").withColumn("text", F.col("marked")).withColumn("author_id", F.when(F.col("own"), F.lit(BRAND)).otherwise(F.col("author_id"))).drop("marked", "own")
    return threads.merge_parts(m, BRAND).select("tweet_id", F.coalesce("in_response_to_tweet_id", F.lit(-1)).alias("parent"), "text")


@query("WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events), c AS (SELECT quantile_cont(us, 0.7) AS cut FROM e) SELECT event_id, us <= cut AS in_training_window FROM e, c")
def time_split_events(spark, sf_dir):
    return threads.assign_time_split(table(spark, sf_dir, "events"), 0.7, "ts").select("event_id", "in_training_window")


@query("WITH e AS (SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders), c AS (SELECT quantile_cont(us, 0.7) AS cut FROM e) SELECT o_orderkey, us <= cut AS in_training_window FROM e, c")
def time_split_orders(spark, sf_dir):
    return threads.assign_time_split(table(spark, sf_dir, "orders"), 0.7, "o_orderdate").select("o_orderkey", "in_training_window")


@query(f"WITH {MSG}, {SPLIT} SELECT thread_id, count(*) FILTER (WHERE train) AS n_train, count(*) FILTER (WHERE NOT train) AS n_eval FROM s GROUP BY thread_id HAVING n_train > 0 AND n_eval > 0")
def straddling_threads(spark, sf_dir):
    return threads.straddling_threads(threads.assign_time_split(messages(spark, sf_dir)))


@query(f"WITH {MSG}, {SPLIT}, e AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, tweet_id) AS rn FROM s WHERE inbound AND NOT train) SELECT thread_id, tweet_id FROM e WHERE rn = 1")
def first_turn_eval_window(spark, sf_dir):
    return threads.first_turns(threads.assign_time_split(messages(spark, sf_dir)), training=False).select("thread_id", "tweet_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event_per_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("seq"))
    return records.latest_per_key(e, "user_id", "seq").select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    # minimum first, map-side, so that a text that many rows share is one row per task
    first = d.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return d.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang", "source")


_DIGIT_CODE = "|".join(["[0-9][A-Z0-9]{4,7}", *[f"[A-Z]{{{i}}}[0-9][A-Z0-9]{{{max(0, 4 - i)},{7 - i}}}" for i in range(1, 8)]])
_GUARD = "zQz"  # makes letters beyond ASCII word characters to RE2 as well


def _re2(e: str) -> str:
    """The scrub chain in DuckDB's RE2, which has no lookahead and only ASCII word characters."""
    e = f"regexp_replace({e}, '([^\\x00-\\x7F])', '{_GUARD}\\1{_GUARD}', 'g')"
    e = f"regexp_replace({e}, '(?i)https?://\\S+|www\\.\\S+', '[URL]', 'g')"
    e = f"regexp_replace({e}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', '[EMAIL]', 'g')"
    e = f"regexp_replace({e}, '(?i)\\b(confirmation|booking|reservation|record locator|order)\\b(?:\\s*(?:number|no\\.?|#))?(?:\\s*(?:is|was|[:#=]))?\\s+(?:{_DIGIT_CODE})\\b', '\\1 [REF]', 'g')"
    e = f"regexp_replace({e}, '\\b\\d{{6,}}\\b', '[REF]', 'g')"
    e = f"regexp_replace({e}, '(?:\\+?\\d{{1,3}}[\\s.-]?)?(?:\\(\\d{{2,4}}\\)[\\s.-]?)?\\d{{3}}[\\s.-]?\\d{{3,4}}[\\s.-]?\\d{{0,4}}\\b', '[PHONE]', 'g')"
    e = f"regexp_replace({e}, '(?i)@(brand)\\b', chr(1) || '\\1', 'g')"
    e = f"replace(regexp_replace({e}, '@(?:[A-Za-z0-9_]|[^\\x00-\\x7F])+', '@customer', 'g'), chr(1), '@')"
    return f"replace({e}, '{_GUARD}', '')"


@query(f"SELECT doc_id, {_re2('text')} AS scrubbed FROM documents")
def pii_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.scrub(F.col("text"), (BRAND,)).alias("scrubbed"))


def _marks(e: str) -> str:
    return ", ".join(f"CAST(sum((length(s) - length(replace(s, '{m}', ''))) // {len(m)}) AS BIGINT) AS {n}" for n, m in (("urls", "[URL]"), ("emails", "[EMAIL]"), ("refs", "[REF]"), ("phones", "[PHONE]")))


@query(f"WITH d AS (SELECT lang, {_re2('text')} AS s FROM documents) SELECT lang, {_marks('s')} FROM d GROUP BY lang")
def pii_counts_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", T.scrub(F.col("text"), (BRAND,)).alias("s"))
    count = lambda mark: F.sum(((F.length("s") - F.length(F.replace("s", F.lit(mark), F.lit("")))) / len(mark)).cast("long"))
    return d.groupBy("lang").agg(count("[URL]").alias("urls"), count("[EMAIL]").alias("emails"), count("[REF]").alias("refs"), count("[PHONE]").alias("phones"))


@query("WITH t AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(lower(text), '{p}')) AS {n}" for n, p in PATTERNS.items()) + " FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS bucket, {n} AS n, round({n} / total, 6) AS share FROM t" for n in PATTERNS))
def keyword_prevalence(spark, sf_dir):
    return taxonomy.prevalence(table(spark, sf_dir, "documents"), "text", PATTERNS)


@query("SELECT doc_id, CAST(floor(length(text) / CAST(3.6 AS DOUBLE)) AS INTEGER) + 1 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT conv_id, CAST(sum(CAST(floor(length(coalesce(text, '')) / CAST(3.6 AS DOUBLE)) AS INTEGER) + 5) AS INTEGER) AS tokens FROM conversations GROUP BY conv_id")
def token_budget(spark, sf_dir):
    # estimated per row and summed, so that no texts are shuffled
    one = T.estimate_prompt_tokens(F.array(F.struct("role", F.col("text").alias("content"))))
    return table(spark, sf_dir, "conversations").select("conv_id", one.alias("tokens")).groupBy("conv_id").agg(F.sum("tokens").cast("int").alias("tokens"))


PROVIDERS = [("a", 30.0, 6000.0), ("b", 30.0, 30000.0), ("c", 60.0, 50000.0), ("d", 20.0, 100000.0)]


@query("WITH t AS (SELECT count(*) AS calls, sum(CAST(floor(length(text) / CAST(3.6 AS DOUBLE)) AS INTEGER) + 1) AS tokens FROM documents), p(provider, rpm, tpm) AS (VALUES ('a', 30.0::DOUBLE, 6000.0::DOUBLE), ('b', 30, 30000), ('c', 60, 50000), ('d', 20, 100000)) SELECT provider, calls, CAST(tokens AS BIGINT) AS tokens, round(greatest(calls / rpm, tokens / tpm), 6) AS minutes FROM p, t")
def provider_minutes(spark, sf_dir):
    calls = table(spark, sf_dir, "documents").select(T.estimate_tokens(F.col("text")).alias("tokens"))
    return budget.provider_minutes(calls, spark.createDataFrame(PROVIDERS, "provider string, rpm double, tpm double"))


@query(f"SELECT doc_id, lang FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT 100")
def uniform_sample(spark, sf_dir):
    return sampling.uniform(table(spark, sf_dir, "documents"), 100, SEED, "doc_id").select("doc_id", "lang")


def _strata_sql(patterns: dict[str, str], n: int = 100) -> str:
    """Both strata in SQL: candidates per bucket, the turns as a recursion that carries the candidates' lists, then the top-up."""
    hit = " UNION ALL ".join(f"SELECT doc_id, {i} AS b FROM rest WHERE regexp_matches(lower(text), '{p}')" for i, p in enumerate(patterns.values()))
    names = ", ".join(f"'{n}'" for n in patterns)
    lists = ", ".join(f"coalesce(list(doc_id ORDER BY rn) FILTER (WHERE b = {i}), [])" for i in range(len(patterns)))
    return f"""WITH RECURSIVE a AS (SELECT doc_id FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT {n}),
rest AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)), hits AS ({hit}),
best AS (SELECT doc_id, b, row_number() OVER (PARTITION BY b ORDER BY md5('{SEED + 1}:' || doc_id), doc_id) AS rn FROM hits),
held AS (SELECT [{lists}] AS ls FROM best WHERE rn <= {n}),
walk(turn, ls, ids, bs) AS (SELECT 0, ls, []::BIGINT[], []::INTEGER[] FROM held UNION ALL
 SELECT turn + 1, ls, CASE WHEN pick IS NULL THEN ids ELSE list_append(ids, pick) END, CASE WHEN pick IS NULL THEN bs ELSE list_append(bs, turn % {len(patterns)}) END
 FROM (SELECT *, list_filter(ls[turn % {len(patterns)} + 1], lambda x: NOT list_contains(ids, x))[1] AS pick FROM walk WHERE len(ids) < {n} AND turn < {n * len(patterns)})),
b AS (SELECT unnest(ids) AS doc_id, unnest(bs) AS b FROM (SELECT * FROM walk ORDER BY turn DESC LIMIT 1)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED + 2}:' || doc_id), doc_id) AS place FROM rest WHERE doc_id NOT IN (SELECT doc_id FROM b)),
drawn AS (SELECT doc_id, 'A' AS stratum, 'uniform_random' AS sample_reason FROM a UNION ALL SELECT doc_id, 'B', ([{names}])[b + 1] FROM b
 UNION ALL SELECT doc_id, 'B', 'random_topup' FROM ranked WHERE place <= {n} - (SELECT count(*) FROM b))"""


@query(f"{_strata_sql(PATTERNS)} SELECT * FROM drawn")
def stratified_round_robin(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_scrubbed"))
    return sampling.two_strata(d, 100, 100, SEED, "doc_id", patterns=PATTERNS).select("doc_id", "stratum", "sample_reason")


_LOG = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END AS label_intent, CASE WHEN quality = 1 THEN 'keep' END AS label_action, doc_id + quality AS seq FROM labels"


def _log(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END").alias("label_intent"), F.expr("CASE WHEN quality = 1 THEN 'keep' END").alias("label_action"), (F.col("doc_id") + F.col("quality")).alias("seq"))


@query(f"WITH l AS ({_LOG}) SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.label_intent ELSE d.lang END AS label_intent, CASE WHEN l.doc_id IS NOT NULL THEN l.label_action ELSE d.source END AS label_action FROM documents d LEFT JOIN l USING (doc_id)")
def label_override_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label_intent"), F.col("source").alias("label_action"))
    return records.override(d, records.latest_per_key(_log(spark, sf_dir), "doc_id", "seq").drop("seq"), "doc_id")


@query(f"WITH l AS ({_LOG}) SELECT count(l.doc_id) AS done, count(*) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM l WHERE label_intent IS NOT NULL AND label_action IS NOT NULL) l USING (doc_id)")
def label_progress(spark, sf_dir):
    return records.progress(table(spark, sf_dir, "documents"), _log(spark, sf_dir), "doc_id")


@query(f"WITH l AS ({_LOG}) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE label_intent IS NOT NULL AND label_action IS NOT NULL)")
def unlabelled(spark, sf_dir):
    return records.unlabelled(table(spark, sf_dir, "documents"), _log(spark, sf_dir), "doc_id").select("doc_id")


@query("SELECT label AS cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf_dir):
    return clustering.sizes(table(spark, sf_dir, "embeddings"), "label")


_VEC = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label AS cluster, pos, avg(x) AS m FROM e GROUP BY ALL)"
_OWN = f"{_VEC}, d AS (SELECT e.vec_id, e.label AS cluster, round(sqrt(sum((x-m)*(x-m))), 9) AS distance FROM e JOIN c ON e.label=c.cluster AND e.pos=c.pos GROUP BY ALL)"


@query(f"WITH {_OWN} SELECT cluster, rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 12")
def representatives_topn(spark, sf_dir):
    top = clustering.representatives(table(spark, sf_dir, "embeddings"), 12, "label")
    return top.select(F.col("label").alias("cluster"), F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_VEC}, d AS (SELECT e.vec_id, c.cluster, round(sqrt(sum((x-m)*(x-m))), 9) AS distance FROM e JOIN c ON e.pos=c.pos GROUP BY ALL) SELECT vec_id, cluster, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS rn FROM d) WHERE rn=1")
def lloyd_step(spark, sf_dir):
    return clustering.lloyd_step(table(spark, sf_dir, "embeddings"), "label").select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query(f"WITH {_VEC}, d AS (SELECT e.label AS cluster, e.vec_id, sum((x-m)*(x-m)) AS q FROM e JOIN c ON e.label=c.cluster AND e.pos=c.pos GROUP BY ALL) SELECT cluster, count(*) AS n, round(sum(q), 4) AS inertia FROM d GROUP BY cluster")
def inertia_by_cluster(spark, sf_dir):
    return clustering.inertia(table(spark, sf_dir, "embeddings"), "label")


@query("""WITH v AS (SELECT * FROM embeddings),
p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sqrt(greatest(0, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
g AS (SELECT vec_id, la, lb, avg(d) AS m FROM p GROUP BY ALL),
s AS (SELECT vec_id, max(m) FILTER (WHERE la=lb) AS a, min(m) FILTER (WHERE la<>lb) AS b FROM g GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END), 6) AS silhouette, count(*) AS n FROM s""")
def silhouette_exact(spark, sf_dir):
    s = clustering.silhouette(table(spark, sf_dir, "embeddings"), "label", sample=None)
    return s.select(F.round("silhouette", 6).alias("silhouette"), "n")


@query()
def kmeans_sweep(spark, sf_dir):
    sweep = clustering.sweep_k(table(spark, sf_dir, "embeddings"), list(range(8, 15)), SEED)
    return sweep.crossJoin(clustering.sweep_flags(sweep)).join(clustering.best_k(sweep).select("k", F.lit(True).alias("best")), "k", "left")


# a sweep made of the events: a row per seven users' remainder, with a mean in place of the silhouette
_SWEEP = "s AS (SELECT CAST(user_id % 7 + 8 AS INTEGER) AS k, round(avg(value) / 400, 6) AS silhouette, round(sum(value), 6) AS inertia FROM events GROUP BY 1)"


@query(f"""WITH {_SWEEP}, l AS (SELECT *, lag(silhouette) OVER (ORDER BY k) AS before FROM s)
SELECT (SELECT k FROM s ORDER BY silhouette DESC, k LIMIT 1) AS k, max(silhouette) < 0.25 AS weak, count(*) > 1 AND coalesce(bool_and(silhouette <= before), FALSE) AS monotone FROM l""")
def sweep_choice(spark, sf_dir):
    """A10 to A12 on a fixed sweep."""
    sweep = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7 + 8).cast("int").alias("k")).agg(F.round(F.avg("value") / 400, 6).alias("silhouette"), F.round(F.sum("value"), 6).alias("inertia"))
    return clustering.best_k(sweep).select("k").crossJoin(clustering.sweep_flags(sweep))


@query("SELECT vec_id, pos, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x FROM (SELECT vec_id, pos - 1 AS pos, x, sqrt(sum(x*x) OVER (PARTITION BY vec_id)) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE * 3 AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings))")
def l2_normalized(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("v", l2_normalize(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)))
    return v.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


_ASKED = "(SELECT * FROM embeddings WHERE vec_id % 20 = 0)"
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_PAIRS = f"p AS (SELECT a.vec_id AS id, b.vec_id AS match_id, round({_COS}, 6) AS cosine FROM {_ASKED} a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, match_id) AS rank FROM p)"


def _asked(spark, sf_dir) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 20, at any size."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0)


def _exact(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact answers of an index over ``vectors``, which is dropped once they are written."""
    index = retrieval.build(vectors, seed=SEED)
    found = Scratch(vectors.sparkSession, "answers").table(retrieval.search(index, asked, k), "found")
    index.drop()
    return found


@query(f"WITH {_PAIRS} SELECT id, match_id AS best_id, cosine FROM k WHERE rank = 1 AND cosine > 0.4")
def near_dup_screen(spark, sf_dir):
    """At a bound as low as this hashing sorts nothing out: exact answers of the index."""
    return _exact(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 1).where("cosine > 0.4").select("id", F.col("match_id").alias("best_id"), "cosine")


@query(f"WITH {_PAIRS} SELECT id, match_id, cosine, rank FROM k WHERE rank <= 5")
def retrieval_topk(spark, sf_dir):
    return _exact(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT count(*) AS asked, 5 * count(*) AS wanted, TRUE AS reached FROM embeddings WHERE vec_id % 20 = 0")
def retrieval_recall(spark, sf_dir):
    """The probes as measured on a sample, then the recall of all queries against exact answers; ``reached``: it is 0.9 or more."""
    index, asked = retrieval.build(table(spark, sf_dir, "embeddings"), seed=SEED), _asked(spark, sf_dir)
    probes = retrieval.measured_probes(index, asked, 5, seed=SEED)
    scratch = Scratch(spark, "recall")
    seen = scratch.table(retrieval.recall(retrieval.search(index, asked, 5, probes), retrieval.search(index, asked, 5)), "seen")
    index.drop()
    return asked.agg(F.count("*").alias("asked")).crossJoin(seen).select("asked", "wanted", (F.col("recall") >= 0.9).alias("reached"))


# golden vectors: every twentieth, of which every third is a slightly turned copy of the next row's vector
_GOLDEN = "(SELECT a.vec_id, a.label, CASE WHEN a.vec_id % 60 = 0 THEN list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * 0.2 + z[2]::DOUBLE) ELSE a.embedding::DOUBLE[] END AS embedding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0)"
_REST = "(SELECT * FROM embeddings WHERE vec_id % 20 <> 0)"
_CLOSE = f"p AS (SELECT a.vec_id, a.label, b.vec_id AS match_id, b.label AS other, round({_COS}, 6) AS cosine FROM {_GOLDEN} a JOIN {_REST} b ON TRUE), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, match_id) AS rank FROM p) WHERE rank = 1)"


def _golden(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    turned = F.zip_with(F.col("embedding").cast("array<double>"), F.col("next").cast("array<double>"), lambda x, y: x * F.lit(0.2) + y)
    return e.where("vec_id % 20 = 0").join(after, "vec_id").select("vec_id", "label", F.when(F.col("vec_id") % 60 == 0, turned).otherwise(F.col("embedding").cast("array<double>")).alias("embedding"))


@query(f"WITH {_CLOSE} SELECT vec_id AS id, match_id AS best_id, cosine FROM k WHERE cosine > 0.95")
def golden_screen(spark, sf_dir):
    return screening.near_screen(_golden(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id % 20 <> 0"))


@query(f"""WITH {_CLOSE} SELECT vec_id % 3 AS stratum, count(*) AS n, count(*) FILTER (WHERE cosine > 0.95) AS screened, round(avg((label = other)::INT), 6) AS accuracy_with,
round(avg((label = other)::INT) FILTER (WHERE cosine <= 0.95), 6) AS accuracy_without FROM k GROUP BY stratum""")
def golden_screen_report(spark, sf_dir):
    """Labels predicted by the nearest indexed vector's, and how far rows that the screen takes out flatter them."""
    golden, rest = _golden(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id % 20 <> 0")
    best = _exact(rest, golden, 1).select(F.col("id").alias("vec_id"), "match_id")
    predicted = best.join(rest.select(F.col("vec_id").alias("match_id"), F.col("label").alias("predicted")), "match_id")
    scored = golden.select("vec_id", F.col("label").alias("label_intent"), (F.col("vec_id") % 3).alias("stratum")).join(predicted, "vec_id", "left")
    return screening.screen_report(scored, screening.near_screen(golden, rest))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events")
def native_timestamp_parse(spark, sf_dir):
    raw = F.concat(F.lit("Tue "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(parse_created_at(raw)).alias("us"))


# events as answers: a key per user, put in three goes, the first two compacted
@query("""SELECT key, event_id, provider FROM (SELECT 'u' || user_id AS key, event_id, event_type AS provider, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def response_cache_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = e.select(
        key.alias("key"), F.col("event_type").alias("provider"), F.lit("m").alias("model"), F.col("event_id").cast("string").alias("text"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.col("ts").cast("string").alias("created_at"),
        F.lit(0).alias("latency_ms"), "event_id",
    )
    cache = ResponseCache(spark, Scratch(spark, "cache").root)
    for part in range(3):
        cache.put(rows.where(F.col("event_id") % 3 == part).orderBy("event_id"))
        if part == 1:
            cache.compact()
    return cache.read().select("key", F.col("text").cast("long").alias("event_id"), "provider")


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents")
def embedding_store(spark, sf_dir):
    """Vectors of the documents' texts, made once and read back from the store; a stand-in for a model that counts three things, so that SQL can tell whose vector is whose."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), "text")
    store = EmbeddingStore(spark, Scratch(spark, "embeddings").root, "counts", "double")
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    store.embed(texts, lambda rows: rows.withColumn("embedding", F.array(F.length("text"), F.octet_length("text"), blanks).cast("array<double>")))
    held = store.embed(texts, lambda rows: rows.withColumn("embedding", F.raise_error(F.lit("the store has these vectors")).cast("array<double>")))
    return held.select(F.col("place").alias("doc_id"), *[F.col("embedding")[i].cast("long").alias(n) for i, n in enumerate(("chars", "bytes", "blanks"))])


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS overlaps FROM events")
def sorted_sink(spark, sf_dir):
    """Written sorted by time and read back: rows that come before the row in front of them in their file, and files that begin before the file in front of them ends."""
    path = Scratch(spark, "sorted").path("events")
    write_sorted(table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), path, ["us", "event_id"])
    rows = spark.read.parquet(path).select("us", "event_id", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    in_file = Window.partitionBy("file").orderBy("at")
    wrong = rows.select(((F.lag("us").over(in_file) > F.col("us")) | ((F.lag("us").over(in_file) == F.col("us")) & (F.lag("event_id").over(in_file) > F.col("event_id")))).alias("bad"))
    ranges = file_ranges(spark, path, "us")  # a row per file
    over = ranges.select((F.lag("hi").over(Window.orderBy("file")) > F.col("lo")).alias("over"))
    return wrong.agg(F.count("*").alias("n"), F.count_if("bad").alias("out_of_order")).crossJoin(over.agg(F.count_if("over").alias("overlaps")))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def event_shares(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    total = e.agg(F.count("*").alias("t"))  # one row
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).crossJoin(F.broadcast(total)).select("event_type", "n", "users", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("WITH v(tag, intent, description) AS (VALUES (0, 'a', 'x'), (1, 'b', ''), (2, NULL, NULL)) SELECT event_id, intent AS label, description FROM events JOIN v ON tag = event_id % 3")
def json_label_parse(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit('<think>{"label": "no"}</think>Answer: {"label": " a ", "description": "x"}')).when(F.col("event_id") % 3 == 1, F.lit('first {"x": 1}\n```json\n{"label": "b"}\n```')).otherwise(F.lit("none {broken"))
    return table(spark, sf_dir, "events").select("event_id", parse_label(raw).alias("p")).select("event_id", "p.label", "p.description")


_PREVALENT = "kt AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(lower(text), '{p}')) AS {n}" for n, p in PATTERNS.items()) + " FROM documents)"


@query(f"""WITH {_PREVALENT} SELECT 'cluster' AS source, count(DISTINCT label) AS n, 1.0::DOUBLE AS share FROM embeddings
UNION ALL SELECT 'keyword', {len(PATTERNS)}, round({" + ".join(f"round({n} / total, 6)" for n in PATTERNS)}, 6) FROM kt""")
def taxonomy_shares(spark, sf_dir):
    """Clusters of the embeddings share out their rows, keyword shares of the documents overlap."""
    return taxonomy.shares(_measured(spark, sf_dir))


def _measured(spark, sf_dir) -> DataFrame:
    """A taxonomy of measured shares: the embeddings' labels and the documents' patterns."""
    e = table(spark, sf_dir, "embeddings")
    clusters = e.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(e.agg(F.count("*").alias("total"))))  # one row
    clusters = clusters.select(F.concat(F.lit("cluster_"), F.col("label").cast("string")).alias("label"), F.lit("cluster").alias("source"), (F.col("n") / F.col("total")).alias("approx_share"))
    words = taxonomy.prevalence(table(spark, sf_dir, "documents"), "text", PATTERNS).select(F.col("bucket").alias("label"), F.lit("keyword").alias("source"), F.col("share").alias("approx_share"))
    tier = F.when(F.col("label").isin("license", "cluster_3"), "always_escalate").when(F.col("source") == "cluster", "auto_ok").otherwise("review")
    return clusters.unionByName(words).select("label", F.concat(F.lit("about "), F.col("label")).alias("description"), "source", tier.alias("risk_tier"), "approx_share", F.lit(None).cast("string").alias("note"))


_MEASURED = f"""{_PREVALENT}, ms AS (SELECT 'cluster_' || label AS label, 'cluster' AS source, count(*) / sum(count(*)) OVER () AS share FROM embeddings GROUP BY label
 UNION ALL {" UNION ALL ".join(f"SELECT '{n}', 'keyword', round({n} / total, 6) FROM kt" for n in PATTERNS)}),
tx AS (SELECT *, 'about ' || label AS description, CASE WHEN label IN ('license', 'cluster_3') THEN 'always_escalate' WHEN source = 'cluster' THEN 'auto_ok' ELSE 'review' END AS tier FROM ms)"""


@query(f"WITH {_MEASURED} SELECT label, tier, source, printf('%.1f%%', share * 100) AS share, description FROM tx")
def taxonomy_view(spark, sf_dir):
    return taxonomy.view(_measured(spark, sf_dir))


@query(f"WITH {_MEASURED} SELECT count(*) AS intents, '100.0%' AS cluster_total, string_agg(label, ', ' ORDER BY label) FILTER (WHERE tier = 'always_escalate') AS always_escalate FROM tx")
def taxonomy_summary(spark, sf_dir):
    return taxonomy.summary(_measured(spark, sf_dir))


@query(f"WITH {_MEASURED} SELECT string_agg('- ' || label || ': ' || description, chr(10) ORDER BY label) AS block FROM tx")
def intent_prompt_block(spark, sf_dir):
    return taxonomy.prompt_block(_measured(spark, sf_dir))


@query(f"WITH {_MEASURED} SELECT label FROM tx WHERE tier = 'always_escalate'")
def always_escalated(spark, sf_dir):
    return taxonomy.always_escalate(_measured(spark, sf_dir))


# a taxonomy made of all events, in which each twelfth has a fault of its kind
_FAULTY = "CASE event_id % 12 WHEN 1 THEN 'Bad Label ' || event_id WHEN 2 THEN 'twice_' || (event_id // 12) WHEN 3 THEN 'twice_' || (event_id // 12) ELSE 'intent_' || event_id END"
_SOURCE = "CASE WHEN event_id % 12 = 4 THEN 'guess' WHEN event_id % 12 <= 8 THEN 'cluster' ELSE 'keyword' END"
_TIER = "CASE WHEN event_id % 12 = 5 THEN 'maybe' WHEN event_id % 12 = 8 THEN 'always_escalate' ELSE 'review' END"
_SHARE = "CASE event_id % 12 WHEN 6 THEN 1.5 WHEN 7 THEN NULL ELSE 0.125 END"
_BAD = f"t AS (SELECT event_id, {_FAULTY} AS label, {_SOURCE} AS source, {_TIER} AS tier, CAST({_SHARE} AS DOUBLE) AS share FROM events)"


def _faulty(spark, sf_dir) -> DataFrame:
    cols = {"label": _FAULTY.replace("//", "div"), "description": "event_type", "source": _SOURCE, "risk_tier": _TIER, "approx_share": f"CAST({_SHARE} AS DOUBLE)", "note": "CAST(NULL AS STRING)"}
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in cols.items()])


@query(f"""WITH {_BAD} SELECT 'repeated_label' AS rule, label AS detail FROM t GROUP BY label HAVING count(*) > 1
UNION ALL SELECT 'no_other', '0' WHERE NOT EXISTS (SELECT 1 FROM t WHERE label = 'other')
UNION ALL SELECT 'not_snake_case', label FROM t WHERE NOT regexp_full_match(label, '[a-z][a-z0-9_]*')
UNION ALL SELECT 'unknown_tier', label FROM t WHERE tier NOT IN ('auto_ok', 'review', 'always_escalate')
UNION ALL SELECT 'unknown_source', label FROM t WHERE source NOT IN ('cluster', 'keyword')""")
def taxonomy_validation(spark, sf_dir):
    return taxonomy.violations(_faulty(spark, sf_dir))


@query(f"""WITH {_BAD}, k AS (SELECT sum(share) FILTER (WHERE source = 'cluster') AS c, sum(share) FILTER (WHERE source = 'keyword') AS w FROM t)
SELECT 'share_out_of_range' AS rule, label AS detail FROM t WHERE share NOT BETWEEN 0 AND 1 UNION ALL SELECT 'no_share', label FROM t WHERE share IS NULL AND label <> 'other'
UNION ALL SELECT 'cluster_shares_sum', CAST(c AS VARCHAR) FROM k WHERE c NOT BETWEEN 0.97 AND 1.03 UNION ALL SELECT 'keyword_shares_sum', CAST(w AS VARCHAR) FROM k WHERE w >= 1
UNION ALL SELECT 'all_shares_sum', CAST(c + w AS VARCHAR) FROM k WHERE c + w <= 1""")
def taxonomy_share_rules(spark, sf_dir):
    return taxonomy.share_violations(_faulty(spark, sf_dir))


@query("SELECT count(*) AS too_few FROM (SELECT event_id FROM events WHERE event_id = (SELECT min(event_id) FROM events))")
def taxonomy_too_few(spark, sf_dir):
    """V4: a taxonomy of the first event alone has one intent."""
    one = _faulty(spark, sf_dir).orderBy("label").limit(1)
    return taxonomy.violations(one).where("rule = 'too_few'").agg(F.count("*").alias("too_few"))


# label records of all events: intents of the measured taxonomy and one it lacks, actions and reasons with faults
_REASON = "CASE event_id % 5 WHEN 0 THEN 'high_risk_intent' WHEN 1 THEN '' WHEN 2 THEN 'mood' WHEN 3 THEN 'other' END"
_INTENT = "CASE event_id % 7 WHEN 0 THEN 'cluster_3' WHEN 1 THEN 'license' WHEN 2 THEN 'nowhere' WHEN 3 THEN NULL ELSE 'cluster_1' END"
_ACTION = "CASE event_id % 4 WHEN 0 THEN 'escalate' WHEN 1 THEN 'auto' WHEN 2 THEN 'wait' END"
_RECORDS = f"r AS (SELECT event_id AS id, {_INTENT} AS intent, {_ACTION} AS action, coalesce({_REASON}, '') AS reason FROM events), l AS (SELECT r.*, tx.label AS known, tx.tier, coalesce(action = 'escalate', FALSE) AS esc FROM r LEFT JOIN tx ON intent = label WHERE intent IS NOT NULL OR action IS NOT NULL)"


def _records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("tweet_id"), F.expr(_INTENT).alias("label_intent"), F.expr(_ACTION).alias("label_action"), F.expr(_REASON).alias("label_reason"))


@query(f"""WITH {_MEASURED}, {_RECORDS} SELECT 'unknown_intent' AS rule, id FROM l WHERE intent IS NOT NULL AND known IS NULL UNION ALL SELECT 'unknown_action', id FROM l WHERE action NOT IN ('auto', 'escalate')
UNION ALL SELECT 'not_escalated', id FROM l WHERE tier = 'always_escalate' AND NOT esc UNION ALL SELECT 'no_reason', id FROM l WHERE esc AND reason = ''
UNION ALL SELECT 'unknown_reason', id FROM l WHERE esc AND reason = 'mood' UNION ALL SELECT 'reason_without_escalation', id FROM l WHERE NOT esc AND reason <> ''""")
def label_rules(spark, sf_dir):
    return taxonomy.label_violations(_records(spark, sf_dir), _measured(spark, sf_dir))


@query(f"WITH {_MEASURED}, {_RECORDS} SELECT id AS tweet_id, tier AS risk_tier, CASE WHEN tier = 'always_escalate' THEN 'escalate' ELSE action END AS action FROM r LEFT JOIN tx ON intent = label WHERE coalesce(intent, '') <> 'nowhere'")
def tier_and_action(spark, sf_dir):
    """The intent's tier, and the action that it forces."""
    known = _records(spark, sf_dir).where(F.coalesce("label_intent", F.lit("")) != "nowhere")
    rows = taxonomy.with_tier(known, _measured(spark, sf_dir))
    return rows.select("tweet_id", "risk_tier", taxonomy.action(F.col("label_action"), F.col("risk_tier")).alias("action"))


def _guarded(text: str) -> str:
    """Lower-cased text in which letters beyond ASCII are word characters to RE2 as well."""
    return f"regexp_replace(lower({text}), '([^\\x00-\\x7F])', '{_GUARD}\\1{_GUARD}', 'g')"


@query(f"WITH g AS (SELECT doc_id, {_guarded('text')} AS t FROM documents) SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in T.BUCKETS.items())}], lambda x: x IS NOT NULL), ',') AS buckets FROM g")
def pattern_buckets(spark, sf_dir):
    """all eleven patterns over all texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.matched_buckets(F.col("text")), ",").alias("buckets"))


@query("""SELECT conv_id, turn, sha256('{"model":"' || role || '","provider":"p' || (conv_id % 3) || '","temperature":' || turn || '}') AS key FROM conversations""")
def call_keys(spark, sf_dir):
    """F12."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.cache_key(provider=F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")), model=F.col("role"), temperature=F.col("turn")).alias("key"))


def _turns(spark, sf_dir) -> DataFrame:
    """(conv_id, texts) in the order of the turns."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))


@query("SELECT conv_id, substr(sha256('m' || chr(0) || 'float16' || chr(0) || count(*) || chr(0) || string_agg(sha256(coalesce(text, chr(0))), chr(0) ORDER BY turn)), 1, 16) AS key FROM conversations GROUP BY conv_id")
def text_set_keys(spark, sf_dir):
    """F13."""
    return _turns(spark, sf_dir).select("conv_id", T.content_hash(F.col("texts"), "m").alias("key"))


@query("SELECT conv_id, 'system' AS first_role, 'Of ' || count(*) || ':' || chr(10) || string_agg((turn + 1) || '. ' || coalesce(text, ''), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def label_prompts(spark, sf_dir):
    """F20 over the conversations' turns, which count from 0 without gaps."""
    p = T.label_prompt(F.col("texts"), "s", "Of {n}:\n{messages}")
    return _turns(spark, sf_dir).select("conv_id", p.alias("p")).select("conv_id", F.col("p")[0]["role"].alias("first_role"), F.col("p")[1]["content"].alias("content"))


@query("""SELECT event_id, left(CASE event_id % 4 WHEN 0 THEN '429 slow down ' || event_id || ' [' || event_type || ']' WHEN 1 THEN '500 just ' || event_type WHEN 2 THEN '502 <html>' || repeat('x', event_id % 300) ELSE '400 {"error": "broken"}' END, CASE WHEN event_id % 4 = 2 THEN 164 ELSE 160 END) AS detail FROM events""")
def provider_errors(spark, sf_dir):
    """F22."""
    e = table(spark, sf_dir, "events")
    body = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"error": {"message": "slow down ' || event_id || '", "type": "' || event_type || '"}}' WHEN 1 THEN '{"message": "just ' || event_type || '"}'
        WHEN 2 THEN '<html>' || repeat('x', CAST(event_id % 300 AS INT)) ELSE '{"error": "broken"}' END""")
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 502 ELSE 400 END")
    return e.select("event_id", error_detail(status, body).alias("detail"))


@query("SELECT doc_id % 3 AS stratum, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def accuracy_by_stratum(spark, sf_dir):
    """U3."""
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("stratum"), F.col("quality").alias("label_intent"), F.col("toxic").alias("predicted"))
    return records.per_stratum(rows)


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) / count(*) AS po FROM labels),
pe AS (SELECT sum(a.x * b.y) / (SELECT n * n FROM n) AS pe FROM (SELECT quality AS l, count(*) AS x FROM labels GROUP BY 1) a JOIN (SELECT toxic AS l, count(*) AS y FROM labels GROUP BY 1) b USING (l))
SELECT n, round((po - pe) / (1 - pe), 6) AS kappa FROM n, pe""")
def rater_kappa(spark, sf_dir):
    """U4."""
    return records.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT event_type || '/' || (user_id % 3) AS model, count(*) AS n FROM events GROUP BY 1")
def calls_by_model(spark, sf_dir):
    """A4."""
    return records.calls_by_model(table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 3).cast("string").alias("model")))


@query(f"{_strata_sql(PATTERNS)} SELECT stratum, sample_reason, count(*) AS n FROM drawn GROUP BY ALL")
def sample_reason_totals(spark, sf_dir):
    return sampling.counts_by_reason(stratified_round_robin(spark, sf_dir))
