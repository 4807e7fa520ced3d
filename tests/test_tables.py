import inspect
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.functions.vectors import l2_normalize
from threadlake.operators import budget, clustering, records, taxonomy
from threadlake.plans import registry
from threadlake.sources import files
from threadlake.streaming.latest import LatestTable, windowed_counts

VEC = "vec_id long, label int, embedding array<float>"


def test_taxonomy(spark):
    good = taxonomy.curated(spark)
    assert taxonomy.violations(good).count() == 0
    share = {r["source"]: r["share"] for r in taxonomy.shares(good).collect()}
    assert 0.97 < share["cluster"] < 1.03 and share["keyword"] < 1 < sum(share.values())
    bad = spark.createDataFrame([("A", "", "cluster", "review", None, None), ("A", "", "web", "never", None, None)], taxonomy.SCHEMA)
    assert {r["rule"] for r in taxonomy.violations(bad).collect()} == {"repeated_label", "no_other", "not_snake_case", "unknown_tier", "unknown_source"}
    rows = spark.createDataFrame([("refund_or_compensation",), ("praise_thanks",), (None,)], "label_intent string")
    tiers = taxonomy.with_tier(rows, good).withColumn("a", taxonomy.action(F.lit("auto"), F.col("risk_tier")))
    assert {r["label_intent"]: r["a"] for r in tiers.collect()} == {"refund_or_compensation": "escalate", "praise_thanks": "auto", None: "auto"}
    with pytest.raises(Exception, match="unknown intent"):
        taxonomy.with_tier(spark.createDataFrame([("x",)], "label_intent string"), good).collect()
    assert taxonomy.prompt_block(good).first()[0].startswith("- accessibility_medical: ")


def test_clusters(spark):
    rows = [(i, 0, [float(i % 3), 0.0]) for i in range(9)] + [(100 + i, 1, [50.0 + i % 3, 1.0]) for i in range(6)] + [(200, 2, [0.0, 90.0])]
    v = spark.createDataFrame(rows, VEC)
    model = clustering.fit(v, 3, 1, 3)
    assert sorted(r["n"] for r in clustering.sizes(clustering.assign(v, model)).collect()) == [1, 6, 9]
    s = clustering.silhouette(v, "label", sample=None).first()
    assert 0.8 < s["silhouette"] < 1 and s["n"] == 16
    assert clustering.silhouette(v.where("label = 0"), "label", sample=None).first()["silhouette"] == -1.0
    assert [r["vec_id"] for r in clustering.representatives(v, 2, "label").where("label = 2").collect()] == [200]
    assert {r["cluster"] for r in clustering.lloyd_step(v, "label").where("vec_id < 9").collect()} == {0}


def test_silhouette_by_blocks(spark, monkeypatch):
    """All rows, in blocks of a few, against plain loops; copies, a single member and more rows than any one block."""
    monkeypatch.setattr(clustering, "BLOCK", 16)
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(60, 3)), rng.normal(size=(50, 3)) + 4, np.ones((20, 3)), [[99.0, 0, 0]]))
    labels = [0] * 60 + [1] * 50 + [2] * 20 + [3]
    x = x.astype(np.float32).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(labels):
        mean = lambda k, out=0: d[i][np.array(labels) == k].sum() / max(1, labels.count(k) - out)  # noqa: B023, E731
        a, b = mean(c, 1), min(mean(k) for k in set(labels) if k != c)
        want.append(0.0 if labels.count(c) == 1 else (b - a) / max(a, b))
    v = spark.createDataFrame([(i, c, r.tolist()) for i, (c, r) in enumerate(zip(labels, x, strict=True))], VEC)
    got = clustering.silhouette(v, "label", sample=None).first()
    assert got["n"] == len(x) and got["silhouette"] == pytest.approx(np.mean(want), abs=1e-9)
    assert clustering.silhouette(v, "label", sample=40, seed=1).first()["n"] == 40
    assert clustering.silhouette(v.limit(0), "label", sample=None).first().asDict() == {"silhouette": -1.0, "n": 0}


@pytest.mark.parametrize(("stripe", "stripes"), [(10_000, 4), (24, 8)])
def test_silhouette_copies_a_vector_once_per_stripe(spark, monkeypatch, stripe, stripes):
    """How often a block is sent doesn't grow with the number of blocks, up to the size of a stripe; equal to plain loops."""
    for name, value in (("BLOCK", 8), ("STRIPES", 4), ("STRIPE", stripe)):
        monkeypatch.setattr(clustering, name, value)
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (sent.append(self.count()) if "pair" in self.columns else None, run(self, *a, **k))[1])
    rng = np.random.default_rng(8)
    x, labels = rng.normal(size=(190, 5)), np.arange(190) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sums = np.stack([d[:, labels == k].sum(1) for k in range(3)], 1)
    n, mine = np.bincount(labels), labels[:, None] == np.arange(3)
    a, b = sums[mine] / (n[labels] - 1), np.where(mine, np.inf, sums / n).min(1)
    v = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(labels, x, strict=True))], "vec_id long, label int, embedding array<double>")
    got = clustering.silhouette(v, "label", sample=None).first()
    assert got["n"] == 190 and got["silhouette"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-9)
    assert sent == [24 * stripes]  # 24 blocks


def test_label_causes(spark):
    prompts = spark.createDataFrame([(1, "good"), (2, "strict"), (3, "never"), (4, "none")], "cluster_id int, prompt string")

    def complete(p):
        strict = p.endswith(clustering.STRICT_SUFFIX)
        return F.when(p.startswith("good") | (p.startswith("strict") & strict), F.lit('{"label": "a", "description": "d"}')).when(p.startswith("none"), F.lit(None)).otherwise(F.lit("no json"))

    got = {r["cluster_id"]: (r["label"], r["cause"]) for r in clustering.label_clusters(prompts, complete).collect()}
    assert got == {1: ("a", None), 2: ("a", None), 3: ("unlabelled_cluster_3", "no JSON object"), 4: ("unlabelled_cluster_4", "no answer")}
    details = {r["detail"] for r in clustering.label_warnings(clustering.label_clusters(prompts, complete), [2, 9], 5).where("warning = 'unreadable_answer'").collect()}
    assert details == {"unlabelled_cluster_3: no JSON object", "unlabelled_cluster_4: no answer"}


def test_sweep_flags(spark):
    k = lambda *s: spark.createDataFrame([(i + 2, x, 1.0) for i, x in enumerate(s)], "k int, silhouette double, inertia double")
    assert clustering.best_k(k(0.1, 0.3, 0.3)).first()["k"] == 3
    assert clustering.sweep_flags(k(0.2, 0.2, 0.1)).first().asDict() == {"weak": True, "monotone": True}
    assert clustering.sweep_flags(k(0.5)).first().asDict() == {"weak": False, "monotone": False}
    assert clustering.sweep_flags(k(0.1, 0.3)).first()["monotone"] is False


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in v.select(l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_sweep_covers_the_reference(spark, monkeypatch):
    seen, real = {}, inspect.signature(clustering.sweep_k)

    def sweep_k(*args, **options):
        held = real.bind(*args, **options)
        held.apply_defaults()
        seen.update(held.arguments)
        return spark.createDataFrame([(8, 0.3, 1.0)], "k int, silhouette double, inertia double")

    monkeypatch.setattr(clustering, "sweep_k", sweep_k)
    registry.kmeans_sweep(spark, "/root/testdata/sf0.001")
    assert (list(seen["ks"]), seen["runs"], seen["sample"]) == (list(range(8, 15)), 3, 5000)


def test_kappa_and_strata(spark):
    p = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "a string, b string")
    assert records.kappa(p, "a", "b").first().asDict() == {"n": 4, "kappa": 0.5}
    s = spark.createDataFrame([("A", "x", "x"), ("B", "x", "y"), ("B", None, "y")], "stratum string, label_intent string, predicted string")
    assert {r["stratum"]: (r["n"], r["accuracy"]) for r in records.per_stratum(s).collect()} == {"A": (1, 1.0), "B": (1, 0.0)}


def test_limits():
    now = [0.0]
    b = budget.Quota({"calls": 60}, 60, clock=lambda: now[0])
    b.charge({"calls": 60})
    assert b.delay({"calls": 30}) == 30
    now[0] = 30
    assert b.holds("calls") == 30
    b.charge({"calls": 60})
    assert b.delay({"calls": 1}) == 31
    slept = []
    lim = budget.Quota({"calls": 60, "tokens": 100}, per_day=2, clock=lambda: now[0], sleep=slept.append)
    lim.enter(calls=1, tokens=100)
    assert lim.enter(calls=1, tokens=50) == 30.0 and slept == [30.0]
    with pytest.raises(RuntimeError):
        lim.enter(calls=1, tokens=1)
    lim.correct("tokens", 50, 40)
    assert lim.holds("tokens") == -50
    lim.correct("tokens", 50, 60)
    assert lim.holds("tokens") == -60
    with pytest.raises(ValueError):
        budget.Quota({"calls": 0})
    assert (budget.retry_delay(2, 503), budget.retry_delay(0, 429, 7.0), budget.retry_delay(0, 404)) == (4.0, 7.0, None)


def test_stream_of_records(spark, tmp_path):
    source = tmp_path / "in"
    schema = "k long, v string, seq long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).coalesce(1).write.parquet(str(source))
    table = LatestTable(str(tmp_path / "t"), schema, "k", "seq")
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    table.start(stream(), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(1, "late", 0), (2, "new", 5)], schema).coalesce(1).write.mode("append").parquet(str(source))
    table.start(stream(), str(tmp_path / "c")).awaitTermination()
    assert {r["k"]: r["v"] for r in table.read(spark).collect()} == {1: "a", 2: "new"}
    # after a restart another object goes on from what is there
    spark.createDataFrame([(3, "c", 1)], schema).coalesce(1).write.mode("append").parquet(str(source))
    again = LatestTable(str(tmp_path / "t"), schema, "k", "seq")
    assert again.read(spark).count() == 2
    again.start(stream(), str(tmp_path / "c")).awaitTermination()
    assert {r["k"]: r["v"] for r in again.read(spark).collect()} == {1: "a", 2: "new", 3: "c"}


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["k"], r["n"]) for r in windowed_counts(rows, "ts", "k").collect()) == [("a", 2), ("b", 1)]


def test_share_rules(spark):
    def rules(*rows):
        df = spark.createDataFrame([(f"l{i}", "d", source, "review", share, None) for i, (source, share) in enumerate(rows)], taxonomy.SCHEMA)
        return {r["rule"] for r in taxonomy.share_violations(df).collect()}

    assert taxonomy.share_violations(taxonomy.curated(spark)).count() == 0
    assert rules(("cluster", 0.97), ("keyword", 0.2)) == set() == rules(("cluster", 0.5), ("cluster", 0.525), ("keyword", 0.1))  # 1.025 is within 0.03
    assert rules(("cluster", 0.969)) == {"cluster_shares_sum"} == rules(("cluster", 0.531), ("cluster", 0.5))
    assert rules(("cluster", 1.0), ("keyword", 0.9), ("keyword", 0.9)) == {"keyword_shares_sum"}
    assert rules(("cluster", 0.97), ("keyword", 0.01)) == {"all_shares_sum"}
    assert rules(("cluster", None), ("keyword", None)) == set()


def test_label_rules(spark):
    rows = [(1, "praise_thanks", "auto", None), (2, "refund_or_compensation", "auto", ""), (3, "praise_thanks", "escalate", "mood"), (4, None, None, None), (5, "other", "escalate", ""), (6, "x", "maybe", "other"), (7, "refund_or_compensation", "escalate", "high_risk_intent"), (8, "refund_or_compensation", None, None)]
    labels = spark.createDataFrame(rows, "tweet_id long, label_intent string, label_action string, label_reason string")
    got = sorted((r["id"], r["rule"]) for r in taxonomy.label_violations(labels, taxonomy.curated(spark)).collect())
    assert got == [(2, "not_escalated"), (3, "unknown_reason"), (5, "no_reason"), (6, "reason_without_escalation"), (6, "unknown_action"), (6, "unknown_intent"), (8, "not_escalated")]


def test_views_and_audit(spark, tmp_path):
    seen = {r["label"]: (r["tier"], r["share"]) for r in taxonomy.view(taxonomy.curated(spark)).collect()}
    assert seen["praise_thanks"] == ("auto_ok", "20.0%") and seen["other"] == ("review", "-")
    assert taxonomy.summary(taxonomy.curated(spark)).first().asDict() == {"intents": 13, "cluster_total": "99.9%", "always_escalate": "accessibility_medical, refund_or_compensation"}
    clusters = spark.createDataFrame([(0, "baggage_issue", "Lost bags.", 120, ["m1", "m2"], "raw")], "cluster_id int, label string, description string, size long, representatives array<string>, raw string")
    sweep = spark.createDataFrame([(4, 0.3, 90.0), (3, 0.4, 100.0)], "k int, silhouette double, inertia double")
    files.write_taxonomy(clusters, sweep, str(tmp_path))
    made = {n: json.loads(spark.read.text(f"{tmp_path}/{n}").first()[0]) for n in ("taxonomy", "audit")}
    assert [i["label"] for i in made["taxonomy"]["intents"]] == ["baggage_issue", "other"] and made["taxonomy"]["intents"][0]["cluster_id"] == 0
    assert [k["k"] for k in made["audit"]["k_sweep"]] == [3, 4] and made["audit"]["chosen_k"] == 1
    assert made["audit"]["clusters"] == [{"cluster_id": 0, "label": "baggage_issue", "description": "Lost bags.", "size": 120, "representatives": ["m1", "m2"], "raw": "raw"}]


def test_config(spark, tmp_path):
    good = {
        "project": {}, "providers": {"a": {"rpm": 30, "tpm": 6000}, "b": {"rpm": 1, "tpm": 1, "enabled": False}}, "roles": {"label": {"primary": {"provider": "a", "model": "m"}, "fallbacks": [{"provider": "b", "model": "n"}]}},
        "embedding": {"model": "e", "dim": 384, "dtype": "float16"}, "data": {"split_quantile": 0.7, "near_duplicate_cosine": 0.95}, "golden": {"size": 200, "stratum_a": 100, "stratum_b": 100},
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(good))
    assert files.checked_config(str(path)) == good
    assert [tuple(r)[:5] for r in files.roles_view(spark, good).collect()] == [("label", 0, "a", "m", True), ("label", 1, "b", "n", False)]
    assert files.config_problems({k: v for k, v in good.items() if k != "data"}) == ["data is missing"]
    harmed = json.loads(json.dumps(good))
    harmed["providers"]["a"]["rpm"] = 0
    harmed["roles"]["label"]["primary"]["provider"] = "c"
    harmed["data"]["split_quantile"] = 1
    harmed["golden"]["size"] = 150
    path.write_text(json.dumps(harmed))
    with pytest.raises(ValueError, match="rpm.*roles.label.provider.*split_quantile.*golden"):
        files.checked_config(str(path))
