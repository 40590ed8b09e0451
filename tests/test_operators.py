"""Operators on small hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.functions import network as N
from riskloom.functions import stats as S
from riskloom.functions import text as T
from riskloom.operators import evaluation as ev
from riskloom.operators import families as fam
from riskloom.operators import matching as M
from riskloom.operators import rules as R
from riskloom.operators import state as st
from riskloom.plans import record_queries


@pytest.mark.parametrize("k, n, low, high", [(2, 2, 0.3424, 1.0), (0, 2, 0.0, 0.6576), (4, 4, 0.5101, 1.0), (0, 4, 0.0, 0.4899), (426, 500, 0.818, 0.88), (25, 500, 0.034, 0.073)])
def test_wilson(spark, k, n, low, high):
    row = spark.range(1).select(S.wilson_low(F.lit(k), F.lit(n)).alias("a"), S.wilson_high(F.lit(k), F.lit(n)).alias("b")).first()
    assert row.a == pytest.approx(low, abs=6e-4) and row.b == pytest.approx(high, abs=6e-4)


def test_wilson_without_data(spark):
    assert spark.range(1).select(S.wilson_low(F.lit(0), F.lit(0))).first()[0] is None


def test_family_masks_and_is_stable(spark):
    df = spark.createDataFrame([("Pay 12 now at https://x.example/a  or mail Me@Example.com",), ("pay 99 now at http://y.example or mail you@example.com",)], "t string")
    assert df.select(T.family_id(F.col("t"))).distinct().count() == 1


def test_model_text_is_idempotent(spark):
    df = spark.createDataFrame([("> On 12:30 pm in 2024 see www.example.com/a. Total 1,234.50 to a@b.example",)], "t string")
    once = df.select(T.model_text(F.col("t")).alias("t"))
    assert once.first()[0] == once.select(T.model_text(F.col("t"))).first()[0]
    assert "zzemail" in once.first()[0] and "zzurl" in once.first()[0]


def test_dedup_drops_conflicts(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "b", 1), (5, "c", None)], "id int, family string, label int")
    row = fam.removal_counts(fam.dedup(df, label_col="label", order=[F.col("id")])).first()
    assert (row.kept_rows, row.duplicate_rows, row.conflict_rows) == (2, 1, 2)
    assert sorted(r.id for r in fam.dedup_rows(df, label_col="label", order_col="id").collect()) == [1, 5]


def test_time_partitions_keep_families_whole(spark):
    df = spark.createDataFrame([("f", "2020-01-01"), ("f", "2024-05-05"), ("g", None), ("h", "2025-02-02")], "family string, d string").withColumn("d", F.col("d").cast("date"))
    out = {(r.family, r.role) for r in fam.time_partitions(df, ts_col="d", validation_from="2024-01-01", holdout_from="2025-01-01", family_col="family").collect()}
    assert out == {("f", "validation"), ("g", "train"), ("h", "holdout")}


def test_components_join_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    out = {r.node: r.component for r in M.components(spark, edges).collect()}
    assert set(out[i] for i in range(1, 41)) == {1} and out[101] == 100


def test_components_of_paths_in_any_order_take_few_rounds_and_small_plans(spark, monkeypatch):
    """Labels of regions that touch far from their least node took a round for each step, and the planner's size estimates doubled in digits."""
    order = random.Random(7).sample(range(48), 48)
    edges = [(f"n{a:02}", f"n{b:02}") for a, b in zip(order, order[1:])] + [("x", "y")]
    rounds, write = [], M._written
    monkeypatch.setattr(M, "_written", lambda df: rounds.append(1) or write(df))
    out = M.components(spark, spark.createDataFrame(edges, "a string, b string"))
    assert {r.node: r.component for r in out.collect()} == {**{f"n{i:02}": "n00" for i in order}, "x": "x", "y": "x"}
    assert len(rounds) <= 8 and out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40


def test_suffix_match_respects_label_borders(spark):
    reg = spark.createDataFrame([("example.com", "a"), ("b.example.com", "c")], "domain string, kind string")
    hosts = spark.createDataFrame([(1, "x.b.example.com"), (2, "notexample.com"), (3, "example.com")], "id int, host string")
    assert {r.id: r.matched for r in M.suffix_match(hosts, "host", reg, "domain", "id").collect()} == {1: "b.example.com", 2: None, 3: "example.com"}


def test_addresses(spark):
    row = spark.createDataFrame([("A.b+x@GMail.com",)], "a string").select(N.canonical_address(F.col("a"))).first()
    assert row[0] == "ab@gmail.com"
    assert spark.range(1).select(N.ipv4_number(F.lit("1.2.3.4"))).first()[0] == 16909060
    assert spark.range(1).select(N.ipv4_number(F.lit("1.2.3.400"))).first()[0] is None


def test_exact_limit_does_not_count_refusals(spark):
    rows = [(i, "u", t) for i, t in enumerate((0, 1, 2, 3, 61, 62))]
    df = spark.createDataFrame(rows, "event_id long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = {r.event_id: r.allowed for r in st.exact_limit(df, "user", 60, 2).collect()}
    assert out == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_thresholds(spark):
    scores = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.2, 0), (0.1, 0)], "score double, label int")
    table = ev.threshold_table(scores)
    assert ev.best_under_fpr(table, 0.0).first().threshold == 0.9
    assert ev.best_f2(table).first().threshold == 0.8
    row = ev.rank_metrics(scores, table).first()
    assert row.roc_auc == pytest.approx((2 + 3) / 6 + 0.5 / 6)


def test_one_changed_cell_is_found(spark):
    rows = [(p, l, "phishing", "alerted") for p in "ab" for l in "xy"]
    good = ev.by_all_subsets(spark.createDataFrame(rows, "lang string, source string, label string, decision string"), ["lang", "source"])
    assert ev.unreconciled(good, ["lang", "source"], ["n"]).count() == 0
    bad = good.withColumn("n", F.when((F.col("lang") == "a") & F.col("source").isNull(), 9).otherwise(F.col("n")))
    assert ev.unreconciled(bad, ["lang", "source"], ["n"]).count() == 2


def test_verdict_levels(spark):
    cases = [(0, "safe", "safe"), (3, "safe", "low"), (8, "safe", "medium"), (9, "safe", "high"), (16, "safe", "critical"), (2, "medium", "medium"), (1, "high", "high")]
    df = spark.createDataFrame(cases, "p int, f string, want string")
    assert df.where(R.content_verdict(F.col("p"), F.col("f")) != F.col("want")).count() == 0


def test_folds(spark):
    from riskloom.operators import folds

    rows = [("u", i, t, op, r) for i, (t, op, r) in enumerate([(0, "reserve", "a"), (1, "reserve", "a"), (2, "reserve", "b"), (3, "reserve", "c"), (4, "release", "b"), (5, "reserve", "c"), (90_000, "reserve", "a"), (90_001, "finish", "zz")])]
    df = spark.createDataFrame(rows, "user string, event_id long, t long, op string, request string")
    out = [(r.result, r.remaining) for r in folds.quota_receipts(df, "user", "t", "op", "request", 2).orderBy("event_id").collect()]
    assert out == [("granted", 1), ("repeated", 1), ("granted", 0), ("refused", 0), ("released", 1), ("granted", 0), ("granted", 1), ("unknown", 1)]
    hits = [(r.window_count, r.allowed, r.retry_after) for r in folds.first_hit_window(df, "user", "t", 3, 2).orderBy("event_id").collect()]
    assert hits == [(1, True, 0), (2, True, 0), (3, False, 1), (1, True, 0), (2, True, 0), (3, False, 1), (1, True, 0), (2, True, 0)]
    assert [r.session for r in folds.capped_sessions(df, "user", "t", 1800, 4).orderBy("event_id").collect()] == [1, 1, 1, 1, 2, 2, 3, 3]
    assert folds.versioned_updates(df.limit(0).withColumn("v", F.lit(0)), "user", "v").count() == 0


def brute_components(rows):
    """Components of values that share a key, those of one value left out."""
    groups = []
    for key in {k for k, _ in rows}:
        values = {v for k, v in rows if k == key and v is not None}
        touching = [g for g in groups if g & values]
        groups = [g for g in groups if not g & values] + [values.union(*touching)]
    return {v: min(g) for g in groups if len(g) > 1 for v in g}


def test_components_of_shared_keys_over_all_rows(spark):
    rows = [(1, 10), (1, 11), (1, 10), (2, 11), (2, 12), (2, None), (3, 20), (3, 21), (4, 30), (5, 22), (5, 21), (5, 23), (None, 30), (None, 20), (6, 40), (6, 41), (6, 42), (6, 43), (7, 43), (7, 12)]
    edges = M.shared_key_edges(spark.createDataFrame(rows, "k int, v int"), "k", "v")
    got = {r.node: r.component for r in M.components(spark, edges).collect()}
    assert got == brute_components([r for r in rows if r[0] is not None]) and edges.count() <= len(rows)


def test_campaign_components_of_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().collect()]
    got = {r.node: r.component for r in entry.queries()["campaign_components"](spark, sf).collect()}
    assert got == brute_components(rows)


def test_one_type_alone_needs_no_rounds(spark, monkeypatch, tmp_path):
    """Copies a-b, sizes b-c, and d-e alike in both: without texts a falls off, without sizes c does. Rounds are run for the whole only."""
    rows = [(5, "one", "x", "en", 3), (2, "one", "y", "en", 3), (3, "two", "y", "en", 3), (7, "six", "z", "en", 3), (8, "six", "z", "en", 3), (9, None, None, "en", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    calls, components = [], M.components
    monkeypatch.setattr(M, "components", lambda *a, **k: calls.append(1) or components(*a, **k))
    got = {tuple(r) for r in record_queries.splits_without_type(spark, str(tmp_path)).collect()}
    assert got == {("text", 2, 1), ("size", 2, 1)} and len(calls) == 1
