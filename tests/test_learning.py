"""Text models on a corpus that separates, and sinks."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.operators import evaluation as ev
from riskloom.operators import learning as L
from riskloom.operators import side_by_side as S
from riskloom.sources import sinks


@pytest.fixture(scope="module")
def corpus(spark):
    good, bad = "meeting notes agenda lunch project review", "prize winner claim cash urgent transfer"
    rows = [(i, " ".join((bad if i % 2 else good).split()[j % 6] for j in range(i % 5, i % 5 + 4)) + f" w{i % 7}", i % 2, f"g{i // 2}") for i in range(60)]
    return L.group_folds(spark.createDataFrame(rows, "id int, text string, label int, group string"), group=F.col("group"), folds=3).cache()


def test_folds_keep_groups(corpus):
    assert L.fold_leaks(corpus, "group").count() == 0 and corpus.select("fold").distinct().count() == 3


def test_models_separate(corpus):
    features = L.text_features(min_df=1.0, max_df=1.0, vocabulary=500)
    model = L.fit_text_model(corpus, features=features)
    rows = L.scores(model, corpus)
    assert ev.rank_metrics(rows, ev.threshold_table(rows)).first().roc_auc > 0.99
    assert len(L.top_terms(model, 3)) == 3
    assert L.contributions(model, corpus.limit(2), "id", 2).count() <= 4
    svc, curve = L.fit_calibrated_svc(corpus, features=features)
    bayes = L.fit_naive_bayes(corpus, features=features)
    assert L.choose({"svc": lambda d: L.calibrated(svc, curve, d), "nb": lambda d: L.scores(bayes, d)}, corpus) in ("svc", "nb")


def test_every_source_is_left_out(spark, corpus):
    source = F.element_at(F.array(*map(F.lit, ["a", "b", "c"])), (F.col("id") % 6 / 2).cast("int") + 1)
    rows = corpus.select("text", "label", F.when(F.col("id") < 50, source).when((F.col("id") < 55) & (F.col("label") == 1), "one label").when(F.col("id") >= 55, F.lit(None)).otherwise("a").alias("source"))
    trained = []

    def fit(train):
        trained.append({r.source for r in train.select("source").distinct().collect()})
        return L.fit_text_model(train, features=L.text_features(min_df=1.0))

    out = {r.source: r for r in L.leave_one_source_out(rows, fit=fit).collect()}
    every = {"a", "b", "c", "one label"}
    assert set(out) == every and trained == [every - {s} | {None} for s in sorted(every)]
    assert all(out[s].roc_auc > 0.99 for s in "abc")
    assert out["one label"].roc_auc is None and out["one label"].average_precision is None and out["one label"].brier is not None
    alone = L.leave_one_source_out(rows.where("source = 'a' OR (source = 'b' AND label = 1)"), fit=fit).collect()
    assert {r.source: r.brier is None for r in alone} == {"a": True, "b": False}


def test_query_leaves_out_the_sources_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    labelled = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL")
    want = {r.source for r in spark.read.parquet(f"{sf}/documents.parquet").join(labelled, "doc_id", "left_semi").select("source").distinct().collect()}
    got = [r.source for r in entry.queries()["loso_eval"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_more_features_and_folds(spark, corpus, tmp_path):
    words = L.text_features(min_df=1.0, max_df=1.0, vocabulary=500, stop_words=["and"])
    one = L.Pipeline(stages=words[:6]).fit(spark.createDataFrame([("aa bb aa and aa",)], "text string"))
    row = one.transform(spark.createDataFrame([("aa bb aa and aa",)], "text string")).first()
    got = {one.stages[4].vocabulary[i]: v for i, v in zip(row["_ltf"].indices.tolist(), row["_ltf"].values.tolist(), strict=True)}
    assert got["aa"] == pytest.approx(1 + 1.0986, abs=1e-3) and got["bb"] == 1.0 and "and" not in got
    both = L.fit_text_model(corpus, features=L.union_features(min_df=1.0, max_df=1.0, vocabulary=300))
    rows = L.scores(both, corpus)
    assert ev.rank_metrics(rows, ev.threshold_table(rows)).first().roc_auc > 0.99 and len(L._vocabulary(both)) == len(both.stages[-1].coefficients)
    fit = lambda d: L.fit_text_model(d, features=L.text_features(min_df=1.0, max_df=0.999, vocabulary=500))
    held = L.out_of_fold(corpus, 3, fit, "id")
    assert held.select("id").distinct().count() == corpus.count() == held.count()
    parts = L.conditions({"all": corpus.where("fold <> 0"), "half": corpus.where("fold = 1")}, corpus.where("fold = 0"), "group", fit).collect()
    assert [r.condition for r in parts] == ["all", "half"] and parts[0].roc_auc > 0.9
    model = fit(corpus)
    L.save_model(model, f"{tmp_path}/m", rows=60)
    again, about = L.load_model(spark, f"{tmp_path}/m")
    assert about == {"rows": 60} and L.scores(again, corpus).exceptAll(L.scores(model, corpus)).count() == 0
    top = L.contributions(model, corpus.limit(3), "id", 3).collect()
    assert top and all(not (a.id == b.id and a.term != b.term and a.term in b.term and a.weight > b.weight) for a in top for b in top)
    shouting = L.Pipeline(stages=[L.FromFunction(lambda d: d.withColumn("n", F.length("text")))]).fit(corpus).transform(corpus)
    assert "n" in shouting.columns


def test_stratified_folds(spark):
    rows = [(f"g{i}", int(i % 4 == 0 or (i % 5 == 0 and k))) for i in range(400) for k in range(1 + i % 3)]
    out = L.stratified_group_folds(spark.createDataFrame(rows, "group string, label int"), group_col="group", label_col="label", folds=4)
    assert out.count() == len(rows) and L.fold_leaks(out, "group").count() == 0
    share = [r.p / r.n for r in out.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()]
    assert len(share) == 4 and max(share) - min(share) < 0.12


def test_tabular_models(spark):
    rows = [(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(210)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    for kind in L.TABULAR:
        m = L.class_metrics(L.fit_tabular(df, ["a", "b"], kind), df).first()
        assert m.accuracy > 0.95 and m.f1 > 0.95 and 0 <= m.precision <= 1 and 0 <= m.recall <= 1


def test_character_grams(spark):
    out = spark.createDataFrame([("Ab cde",)], "t string").select(L.character_grams(F.col("t"), 3, 4)).first()[0]
    assert out == [" ab", "ab ", " ab ", " cd", "cde", "de ", " cde", "cde "]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "holdout")], "id int, role string")
    sinks.write_split(df, f"{tmp_path}/split")
    assert spark.read.parquet(f"{tmp_path}/split").where("role = 'holdout'").count() == 1
    sinks.write_report(df, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").columns == ["id", "role"]
    sinks.snapshot(df, f"{tmp_path}/snap")
    assert sinks.restore(spark, f"{tmp_path}/snap").count() == 2
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/snap/table")
    with pytest.raises(ValueError):
        sinks.restore(spark, f"{tmp_path}/snap")
    templates = spark.createDataFrame([("Pay {amount} to {who}", 1), ("Hi {who}", 0)], "template string, label int")
    out = sinks.from_templates(templates, 24, {"amount": ["1", "2"], "who": ["a", "b", "c"]})
    assert out.count() == 48 and out.where(F.col("text").contains("{")).count() == 0 and out.select("group_id").distinct().count() == 2


def test_sources_side_by_side(spark, corpus, monkeypatch):
    """The models that are fitted at once give the metrics of a fit for each source, over more models than are solved at once, whichever way
    their terms are found; rows of a null source train, those without a text or a label do no harm."""
    monkeypatch.setattr(S, "SOLVED", 2)
    noise = F.concat_ws(" ", "text", F.when(F.col("id") % 9 == 0, "cash agenda prize").when(F.col("id") % 7 == 0, "lunch review urgent urgent"))
    source = F.element_at(F.array(*map(F.lit, ["a", "b", "c"])), (F.col("id") % 6 / 2).cast("int") + 1)
    rows = corpus.select(noise.alias("text"), "label", F.when(F.col("id") < 55, source).when(F.col("id") % 2 == 1, "one label").alias("source"))
    want = {r.source: r for r in L.leave_one_source_out(rows, fit=lambda d: L.fit_text_model(d, features=L.text_features(vocabulary=30))).collect()}
    odd = spark.createDataFrame([("cash", None, "a")], "text string, label int, source string")
    for first in (2.0, 0.5):
        monkeypatch.setattr(S, "FIRST", first)
        got = {r.source: r for r in S.leave_one_source_out(rows.unionByName(odd), vocabulary=30).collect()}
        assert set(got) == set(want) == {"a", "b", "c", "one label"}
        for s, r in want.items():
            assert (got[s].roc_auc is None) == (r.roc_auc is None) and got[s].brier == pytest.approx(r.brier, abs=2e-3)
            assert r.roc_auc is None or (got[s].roc_auc == pytest.approx(r.roc_auc, abs=0.02) and got[s].average_precision == pytest.approx(r.average_precision, abs=0.02))
    alone = S.leave_one_source_out(rows.where("source = 'a' OR (source = 'b' AND label = 1)")).collect()
    assert {r.source: r.brier is None for r in alone} == {"a": True, "b": False}


def test_first_terms_are_the_terms(spark, corpus, monkeypatch):
    rows = S.term_rows(corpus.select("text", "label", F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source")))
    sizes = {s: rows.where(~F.col("source").eqNullSafe(s)).count() for s in ("s1", "s2")}
    plain = lambda made: [{t: n for t, n in zip(made[0].to_pylist(), row, strict=True) if n} for row in made[1]]
    want = plain(S.vocabularies(S.term_counts(rows), sizes, 20, 3.0, 0.95))
    assert plain(S.first_vocabularies(rows, S.first_terms(rows, sizes, 20, 3.0), sizes, 20, 3.0, 0.95) or (S.vocabularies(S.term_counts(rows), sizes, 20, 3.0, 0.95))) == want
    assert [len(x) for x in want] == [20, 20] and all(3 <= n <= 0.95 * k for x, k in zip(want, sizes.values(), strict=True) for n in x.values())
    monkeypatch.setattr(S, "FIRST", 1.0)
    assert S.first_vocabularies(rows, S.first_terms(rows, sizes, 20, 3.0), sizes, 20, 3.0, 0.95) is None  # others may belong to it


def test_one_pass_serves_all_sources(spark, corpus, monkeypatch):
    """The passes over the rows do not grow with the number of sources, as fits for each source do."""
    passes = []
    whole = S.passed
    monkeypatch.setattr(S, "passed", lambda *a: passes.append(1) or whole(*a))
    rows = corpus.select("text", "label", F.concat(F.lit("s"), (F.floor(F.col("id") / 2) % 5).cast("string")).alias("source"))
    assert S.leave_one_source_out(rows).count() == 5 and len(passes) < 100
