"""Text classification: folds that keep groups whole, TF-IDF features, linear models, held-out metrics."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from riskloom.functions import words as W
from riskloom.operators import evaluation as ev
from riskloom.plans.folders import shared_folder


def group_folds(df: DataFrame, *, group: Column, folds: int, salt: str = "fold") -> DataFrame:
    """Adds fold, the same for all rows of a group: by the group's salted digest, which balances many groups well and needs
    neither a shuffle nor the driver."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), group.cast("string")).cast("binary"), 256)
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int"))


def stratified_group_folds(df: DataFrame, *, group_col: str, label_col: str, folds: int, salt: str = "fold") -> DataFrame:
    """Adds fold, the same for all rows of a group, so that the folds have the labels in like shares: groups are dealt in
    turn, those of like size and share of positive rows after one another. Dealing goes on in 256 parts side by side, by
    the groups' digests, so it is no one task's work; a part is uneven by one group at most."""
    per = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label_col).cast("long")).alias("_p"))
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.col(group_col).cast("string")).cast("binary"), 256)
    per = per.withColumns({"_d": digest, "_kind": F.when(F.col("_p") == 0, 0).when(F.col("_p") == F.col("_n"), 2).otherwise(1)})
    place = F.row_number().over(Window.partitionBy("_kind", F.substring("_d", 1, 2)).orderBy(F.desc("_n"), "_d"))
    start = F.conv(F.substring("_d", 1, 2), 16, 10).cast("int")  # parts begin with different folds
    dealt = per.select(F.col(group_col).alias("_g"), ((place + start) % folds).cast("int").alias("fold"))
    return df.join(dealt, F.col(group_col).eqNullSafe(F.col("_g"))).drop("_g")


def fold_leaks(df: DataFrame, group_col: str) -> DataFrame:
    """Groups that stand in more than one fold; none in a sound split."""
    return df.groupBy(group_col).agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


@udf(VectorUDT())
def _log_counts(v):
    return Vectors.sparse(v.size, v.indices, 1.0 + np.log(v.values)) if len(v.values) else v


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts as 1 + ln(count)."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), _log_counts(F.col(self.getInputCol())))


class CharacterGrams(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Character n-grams inside padded words; see character_grams."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        # A step of its own in the plan: a Python function over what array functions make is not split off otherwise.
        return W.once(df, self.getOutputCol(), character_grams(F.col(self.getInputCol())))


class FromFunction(Transformer):
    """A function from DataFrame to DataFrame as a pipeline's step."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.function(df)


def text_features(text_col: str = "text", *, vocabulary: int = 40_000, min_df: float = 3.0, max_df: float = 0.95, stop_words: list[str] | None = None) -> list:
    """Stages: words without stop words (English ones by default) and word pairs, 1 + ln of their counts, inverse document
    frequencies, unit length."""
    words = RegexTokenizer(inputCol=text_col, outputCol="_w0", pattern=r"(?U)\W+", minTokenLength=2)
    stops = StopWordsRemover(inputCol="_w0", outputCol="_w1", stopWords=StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words)
    pairs = NGram(n=2, inputCol="_w1", outputCol="_w2")
    terms = SQLTransformer(statement="SELECT *, concat(_w1, _w2) AS _terms FROM __THIS__")
    counts = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocabulary, minDF=min_df, maxDF=max_df)
    return [words, stops, pairs, terms, counts, LogCounts("_tf", "_ltf"), IDF(inputCol="_ltf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features", p=2.0)]


def character_features(text_col: str = "text", *, vocabulary: int = 40_000, min_df: float = 5.0, output: str = "char_features") -> list:
    """The same over character n-grams of 3 to 5 inside words."""
    counts = CountVectorizer(inputCol="_grams", outputCol="_ctf", vocabSize=vocabulary, minDF=min_df)
    return [CharacterGrams(text_col, "_grams"), counts, LogCounts("_ctf", "_cltf"), IDF(inputCol="_cltf", outputCol="_cidf"), Normalizer(inputCol="_cidf", outputCol=output, p=2.0)]


def union_features(text_col: str = "text", **options) -> list:
    """Words and characters side by side."""
    words, chars = text_features(text_col, **options), character_features(text_col, **{k: v for k, v in options.items() if k in ("vocabulary", "min_df")})
    words[-1].setOutputCol("_word_features")
    chars[-1].setOutputCol("_char_features")
    return [*words, *chars, VectorAssembler(inputCols=["_word_features", "_char_features"], outputCol="features")]


def balanced(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds weight: rows / (2 × rows of the row's label)."""
    per = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = per.crossJoin(total).select(F.col(label_col).alias("_l"), (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), F.col(label_col) == F.col("_l")).drop("_l")  # a row for each label


def fit_text_model(train: DataFrame, *, features: list | None = None, c: float = 4.0):
    """A pipeline from text to probability. The terms are written to the shared folder before the vocabulary is learned, and
    the features before the solver begins, so that no pass computes them again; train needs label, and text for the
    features."""
    stages = list(features or text_features())
    first = next((i for i, s in enumerate(stages) if isinstance(s, Estimator)), len(stages))
    lead = PipelineModel(stages[:first])
    rows = lead.transform(balanced(train))
    rows = written(rows.select(*[c for c in rows.columns if c not in ("_w0", "_w1", "_w2")]))
    made = Pipeline(stages=stages[first:]).fit(rows)
    held = written(made.transform(rows).select("features", "label", "weight"))
    made = PipelineModel([*lead.stages, *made.stages])
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (c * max(1, held.count())), standardization=False, maxIter=50).fit(held)
    return PipelineModel([*made.stages, model])


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    where = scratch_path(df.sparkSession, "features")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def out_of_fold(df: DataFrame, folds: int, fit=fit_text_model, id_col: str | None = None) -> DataFrame:
    """score, label (and id) of every row under the model of the folds that it is not in."""
    out = None
    for k in range(folds):
        model = fit(df.where(F.col("fold") != k))
        part = model.transform(df.where(F.col("fold") == k)).select(*([id_col] if id_col else []), F.round(vector_to_array("probability")[1], 3).alias("score"), F.col("label").cast("int").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def conditions(train: dict[str, DataFrame], held: DataFrame, seeds_col: str, fit=fit_text_model) -> DataFrame:
    """Metrics of models of several training sets on one held-out set; rows whose seed stands in the held-out set never train."""
    seeds = held.select(F.col(seeds_col).alias("_s")).distinct()
    rows = []
    for name, part in train.items():
        own = part.join(seeds, part[seeds_col] == F.col("_s"), "left_anti")
        found = scores(fit(own), held)
        rows.append((name, *ev.rank_metrics(found, ev.threshold_table(found)).select("average_precision", "roc_auc", "brier").first()))  # three numbers
    return held.sparkSession.createDataFrame(rows, "condition string, average_precision double, roc_auc double, brier double")


#: Classifiers of numeric columns. Spark has no support vector machine with a radial kernel: the linear one stands for it.
TABULAR = {
    "forest": lambda: RandomForestClassifier(numTrees=100, featuresCol="features", labelCol="label", seed=42),
    "logistic": lambda: LogisticRegression(maxIter=100, featuresCol="features", labelCol="label"),
    "svm": lambda: LinearSVC(maxIter=50, featuresCol="features", labelCol="label"),
    "tree": lambda: DecisionTreeClassifier(maxDepth=10, featuresCol="features", labelCol="label", seed=42),
}


def fit_tabular(train: DataFrame, columns: list[str], kind: str):
    """Scaled columns and one of the TABULAR classifiers."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    return Pipeline(stages=[*stages, TABULAR[kind]()]).fit(train)


def class_metrics(model, df: DataFrame) -> DataFrame:
    """accuracy, and precision, recall and F1 weighted by the labels' shares, in one aggregation."""
    found = model.transform(df).groupBy(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = found.groupBy().agg(*[F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("n")).otherwise(0)).alias(f"c{y}{p}") for y in (0, 1) for p in (0, 1)])
    c = {k: F.col(f"c{k}").cast("double") for k in ("00", "01", "10", "11")}
    total = c["00"] + c["01"] + c["10"] + c["11"]
    share = {0: (c["00"] + c["01"]) / total, 1: (c["10"] + c["11"]) / total}
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision = {0: ratio(c["00"], c["00"] + c["10"]), 1: ratio(c["11"], c["11"] + c["01"])}
    recall = {0: ratio(c["00"], c["00"] + c["01"]), 1: ratio(c["11"], c["11"] + c["10"])}
    weigh = lambda m: F.round(sum((share[k] * m[k] for k in (0, 1)), F.lit(0.0)), 6)
    f1 = {k: ratio(2 * precision[k] * recall[k], precision[k] + recall[k]) for k in (0, 1)}
    return per.select(F.round((c["00"] + c["11"]) / total, 6).alias("accuracy"), weigh(precision).alias("precision"), weigh(recall).alias("recall"), weigh(f1).alias("f1"))


def save_model(model, path: str, **about) -> None:
    """A fitted pipeline in Spark's own format, and beside it what it was fitted on, as JSON."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/about").first().value)


def scores(model, df: DataFrame, digits: int = 3) -> DataFrame:
    """score(rounded) and label of each row."""
    return model.transform(df).select(F.round(vector_to_array("probability")[1], digits).alias("score"), F.col("label").cast("int").alias("label"))


def leave_one_source_out(df: DataFrame, sources: list[str] | None = None, fit=fit_text_model) -> DataFrame:
    """For each source (all that df has, if none are given) its metrics under a model fitted on the others, null if those
    have one label only. One fit for each source, as the method wants; rows of a null source are always among the others."""
    seen = [(r.source, r.label) for r in df.select("source", "label").distinct().collect()]  # two for each model at most
    out = []
    for s in sorted({x for x, _ in seen if x is not None}) if sources is None else sources:
        found = (None, None, None)
        if len({y for x, y in seen if x != s}) > 1:
            model = fit(df.where(~F.col("source").eqNullSafe(s)))
            held = scores(model, df.where(F.col("source") == s))
            # Taken at once, three numbers a source, so that one model is held at a time.
            found = tuple(ev.rank_metrics(held, ev.threshold_table(held)).select("average_precision", "roc_auc", "brier").first())
        out.append((*found, s))
    return df.sparkSession.createDataFrame(out, "average_precision double, roc_auc double, brier double, source string")


def character_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of the words, each word padded with a blank on both sides, as an array."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
    return F.flatten(F.transform(padded, lambda w: F.concat(*[cut(w, n) for n in range(low, high + 1)])))


def fit_naive_bayes(train: DataFrame, *, features: list | None = None, smoothing: float = 0.3):
    return Pipeline(stages=[*(features or text_features()), NaiveBayes(modelType="complement", smoothing=smoothing, featuresCol="features", labelCol="label")]).fit(train)


def fit_calibrated_svc(train: DataFrame, *, folds: int = 3, features: list | None = None):
    """A linear support vector machine, and a logistic curve fitted on scores of rows that its folds' models did not see.
    train has fold. Returns (model, curve); calibrated() applies both."""
    stages = features or text_features()
    svc = LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=30)
    seen = None
    for k in range(folds):
        model = Pipeline(stages=[*stages, svc]).fit(balanced(train.where(F.col("fold") != k)))
        part = model.transform(train.where(F.col("fold") == k)).select(F.slice(vector_to_array("rawPrediction"), 2, 1).alias("margin"), "label")
        seen = part if seen is None else seen.unionByName(part)
    curve = LogisticRegression(featuresCol="m", labelCol="label").fit(seen.select(array_to_vector("margin").alias("m"), F.col("label").cast("double").alias("label")))
    return Pipeline(stages=[*stages, svc]).fit(balanced(train)), curve


def calibrated(model, curve, df: DataFrame, digits: int = 3) -> DataFrame:
    """score and label of each row under a model of fit_calibrated_svc."""
    margins = model.transform(df).select(array_to_vector(F.slice(vector_to_array("rawPrediction"), 2, 1)).alias("m"), "label")
    return curve.transform(margins).select(F.round(vector_to_array("probability")[1], digits).alias("score"), F.col("label").cast("int").alias("label"))


def _vocabulary(model) -> list[str]:
    """Terms of the counting stages, in the order of the features."""
    return [t for stage in model.stages if hasattr(stage, "vocabulary") for t in stage.vocabulary]


def top_terms(model, n: int = 25) -> list[tuple[str, float]]:
    """The terms of largest weight of a text model; the vocabulary bounds what comes to the driver."""
    terms, weights = _vocabulary(model), model.stages[-1].coefficients.toArray()
    order = weights.argsort()[::-1][:n]
    return [(terms[i], float(weights[i])) for i in order]


def contributions(model, df: DataFrame, id_col: str, n: int = 8) -> DataFrame:
    """The n largest positive contributions (term, weight) of each row: value of the feature times its coefficient."""
    weights = df.sparkSession.createDataFrame([(i, t, float(w)) for i, (t, w) in enumerate(zip(_vocabulary(model), model.stages[-1].coefficients.toArray(), strict=True))], "i int, term string, w double")
    cells = model.transform(df).select(id_col, F.posexplode(vector_to_array("features")).alias("i", "v")).where("v <> 0").join(F.broadcast(weights), "i")  # the vocabulary: a bounded parameter
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("weight"), "term"))
    best = cells.where("v * w > 0").select(id_col, "term", F.round(F.col("v") * F.col("w"), 6).alias("weight")).withColumn("place", place).where(F.col("place") <= 4 * n)
    # A term that an earlier one holds says nothing new: of a bounded list, those that no earlier one holds, the first n.
    top = best.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "term", "weight"))).alias("top"))
    new = F.filter("top", lambda t: ~F.exists("top", lambda o: (o["place"] < t["place"]) & F.contains(o["term"], t["term"])))
    return top.select(id_col, F.explode(F.slice(new, 1, n)).alias("t")).select(id_col, "t.term", "t.weight")


def choose(models: dict, held: DataFrame, margin: float = 0.001) -> str:
    """The model of best average precision on held rows; the first wins within the margin."""
    best, top = "", -1.0
    for name, score in models.items():
        rows = score(held)
        value = ev.rank_metrics(rows, ev.threshold_table(rows)).first().average_precision or 0.0
        if value > top + (margin if best else 0):
            best, top = name, value
    return best
