"""Training, evaluation, prediction with ``pyspark.ml``."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.columns import col, is_numeric, num, numeric_cols, resolve, text_cols
from quillframe.functions.density import Density
from quillframe.functions.linkage import Linkage
from quillframe.functions.ordered import index_rows
from quillframe.functions.profile import fit as fit_row, rows_of, safe_div, skew_g1
from quillframe.operators.analysis import report
from quillframe.operators.transform import train_test_split
from quillframe.plans.facts import column_facts
from quillframe.plans.features import FeatureConfig, Fitted, auto_features, fit_encode, fit_fill, fit_scale
from quillframe.plans.prepare import ID_NAME

SEED = 42


def classifiers(classes: int, features: int) -> dict[str, Callable]:
    def binary(make):
        return make() if classes == 2 else OneVsRest(classifier=make())

    return {
        "logistic_regression": lambda: LogisticRegression(maxIter=100),
        "decision_tree_clf": lambda: DecisionTreeClassifier(seed=SEED),
        "random_forest_clf": lambda: RandomForestClassifier(numTrees=100, seed=SEED),
        "gradient_boosting_clf": lambda: binary(lambda: GBTClassifier(maxIter=50, seed=SEED)),
        "hist_gb_clf": lambda: binary(lambda: GBTClassifier(maxIter=50, maxBins=64, seed=SEED)),
        "svc_clf": lambda: binary(lambda: LinearSVC()),
        "naive_bayes_clf": lambda: NaiveBayes(modelType="gaussian"),
        "mlp_clf": lambda: MultilayerPerceptronClassifier(layers=[features, 64, 32, classes], seed=SEED),
    }


def regressors() -> dict[str, Callable]:
    return {
        "linear_regression": lambda: LinearRegression(),
        "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
        "elastic_net": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5),
        "decision_tree_reg": lambda: DecisionTreeRegressor(seed=SEED),
        "random_forest_reg": lambda: RandomForestRegressor(numTrees=100, seed=SEED),
        "gradient_boosting_reg": lambda: GBTRegressor(maxIter=50, seed=SEED),
        "hist_gb_reg": lambda: GBTRegressor(maxIter=50, maxBins=64, seed=SEED),
    }


def clusterers(k: int) -> dict[str, Callable]:
    return {"kmeans": lambda: KMeans(k=k, seed=SEED), "gaussian_mixture": lambda: GaussianMixture(k=k, seed=SEED),
            "dbscan": lambda: Density(), "hierarchical": lambda: Linkage(k)}


# Parameters tried when tuning, per family.
GRID = {
    "LogisticRegression": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "LinearRegression": {"regParam": [0.0, 0.01, 0.1, 1.0]},
    "DecisionTreeClassifier": {"maxDepth": [3, 5, 8]}, "DecisionTreeRegressor": {"maxDepth": [3, 5, 8]},
    "RandomForestClassifier": {"maxDepth": [5, 8], "numTrees": [50, 100]}, "RandomForestRegressor": {"maxDepth": [5, 8], "numTrees": [50, 100]},
    "GBTClassifier": {"maxDepth": [3, 5], "stepSize": [0.05, 0.1]}, "GBTRegressor": {"maxDepth": [3, 5], "stepSize": [0.05, 0.1]},
    "LinearSVC": {"regParam": [0.0, 0.01, 0.1]}, "NaiveBayes": {"smoothing": [0.5, 1.0]}, "MultilayerPerceptronClassifier": {"stepSize": [0.03, 0.1]},
}


def detect_task(df: DataFrame, target: str | None, task: str = "auto") -> str:
    if task != "auto":
        return task
    if target is None:
        return "clustering"
    t = resolve(df, target)
    f = fit_row(df, n=F.count(F.lit(1)), u=F.count_distinct(col(t)), k=F.count(col(t).try_cast("double")))
    number = is_numeric(df, t) or (t in text_cols(df) and f["k"] / max(f["n"], 1) > 0.8)
    if df.schema[t].dataType.simpleString() == "boolean":
        return "classification"
    if f["u"] > 20:
        return "regression"
    if f["u"] / max(f["n"], 1) < 0.05 or not number:
        return "classification"
    return "regression"


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list[str]
    fitted: Fitted
    labels: list[str]
    log_target: bool


def preprocess(df: DataFrame, target: str, task: str, test_size: float = 0.2, auto: bool = True, seed: int = SEED) -> Prepared:
    """Split first, then fit everything on the training part: numbers from text, ids and empty columns dropped, nulls,
    one-hot below 15 levels else ordinal, log1p of a skewed target, scaling. ``label`` holds the target."""
    y = resolve(df, target)
    rows = df.where(col(y).isNotNull())
    f = column_facts(rows, distinct=[c for c in rows.columns if ID_NAME.search(c)])
    drop = [c for c, x in f["columns"].items() if c != y and (x["nulls"] == f["rows"] or (ID_NAME.search(c) and x["unique"] == f["rows"]))]
    number = [c for c in text_cols(rows) if c != y and c not in drop]
    if number:
        k = fit_row(rows, **{f"k{i}": F.count(col(c).try_cast("double")) for i, c in enumerate(number)}, **{f"n{i}": F.count(col(c)) for i, c in enumerate(number)})
        rows = rows.withColumns({c: col(c).try_cast("double") for i, c in enumerate(number) if k[f"n{i}"] and k[f"k{i}"] / k[f"n{i}"] > 0.8})
    labels: list[str] = []
    log_target = False
    if task == "classification":
        model = StringIndexer(inputCol=y, outputCol="label", stringOrderType="alphabetAsc").fit(rows.withColumn(y, col(y).cast("string")))
        labels = list(model.labels)
        rows = model.transform(rows.withColumn(y, col(y).cast("string"))).drop(y)
    else:
        rows = rows.withColumn("label", num(y)).drop(y)
        s = fit_row(rows, s=skew_g1(F.col("label")), a=F.min("label"))
        log_target = s["s"] is not None and abs(s["s"]) > 1 and s["a"] >= 0
        if log_target:
            rows = rows.withColumn("label", F.log1p("label"))
    split = train_test_split(rows, test_size, seed, "label" if task == "classification" else None)
    split = split.persist()  # every fit below reads it
    train, test = (split.where(F.col("_split") == s).drop("_split") for s in ("train", "test"))
    fitted = Fitted([{"kind": "drop", "columns": drop}])

    def add(step, tables=None):
        nonlocal train, test
        fitted.steps.append(step)
        fitted.tables.update(tables or {})
        one = Fitted([step], fitted.tables)
        train, test = one.transform(train), one.transform(test)

    train, test = train.drop(*drop), test.drop(*drop)
    add(fit_fill(train, skip=["label"]))
    facts = column_facts(train, distinct=text_cols(train))["columns"]
    add(*fit_encode(train, {c: "onehot" if facts[c]["unique"] < 15 else "ordinal" for c in text_cols(train)}, "none", "label"))
    rest = [c for c in train.columns if c != "label" and not is_numeric(train, c)]
    if rest:
        add({"kind": "drop", "columns": rest})
    if auto:
        for step in auto_features(train, "label").steps:
            add(step)
    add(fit_scale(train, "standard", ["label"]))
    features = [c for c in numeric_cols(train) if c != "label"]
    return Prepared(assemble(train, features), assemble(test, features), features, fitted, labels, log_target)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    missing = [c for c in features if c not in df.columns]
    if missing:
        df = df.withColumns({c: F.lit(0.0) for c in missing})
    named = df.select("*", *[F.coalesce(num(c), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(features)])
    out = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features").transform(named)
    return out.drop(*[f"_f{i}" for i in range(len(features))])


def with_folds(df: DataFrame, folds: int, stratify: bool, seed: int = SEED) -> DataFrame:
    """Add ``fold``: by position in a hash order inside each class, or by hash alone."""
    h = F.xxhash64(F.lit(seed), F.col("label"), F.hash(*[c for c in df.columns if c not in ("features", "label")] or [F.lit(0)]))
    if not stratify:
        return df.withColumn("fold", F.pmod(h, F.lit(folds)).cast("int"))
    ix = index_rows(df.withColumn("_h", h), ["_h"], "label").key_position()
    return ix.df.withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_h", "_idx", "_pos")


def classification_metrics(pred: DataFrame, probability: str | None = None) -> DataFrame:
    """(metric, value) from the confusion counts of ``label`` and ``prediction``; AUC and log loss when a probability is given."""
    cells = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("k")).collect()  # classes x classes rows
    n = sum(c["k"] for c in cells)
    names = sorted({c["label"] for c in cells} | {c["prediction"] for c in cells})
    m = np.zeros((len(names), len(names)))
    for c in cells:
        m[names.index(c["label"]), names.index(c["prediction"])] = c["k"]
    tp, actual, said = np.diag(m), m.sum(axis=1), m.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        precision = np.nan_to_num(tp / said)
        recall = np.nan_to_num(tp / actual)
        f1 = np.nan_to_num(2 * precision * recall / (precision + recall))
    w = actual / max(n, 1)
    accuracy = tp.sum() / max(n, 1)
    chance = (actual * said).sum() / max(n * n, 1)
    root = math.sqrt(max(n * n - (said ** 2).sum(), 0)) * math.sqrt(max(n * n - (actual ** 2).sum(), 0))
    rows = [("accuracy", accuracy), ("precision", (precision * w).sum()), ("recall", (recall * w).sum()), ("f1", (f1 * w).sum()),
            ("kappa", (accuracy - chance) / (1 - chance) if chance < 1 else 0.0), ("mcc", (tp.sum() * n - (actual * said).sum()) / root if root else 0.0)]
    if probability and probability in pred.columns:
        p = F.greatest(F.get(vector_to_array(probability), F.col("label").cast("int")), F.lit(1e-15))
        rows.append(("log_loss", fit_row(pred, v=F.avg(-F.log(p)))["v"]))
        if len(names) == 2:
            rows.append(("auc", BinaryClassificationEvaluator(rawPredictionCol=probability).evaluate(pred)))
    return report(pred, [(k, round(float(v), 6)) for k, v in rows], "metric string, value double")


def confusion_matrix(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count")).orderBy("label", "prediction")


def class_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    a = pred.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("label") == F.col("prediction")).alias("tp"))
    s = pred.groupBy(F.col("prediction").alias("class")).agg(F.count(F.lit(1)).alias("said"))
    t = a.join(s, "class", "left")
    p, q = F.coalesce(safe_div(F.col("tp"), F.col("said")), F.lit(0.0)), F.col("tp") / F.col("support")
    return t.select("class", F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.coalesce(safe_div(2 * p * q, p + q), F.lit(0.0)), 6).alias("f1"), "support")


def regression_metrics(pred: DataFrame, n_features: int = 1) -> DataFrame:
    """RMSE, MAE, R2, adjusted R2, MAPE, explained variance in one aggregation."""
    y, p = F.col("label"), F.col("prediction")
    e = y - p
    n = F.count(F.lit(1))
    one = pred.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - safe_div(F.avg(e * e), F.var_pop(y))).alias("r2"), n.alias("n"),
                   (F.avg(F.abs(e) / F.when(y != 0, F.abs(y))) * 100).alias("mape"), (1 - safe_div(F.var_pop(e), F.var_pop(y))).alias("explained_variance"))
    one = one.withColumn("adjusted_r2", 1 - (1 - F.col("r2")) * (F.col("n") - 1) / F.greatest(F.col("n") - n_features - 1, F.lit(1)))
    return rows_of(one, [F.struct(F.lit(k).alias("metric"), F.round(F.col(k), 6).alias("value")) for k in ("rmse", "mae", "r2", "adjusted_r2", "mape", "explained_variance")])


def clustering_metrics(pred: DataFrame, features: Sequence[str], cluster: str = "prediction") -> DataFrame:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin from centroid aggregates; noise (-1) is counted apart."""
    some = pred.where(F.col(cluster) >= 0)
    g = some.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(features)])
    d2 = sum(((num(c) - F.col(f"m{i}")) * (num(c) - F.col(f"m{i}")) for i, c in enumerate(features)), F.lit(0.0))
    inner = some.join(F.broadcast(g), cluster).groupBy(cluster).agg(F.sum(d2).alias("w"), F.avg(F.sqrt(d2)).alias("s"))
    rows = g.join(inner, cluster).collect()  # one row per cluster
    n, k = sum(r["n"] for r in rows), len(rows)
    c = np.array([[r[f"m{i}"] for i in range(len(features))] for r in rows])
    size, w, s = (np.array([r[x] for r in rows], dtype=float) for x in ("n", "w", "s"))
    centre = (c * size[:, None]).sum(axis=0) / max(n, 1)
    between = (size * ((c - centre) ** 2).sum(axis=1)).sum()
    out = [("clusters", float(k)), ("noise", float(pred.where(F.col(cluster) < 0).count()))]
    if k > 1:
        out.append(("calinski_harabasz", between / (k - 1) / (w.sum() / (n - k)) if w.sum() and n > k else 0.0))
        gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
        np.fill_diagonal(gap, np.inf)
        out.append(("davies_bouldin", float(((s[:, None] + s[None]) / gap).max(axis=1).mean())))
        data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(some.withColumns({f: num(f) for f in features}))
        out.append(("silhouette", ClusteringEvaluator(featuresCol="_v", predictionCol="_p").evaluate(data.withColumn("_p", F.col(cluster).cast("double")))))
    return report(pred, [(a, round(float(b), 6)) for a, b in out], "metric string, value double")


def score_curve(pred: DataFrame, score, points: int = 200) -> DataFrame:
    """ROC and precision-recall points: counts per score slice, then a running sum over at most ``points`` slices."""
    s = F.least(F.floor(score * points), F.lit(points - 1)).cast("int")
    g = pred.groupBy(s.alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label")).alias("p"))
    w = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, 0)  # at most ``points`` rows
    a = Window.partitionBy(F.lit(1))
    tp, seen = F.sum("p").over(w), F.sum("n").over(w)
    pos, total = F.sum("p").over(a), F.sum("n").over(a)
    return g.select((F.col("slice") / points).alias("threshold"), F.round(safe_div(seen - tp, total - pos), 6).alias("false_positive_rate"),
                    F.round(safe_div(tp, pos), 6).alias("recall"), F.round(safe_div(tp, seen), 6).alias("precision")).orderBy(F.desc("threshold"))


def residual_frame(pred: DataFrame, points: int = 500) -> DataFrame:
    """A hash sample of actual, predicted and residual."""
    return pred.orderBy(F.xxhash64(F.lit(SEED), "label", "prediction")).limit(points).select("label", "prediction", (F.col("label") - F.col("prediction")).alias("residual"))


def residual_histogram(pred: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, start, count) of all residuals in ``bins`` equal slices between the least and the largest; empty slices are
    left out, equal residuals fall into slice 0, rows without a residual are not counted."""
    e = (F.col("label") - F.col("prediction")).alias("e")
    rows = pred.select(e).where("e is not null")
    ends = fit_row(rows, lo=F.min("e"), hi=F.max("e"))
    lo, width = ends["lo"] or 0.0, ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) / bins
    slot = F.least(F.floor((F.col("e") - lo) / width), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    return rows.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("count")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("start"), "count").orderBy("bin")


def cluster_sizes(pred: DataFrame, cluster: str = "prediction") -> DataFrame:
    """Rows per cluster and their share of the clustered rows; noise (below 0) and nulls are left out."""
    g = pred.where(F.col(cluster) >= 0).groupBy(F.col(cluster).cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1))), 6)).orderBy("cluster")  # one row per cluster


def learning_curve(data: Prepared, task: str, algorithm: str, shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """Test score by share of the training rows."""
    ev = evaluator(task)
    rows = []
    for s in shares:
        part = data.train.where(F.pmod(F.xxhash64("features"), F.lit(1000)) < int(s * 1000))
        model = algorithms(task, data)[algorithm]().fit(part)
        rows.append((float(s), round(float(ev.evaluate(model.transform(data.test))), 6)))
    return report(data.train, rows, "share double, score double")


def algorithms(task: str, data: Prepared) -> dict[str, Callable]:
    return classifiers(max(len(data.labels), 2), len(data.features)) if task == "classification" else regressors()


def evaluator(task: str):
    return MulticlassClassificationEvaluator(metricName="f1") if task == "classification" else RegressionEvaluator(metricName="rmse")


def cross_validate(data: Prepared, task: str, names: Sequence[str], folds: int = 5, parallelism: int = 2) -> DataFrame:
    """Mean and deviation of the fold scores (F1, or RMSE) per algorithm."""
    train = with_folds(data.train, folds, task == "classification").persist()
    rows = []
    for name in names:
        cv = CrossValidator(estimator=algorithms(task, data)[name](), estimatorParamMaps=[{}], evaluator=evaluator(task), numFolds=folds, foldCol="fold",
                            parallelism=parallelism).fit(train)
        rows.append((name, round(float(cv.avgMetrics[0]), 6), round(float(cv.stdMetrics[0]), 6)))
    train.unpersist()
    return report(data.train, rows, "algorithm string, mean double, std double")


def tune(data: Prepared, task: str, name: str, folds: int = 3, trials: int = 12, parallelism: int = 2, seed: int = SEED):
    """Best model of a random part of the grid; the defaults are always among the candidates, so tuning never loses to them."""
    est = algorithms(task, data)[name]()
    grid = GRID.get(type(est).__name__, {})
    builder = ParamGridBuilder()
    for k, v in grid.items():
        builder = builder.addGrid(est.getParam(k), v)
    maps = builder.build() if grid else [{}]
    rng = np.random.default_rng(seed)
    chosen = [{}, *[maps[i] for i in rng.permutation(len(maps))[:trials]]] if grid else [{}]
    train = with_folds(data.train, folds, task == "classification").persist()
    model = CrossValidator(estimator=est, estimatorParamMaps=chosen, evaluator=evaluator(task), numFolds=folds, foldCol="fold", parallelism=parallelism).fit(train)
    train.unpersist()
    return model.bestModel


@dataclass
class Trained:
    """The best model with everything needed to predict from raw rows."""

    task: str
    algorithm: str
    model: object
    fitted: Fitted
    features: list[str]
    labels: list[str]
    log_target: bool
    comparison: DataFrame | None = None
    importances: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Replay the steps, predict, undo the target transform, name the class; ``probability`` is the largest class probability."""
        rows = self.fitted.transform(df) if self.fitted else df
        out = self.model.transform(assemble(rows, self.features))
        if self.task == "classification":
            out = out.withColumn("predicted", F.get(F.lit(self.labels), F.col("prediction").cast("int")))
            if "probability" in out.columns:
                out = out.withColumn("probability", F.array_max(vector_to_array("probability")))
        elif self.task == "regression":
            out = out.withColumn("predicted", F.expm1("prediction") if self.log_target else F.col("prediction"))
        else:
            out = out.withColumn("predicted", F.col("prediction"))
        return out.drop("features", "rawPrediction", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        PipelineModel(stages=[self.model]).write().overwrite().save(f"{path}/model")
        self.fitted.save(spark, f"{path}/steps")
        meta = {"task": self.task, "algorithm": self.algorithm, "features": self.features, "labels": self.labels, "log_target": self.log_target}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trained:
        m = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()["value"])
        model = PipelineModel.load(f"{path}/model").stages[0]
        return Trained(m["task"], m["algorithm"], model, Fitted.load(spark, f"{path}/steps"), m["features"], m["labels"], m["log_target"])


def importance_frame(df: DataFrame, model, features: Sequence[str]) -> DataFrame | None:
    """Tree importances or absolute coefficients."""
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        v = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        v = np.abs(model.coefficients.toArray())
    else:
        return None
    return report(df, sorted(((f, float(x)) for f, x in zip(features, v)), key=lambda t: -t[1]), "feature string, importance double")


def train(df: DataFrame, target: str | None = None, task: str = "auto", names: Sequence[str] | None = None, folds: int = 5, tune_top: int = 3,
          clusters: int = 3, test_size: float = 0.2, trials: int = 0) -> Trained:
    """Cross-validate the algorithms, tune the best, keep the winner of the folds; the test scores only report.

    Tuning tries the grid, or with ``trials`` that many proposals of the search (``plans/search.py``); the trials are then in ``extra["trials"]``.
    """
    from quillframe.plans.search import search  # it builds on this module

    kind = detect_task(df, target, task)
    if kind == "clustering":
        return train_clusters(df, names, clusters)
    data = preprocess(df, target, kind, test_size)
    data.train.persist(), data.test.persist()
    pool = list(names or algorithms(kind, data))
    cv = {r["algorithm"]: r for r in cross_validate(data, kind, pool, folds).collect()}  # one row per algorithm
    higher = kind == "classification"
    order = sorted(pool, key=lambda a: -cv[a]["mean"] if higher else cv[a]["mean"])
    rows, models, searches = [], {}, {}
    for a in pool:
        if a not in order[:tune_top]:
            models[a] = algorithms(kind, data)[a]().fit(data.train)
        elif trials:
            searches[a] = search(data, kind, a, trials)
            models[a] = searches[a].model
        else:
            models[a] = tune(data, kind, a)
        score = float(evaluator(kind).evaluate(models[a].transform(data.test)))
        rows.append((a, cv[a]["mean"], cv[a]["std"], a in order[:tune_top], round(score, 6)))
    rows.sort(key=lambda t: order.index(t[0]))
    best = order[0]
    table = report(df, rows, "algorithm string, cv_mean double, cv_std double, tuned boolean, test_score double")
    weights = importance_frame(df, models[best], data.features)
    data.train.unpersist(), data.test.unpersist()
    return Trained(kind, best, models[best], data.fitted, data.features, data.labels, data.log_target, table, weights, {"data": data, "trials": {a: s.trials for a, s in searches.items()}})


def silhouette(placed: DataFrame) -> float:
    """Mean silhouette of the rows in clusters (noise, below 0, is left out); -1 for fewer than two clusters."""
    some = placed.where("prediction >= 0")
    if len(some.select("prediction").distinct().limit(2).collect()) < 2:
        return -1.0
    return float(ClusteringEvaluator().evaluate(some))


def train_clusters(df: DataFrame, names: Sequence[str] | None = None, k: int = 3) -> Trained:
    fitted = Fitted()

    def add(step, tables=None):
        fitted.steps.append(step)
        fitted.tables.update(tables or {})

    add(fit_fill(df))
    add(*fit_encode(fitted.transform(df)))
    now = fitted.transform(df)
    rest = [c for c in now.columns if not is_numeric(now, c)]
    if rest:
        add({"kind": "drop", "columns": rest})
    add(fit_scale(fitted.transform(df), "standard"))
    now = fitted.transform(df)
    features = numeric_cols(now)
    data = assemble(now, features).persist()
    vectors = data.select("features")  # not cached itself, so a fit keeps its decoded vectors instead of decoding the rows in every iteration
    made = {a: clusterers(k)[a]().fit(vectors) for a in (names or clusterers(k))}
    rows = sorted(((a, round(silhouette(m.transform(data)), 6)) for a, m in made.items()), key=lambda t: -t[1])
    data.unpersist()
    return Trained("clustering", rows[0][0], made[rows[0][0]], fitted, features, [], False, report(df, rows, "algorithm string, silhouette double"))
