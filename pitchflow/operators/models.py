"""Match-outcome classifiers: estimators by name, training, calibration, prediction, evaluation, persistence."""

from __future__ import annotations

import json

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.functions.columns import result_code
from pitchflow.operators import boosting, kernels, neighbours
from pitchflow.operators.bayes import Bayes
from pitchflow.operators.boosting import Boosted
from pitchflow.operators.discriminant import Discriminant
from pitchflow.operators.kernels import Kernel, Machines
from pitchflow.operators.metrics import classification_metrics
from pitchflow.operators.splits import stratified_folds
from pitchflow.operators.tables import written

# Search spaces and defaults.
_CRITERIA, _SUBSETS = ("gini", "entropy", "log_loss"), (None, "sqrt", "log2")
SEARCH: dict[str, dict[str, Any]] = {
    "common": {"calibrate": (True, False), "normalizer": (None, "standard", "min-max", "max-abs"), "sampler": (None, "svm-smote", "nearmiss", "instance-hardness-threshold")},
    "decisiontree": {"criterion": _CRITERIA, "min_samples_leaf": range(1, 36, 2), "min_samples_split": range(2, 31, 2), "max_features": _SUBSETS, "max_depth": range(16), "class_weight": (True, False)},
    "discriminant": {"oas": (True, False), "decision_boundary": ("linear", "quadratic")},
    "extremeboosting": {"n_estimators": range(50, 501, 50), "max_depth": range(1, 16), "min_child_weight": range(1, 6), "learning_rate": [i * 0.005 for i in range(1, 101)], "lambda": [i / 10 for i in range(1, 21)], "alpha": [i / 10 for i in range(11)]},
    "knn": {"n_neighbors": range(3, 100, 6), "weights": ("uniform", "distance"), "p": (1, 2)},
    "logistic": {"penalty": (None, "l1", "l2")},
    "naivebayes": {"algorithm": ("gaussian", "multinomial", "complement")},
    "randomforest": {"n_estimators": range(50, 501, 50), "criterion": _CRITERIA, "min_samples_leaf": range(1, 31, 2), "min_samples_split": range(2, 31, 2), "max_features": _SUBSETS, "max_depth": range(16), "class_weight": (True, False)},
    "svm": {"kernel": ("linear", "rbf", "poly", "sigmoid"), "degree": range(3, 7), "gamma": [i / 10 for i in range(1, 21)], "class_weight": (True, False)},
}
DEFAULTS = {"calibrate": True, "normalizer": None, "sampler": None}
PENALTY_STRENGTHS = (1e-4, 1e-2, 1e-1, 1.0, 10.0)


def search_space(algorithm: str) -> dict[str, Any]:
    """The common choices and those of the algorithm."""
    return SEARCH["common"] | SEARCH[algorithm]


def targets(df: DataFrame, kind: str = "result") -> DataFrame:
    """``df`` with ``label``: H, D, A as 0, 1, 2, or 1 for at least 2.5 goals."""
    if kind == "result":
        return df.withColumn("label", result_code(F.col("result")).cast("double"))
    if kind == "over-under":
        return df.withColumn("label", F.coalesce(F.col("hg") + F.col("ag") >= 2.5, F.lit(False)).cast("double"))
    raise ValueError(f"no target {kind}")


def one_hot(df: DataFrame, label: str = "label", n: int = 3, kind: str = "result") -> DataFrame:
    """``df`` with ``one_hot``; only for results."""
    if kind != "result":
        raise TypeError("only results are one-hot encoded")
    return df.withColumn("one_hot", F.array(*[(F.col(label) == i).cast("int") for i in range(n)]))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with ``weight``: rows / (classes * rows of the class)."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))  # one row
    table = counts.join(F.broadcast(total), F.lit(True)).select("_l", (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(table, F.col(label) == F.col("_l")).drop("_l")


# ---------------------------------------------------------------- estimators


def _depth(value: int | None) -> int:
    """MLlib grows trees to 30 levels at most; none or 0 asks for all of them."""
    return 30 if not value else min(value, 30)


def _tree(criterion: str, min_samples_leaf: int, min_samples_split: int, max_depth: int | None, class_weight: bool) -> dict[str, Any]:
    """Common tree settings. ``log_loss`` and ``entropy`` are one measure; a node is split if both sides can hold half of ``min_samples_split``."""
    weight = {"weightCol": "weight"} if class_weight else {}
    return {"impurity": "gini" if criterion == "gini" else "entropy", "minInstancesPerNode": max(min_samples_leaf, -(-min_samples_split // 2)), "maxDepth": _depth(max_depth), **weight}


def decision_tree(criterion: str = "gini", min_samples_leaf: int = 1, min_samples_split: int = 2, max_features: str | None = None, max_depth: int | None = None, class_weight: bool = True, seed: int = 0) -> Estimator:
    """With ``max_features`` it is a forest of one tree on all rows, which picks features at each node."""
    common = _tree(criterion, min_samples_leaf, min_samples_split, max_depth, class_weight)
    if max_features is None:
        return C.DecisionTreeClassifier(seed=seed, **common)
    return C.RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=max_features, seed=seed, **common)


def random_forest(n_estimators: int = 100, criterion: str = "gini", min_samples_leaf: int = 1, min_samples_split: int = 2, max_features: str | None = None, max_depth: int | None = None, class_weight: bool = True, seed: int = 0) -> Estimator:
    return C.RandomForestClassifier(numTrees=n_estimators, featureSubsetStrategy=max_features or "all", seed=seed, **_tree(criterion, min_samples_leaf, min_samples_split, max_depth, class_weight))


def logistic(penalty: str | None = None, n_rows: int = 1, strengths: Sequence[float] = PENALTY_STRENGTHS, folds: int = 5, seed: int = 0) -> Estimator:
    """Without a penalty one fit; else the strength with the best accuracy over folds. The penalty is 1 / (strength * rows)."""
    if penalty not in (None, "l1", "l2"):
        raise ValueError(f"no penalty {penalty}")
    one = C.LogisticRegression(family="multinomial", maxIter=200, regParam=0.0, elasticNetParam=1.0 if penalty == "l1" else 0.0)
    if penalty is None:
        return one
    grid = ParamGridBuilder().addGrid(one.regParam, [1.0 / (c * max(n_rows, 1)) for c in strengths]).build()
    return CrossValidator(estimator=one, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed)


ALGORITHMS: dict[str, Callable[..., Estimator] | None] = {
    "decisiontree": decision_tree,
    "discriminant": None,  # closed form
    "extremeboosting": None,  # grown level by level
    "knn": None,  # keeps its rows
    "logistic": logistic,
    "naivebayes": None,  # closed form
    "randomforest": random_forest,
    "svm": None,  # machines of all classes together
}


def default_config(algorithm: str, **changes: Any) -> dict[str, Any]:
    """The configuration of a new model: algorithm, common defaults, and the settings given."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no algorithm {algorithm}")
    return {"algorithm": algorithm, **DEFAULTS, **changes}


# ---------------------------------------------------------------- fitted models


@dataclass
class Member:
    """One fitted model: scores per class before calibration, and a calibrator for each class, if any."""

    algorithm: str
    features: list[str]
    pipeline: PipelineModel | None = None
    discriminant: Discriminant | None = None
    bayes: Bayes | None = None
    rows: DataFrame | None = None
    boosted: Boosted | None = None
    kernel: Kernel | None = None
    machines: Machines | None = None
    settings: dict[str, Any] = field(default_factory=dict)
    calibrators: list[IsotonicRegressionModel] = field(default_factory=list)

    def scores(self, df: DataFrame, n_classes: int, name: str) -> DataFrame:
        """``df`` with an array of scores."""
        closed = self.discriminant or self.bayes
        if closed is not None:
            return df.withColumn(name, closed.probabilities(n_classes))
        if self.boosted is not None:
            return df.withColumn(name, self.boosted.probabilities())
        if self.rows is not None:
            return self._votes(df, n_classes, name)
        if self.machines is not None:
            vector = F.array(*[F.col(f).cast("double") for f in self.features]) if self.kernel is None else self.kernel.vector(self.features)
            return df.withColumn("_kernel", vector).withColumn(name, self.machines.chances(F.col("_kernel"))).drop("_kernel")
        extra = [c for c in ("features", "rawPrediction", "probability", "prediction") if c not in df.columns]
        return self.pipeline.transform(df).withColumn(name, vector_to_array("probability")).drop(*extra)

    def _votes(self, df: DataFrame, n_classes: int, name: str) -> DataFrame:
        """Shares of the votes of the nearest training rows; ``df`` is a stated set of queries with the key ``row_key``."""
        packed = df.withColumn("_vector", F.array(*[F.col(f).cast("double") for f in self.features]))
        found = neighbours.nearest(self.rows, packed, self.settings.get("n_neighbors", 5), key="row_key", vector="_vector", label="label", p=self.settings.get("p", 2))
        weight = F.lit(1.0) if self.settings.get("weights", "uniform") == "uniform" else F.lit(1.0) / F.greatest("distance", F.lit(1e-12))
        shares = found.groupBy("query").agg(*[F.sum(F.when(F.col("label") == c, weight).otherwise(0.0)).alias(f"_{c}") for c in range(n_classes)])
        told = shares.select("query", F.array(*[F.col(f"_{c}") for c in range(n_classes)]).alias(name))
        return df.join(told, F.col("row_key") == F.col("query"), "left").drop("query")

    def probabilities(self, df: DataFrame, n_classes: int, name: str) -> DataFrame:
        out = self.scores(df, n_classes, name)
        if self.calibrators:
            for c, one in enumerate(self.calibrators):
                out = one.transform(out.withColumn("_score", F.get(name, F.lit(c)))).withColumnRenamed("prediction", f"_p{c}").drop("_score")
            out = out.withColumn(name, F.array(*[F.col(f"_p{c}") for c in range(n_classes)])).drop(*[f"_p{c}" for c in range(n_classes)])
        total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
        return out.withColumn(name, F.when(total > 0, F.transform(name, lambda x: x / total)).otherwise(F.array(*[F.lit(1.0 / n_classes)] * n_classes)))


@dataclass
class Classifier:
    """What ``fit`` gives: one member, or one for each calibration fold, whose probabilities are averaged."""

    config: dict[str, Any]
    features: list[str]
    n_classes: int
    members: list[Member]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with p_0, p_1, ... and ``prediction``; rows with null features are left out, keys stay."""
        out = df.na.drop("any", subset=self.features)
        for i, member in enumerate(self.members):
            out = member.probabilities(out, self.n_classes, f"_m{i}")
        for c in range(self.n_classes):
            total = F.lit(0.0)
            for i in range(len(self.members)):
                total = total + F.get(f"_m{i}", F.lit(c))
            out = out.withColumn(f"p_{c}", total / len(self.members))
        together = F.array(*[F.col(f"p_{c}") for c in range(self.n_classes)])
        return out.withColumn("prediction", (F.array_position(together, F.array_max(together)) - 1).cast("double")).drop(*[f"_m{i}" for i in range(len(self.members))])

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).drop(*[f"p_{c}" for c in range(self.n_classes)])

    def evaluate(self, df: DataFrame) -> DataFrame:
        return classification_metrics(self.predict(df), "label", "prediction")

    def _last(self) -> Any:
        pipeline = self.members[0].pipeline
        if pipeline is None:
            raise ValueError(f"{self.config['algorithm']} has no such values")
        last = pipeline.stages[-1]
        return last.bestModel if isinstance(last, CrossValidatorModel) else last

    def feature_importances(self) -> dict[str, float]:
        """Of tree models; of calibrated ones those of the first fold."""
        if self.members[0].boosted is not None:
            return dict(zip(self.features, self.members[0].boosted.importances(), strict=True))
        found = self._last().featureImportances
        return {f: float(found[i]) for i, f in enumerate(self.features)}

    def coefficients(self) -> dict[str, float]:
        """Absolute coefficients of a logistic or linear SVM model, averaged over classes; of calibrated ones those of the first fold."""
        if self.members[0].kernel is not None:
            raise ValueError("a kernel has no coefficients of features")
        machines = self.members[0].machines
        matrix = self._last().coefficientMatrix.toArray() if machines is None else np.array(machines.weights)[:, :-1]
        return dict(zip(self.features, np.abs(matrix).mean(axis=0).tolist(), strict=True))

    def forest_member(self, i: int) -> Any:
        return self._last().trees[i]

    def save(self, path: str) -> None:
        """Writes members to folders below ``path`` and what is left as one JSON row."""
        spark = SparkSession.getActiveSession()
        told = []
        for i, m in enumerate(self.members):
            if m.pipeline is not None:
                m.pipeline.write().overwrite().save(f"{path}/member-{i}")
            for c, one in enumerate(m.calibrators):
                one.write().overwrite().save(f"{path}/calibrator-{i}-{c}")
            if m.rows is not None:
                m.rows.write.mode("overwrite").parquet(f"{path}/rows-{i}")
            told.append({"discriminant": m.discriminant and asdict(m.discriminant), "bayes": m.bayes and asdict(m.bayes), "boosted": m.boosted and asdict(m.boosted), "kernel": m.kernel and asdict(m.kernel), "machines": m.machines and asdict(m.machines), "settings": m.settings, "n_calibrators": len(m.calibrators), "rows": m.rows is not None, "pipeline": m.pipeline is not None})
        meta = {"config": self.config, "features": self.features, "n_classes": self.n_classes, "members": told}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        members = []
        for i, m in enumerate(meta["members"]):
            members.append(
                Member(
                    meta["config"]["algorithm"],
                    meta["features"],
                    PipelineModel.load(f"{path}/member-{i}") if m["pipeline"] else None,
                    Discriminant(**m["discriminant"]) if m["discriminant"] else None,
                    Bayes(**m["bayes"]) if m.get("bayes") else None,
                    spark.read.parquet(f"{path}/rows-{i}") if m["rows"] else None,
                    Boosted(**m["boosted"]) if m.get("boosted") else None,
                    Kernel(**m["kernel"]) if m["kernel"] else None,
                    Machines(**m["machines"]) if m["machines"] else None,
                    m["settings"],
                    [IsotonicRegressionModel.load(f"{path}/calibrator-{i}-{c}") for c in range(m["n_calibrators"])],
                )
            )
        return Classifier(meta["config"], meta["features"], meta["n_classes"], members)


def save_model(model: Classifier | None, path: str) -> None:
    if model is None:
        raise ValueError("the model is not fitted")
    model.save(path)


# ---------------------------------------------------------------- fitting


def _member(df: DataFrame, features: Sequence[str], algorithm: str, settings: dict[str, Any], n_rows: int, n_classes: int) -> Member:
    chosen = dict(settings)
    if algorithm == "extremeboosting":
        chosen.pop("seed", None)  # nothing is drawn
        return Member(algorithm, list(features), boosted=boosting.fit(df, features, n_classes, written, penalty=chosen.pop("lambda", 1.0), **chosen))
    if algorithm == "discriminant":
        return Member(algorithm, list(features), discriminant=Discriminant.fit(df, features, quadratic=chosen.get("decision_boundary", "linear") == "quadratic", oas=chosen.get("oas", False)))
    if algorithm == "naivebayes":
        return Member(algorithm, list(features), bayes=Bayes.fit(df, features, kind=chosen.get("kind", "gaussian")))
    if algorithm == "knn":
        return Member(algorithm, list(features), rows=df.select("row_key", F.array(*[F.col(f).cast("double") for f in features]).alias("_vector"), F.col("label").cast("long").alias("label")), settings=chosen)
    if algorithm == "svm":
        return _machine(df, features, chosen, n_classes)
    if algorithm == "logistic":
        chosen["n_rows"] = n_rows
    made = ALGORITHMS[algorithm](**chosen)
    if made.hasParam("weightCol") and made.isDefined("weightCol") and made.getOrDefault("weightCol") == "weight" and "weight" not in df.columns:
        df = class_weights(df)
    return Member(algorithm, list(features), pipeline=_pipeline(features, made).fit(df))


def _pipeline(inputs: Sequence[str], made: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="skip"), made])


def _machine(df: DataFrame, features: Sequence[str], settings: dict[str, Any], n_classes: int, folds: int = 3) -> Member:
    """A support-vector machine for each class against the rest, on the features or on kernel features.

    As in the search space, ``gamma`` is the cost of an error; the kernel's own scale follows the data.
    """
    kind, degree, cost = settings.get("kernel", "linear"), settings.get("degree", 3), settings.get("gamma", 1.0)
    kernel = None if kind == "linear" else Kernel.fit(df, features, kind, degree=degree)
    vector = F.array(*[F.col(f).cast("double") for f in features]) if kernel is None else kernel.vector(features)
    weighted = class_weights(df) if settings.get("class_weight", True) else df.withColumn("weight", F.lit(1.0))
    rows = written(stratified_folds(weighted, "label", "row_key", folds).select(vector.alias("x"), F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), "fold"))
    n_inputs = len(features) if kernel is None else len(kernel.weights[0])
    return Member("svm", list(features), kernel=kernel, machines=kernels.fit_machines(rows, n_inputs, n_classes, folds, cost, written))


def fit(df: DataFrame, features: Sequence[str], algorithm: str, *, key: str = "match_id", calibrate: bool = False, folds: int = 5, **settings: Any) -> Classifier:
    """Fits on the rows without nulls; ``df`` has ``label`` (0, 1, ...) and the whole-number column ``key``.

    With ``calibrate`` (never for discriminants) a member is fitted on the rest of each stratified
    fold and an isotonic curve for each class on the fold itself. Regularisation follows the
    number of rows. An empty table is an error.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no algorithm {algorithm}")
    rows = df.na.drop("any", subset=[*features, "label"]).withColumn("row_key", F.col(key).cast("long"))
    n_rows, top = rows.agg(F.count(F.lit(1)), F.max("label")).first()
    if not n_rows:
        raise ValueError("no rows to fit")
    n_classes, config = max(int(top) + 1, 2), {"algorithm": algorithm, "calibrate": calibrate, **settings}
    if not calibrate or algorithm == "discriminant":
        return Classifier(config, list(features), n_classes, [_member(rows, features, algorithm, settings, n_rows, n_classes)])
    dealt, members = stratified_folds(rows, "label", "row_key", folds), []
    for fold in range(folds):
        member = _member(dealt.where(F.col("fold") != fold), features, algorithm, settings, n_rows, n_classes)
        held = member.scores(dealt.where(F.col("fold") == fold), n_classes, "_scores").select("label", "_scores")
        for c in range(n_classes):
            curve = IsotonicRegression(featuresCol="_score", labelCol="_is")
            member.calibrators.append(curve.fit(held.select(F.get("_scores", F.lit(c)).alias("_score"), (F.col("label") == c).cast("double").alias("_is"))))
        members.append(member)
    return Classifier(config, list(features), n_classes, members)


def evaluate(model: Classifier | None, df: DataFrame) -> DataFrame:
    if model is None:
        raise RuntimeError("the classifier is not fitted")
    return model.evaluate(df)


