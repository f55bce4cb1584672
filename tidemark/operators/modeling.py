"""Modeling: column labels, splits, training, scoring, metrics, importance, model store."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.util import inheritable_thread_target

from tidemark.functions.arithmetic import corrected_skew, percent, ratio
from tidemark.functions.kinds import kind_column, kind_of, number, numeric_columns, ref, text_columns
from tidemark.operators import cleaning
from tidemark.operators.quality import outlier_table
from tidemark.operators.relationships import high_correlations
from tidemark.plans.counts import as_text, column_summary
from tidemark.plans.nearest import nearest
from tidemark.plans.ranks import quantiles, running
from tidemark.plans.sizing import spread
from tidemark.plans.stats import beside, moments
from tidemark.session import settle

# ---- labels per column ----


def _facts(df: DataFrame) -> DataFrame:
    facts = column_summary(df).withColumn("kind", kind_column(df))
    return (facts.withColumn("missing_pct", percent(F.col("missing"), F.col("row_count")))
            .withColumn("unique_ratio", ratio(F.col("distinct_count"), F.col("row_count"))))


def modeling_role() -> Column:
    n, share, kind = F.col("distinct_count"), F.col("unique_ratio"), F.col("kind")
    numeric = (F.when(n == 2, "binary_target_or_feature").when((n < 10) & (share < 0.1), "categorical_target_or_feature")
               .when(share > 0.95, "identifier").otherwise("numeric_feature_or_target"))
    text = F.when(share > 0.95, "identifier").when(n < 20, "categorical_feature_or_target").otherwise("text_feature")
    return (F.when(F.col("missing_pct") > 50, "poor_feature").when(kind == "numeric", numeric)
            .when(kind == "text", text).otherwise("feature"))


def target_suitability() -> Column:
    n, share, kind = F.col("distinct_count"), F.col("unique_ratio"), F.col("kind")
    numeric = (F.when(n == 2, "excellent_binary_classification")
               .when((n > 2) & (n <= 10) & (share < 0.1), "good_multiclass_classification")
               .when((n > 10) & (share > 0.1), "good_regression").otherwise("fair"))
    return (F.when(F.col("missing_pct") > 10, "poor").when(kind == "numeric", numeric)
            .when(kind == "text", F.when(n.between(2, 20), "good_classification").otherwise("poor")).otherwise("fair"))


def feature_quality() -> Column:
    share, kind = F.col("unique_ratio"), F.col("kind")
    constant = (F.col("distinct_count") == 1) & (F.col("row_count") - F.col("missing") > 1)
    grade = F.when(share < 0.01, "fair").otherwise("good")
    return (F.when(F.col("missing_pct") > 70, "poor").when(F.col("missing_pct") > 30, "fair")
            .when((kind == "numeric") & constant, "poor").when((kind == "text") & (share > 0.95), "poor")
            .when(kind.isin("numeric", "text"), grade).otherwise("good"))


def problem_type() -> Column:
    n, share, kind = F.col("distinct_count"), F.col("unique_ratio"), F.col("kind")
    numeric = (F.when(n == 2, "binary_classification").when((n <= 10) & (share < 0.1), "multiclass_classification")
               .otherwise("regression"))
    text = (F.when(n > 20, "text_classification").when(n > 2, "multiclass_classification").otherwise("binary_classification"))
    return F.when(kind == "numeric", numeric).when(kind == "text", text).otherwise("regression")


def modeling_columns(df: DataFrame) -> DataFrame:
    """Role, target suitability, feature quality and problem type per column."""
    return _facts(df).select("column_name", "kind", "missing", "missing_pct", "distinct_count", "unique_ratio",
                             modeling_role().alias("modeling_role"), target_suitability().alias("target_suitability"),
                             feature_quality().alias("feature_quality"), problem_type().alias("problem_type"))


def modeling_numeric(df: DataFrame) -> DataFrame:
    """Numeric details: range, centre, corrected skewness, outliers, zeros, shape label."""
    out = outlier_table(df).select("column_name", "outliers")
    middle = quantiles(df, [0.5], ["median"])
    skew = corrected_skew(F.col("valid"), F.col("skew_pop"))
    rows = moments(df).join(F.broadcast(out), "column_name").join(F.broadcast(middle), "column_name")  # one row per column
    return rows.select("column_name", "minimum", "maximum", "mean", "median", "std", skew.alias("skewness"), "outliers", "zeros").withColumn(
        "shape", F.when(F.abs("skewness") < 0.5, "normal").when(F.col("skewness") > 1, "right_skewed")
        .when(F.col("skewness") < -1, "left_skewed").otherwise("slightly_skewed"))


def suggest_targets(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns that can be a target, best first; with ``limit`` only so many."""
    s = F.col("target_suitability")
    weight = (F.when(s == "excellent_binary_classification", 5).when(s.isin("good_multiclass_classification", "good_regression"), 4)
              .when(s == "good_classification", 3).otherwise(2))
    ordered = modeling_columns(df).filter(s != "poor").withColumn("weight", weight.cast("long")).orderBy(F.col("weight").desc(), "column_name")
    return ((ordered if limit is None else ordered.limit(limit))
            .select("column_name", "target_suitability", "problem_type", "distinct_count", "missing_pct", "weight"))


def class_balance(df: DataFrame) -> DataFrame:
    """Smallest over largest class for every column with 2 to 20 values."""
    share = ratio(F.col("smallest_class"), F.col("largest_class"))
    return (column_summary(df).filter(F.col("distinct_count").between(2, 20))
            .select("column_name", "distinct_count", share.alias("balance"))
            .withColumn("status", F.when(F.col("balance") > 0.8, "well_balanced").when(F.col("balance") > 0.5, "moderately_balanced")
                        .when(F.col("balance") > 0.1, "imbalanced").otherwise("highly_imbalanced")))


def modeling_recommendations(df: DataFrame) -> DataFrame:
    """Rules over missing share, cardinality, size and outliers; one row each."""
    facts = _facts(df).agg(
        F.sum("missing").alias("missing"), F.sum("row_count").alias("cells"), F.max("row_count").alias("row_count"),
        F.count_if((F.col("kind") == "text") & (F.col("distinct_count") > 20)).alias("wide_text"),
        F.count_if(F.col("kind") == "numeric").alias("numeric"))
    if numeric_columns(df):
        out = outlier_table(df).select("column_name", "outliers").join(
            F.broadcast(column_summary(df, numeric_columns(df)).select("column_name", F.col("row_count").alias("total"))), "column_name")
        facts = beside(facts, out.agg(F.count_if(F.col("outliers") > 0.05 * F.col("total")).alias("outlier_columns")))
    else:
        facts = facts.withColumn("outlier_columns", F.lit(0).cast("long"))

    def rule(fires, name, priority, measure):
        return F.when(fires, F.struct(F.lit(name).alias("rule"), F.lit(priority).alias("priority"), measure.cast("double").alias("measure")))

    share = percent(F.col("missing"), F.col("cells"))
    rows = F.array(rule(share > 20, "handle_missing", "high", share), rule(F.col("wide_text") > 0, "encode_text", "high", F.col("wide_text")),
                   rule(F.col("numeric") > 1, "scale_features", "medium", F.col("numeric")),
                   rule(F.col("row_count") < 1000, "small_data", "medium", F.col("row_count")),
                   rule(F.col("outlier_columns") > 0, "treat_outliers", "medium", F.col("outlier_columns")))
    return facts.select(F.inline(F.array_compact(rows)))


def feature_summary(df: DataFrame) -> DataFrame:
    """Columns per kind and per quality grade."""
    labels = _facts(df).select(F.inline(F.array(
        F.struct(F.lit("kind").alias("grouping"), F.col("kind").alias("label")),
        F.struct(F.lit("quality").alias("grouping"), feature_quality().alias("label")))))
    return labels.groupBy("grouping", "label").agg(F.count(F.lit(1)).alias("columns"))


# ---- split ----

#: Ranges of the 32-bit key hash that are counted to find the one with the cut.
SPLIT_RANGES = 1 << 16


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Adds ``part``: 'test' for the rows with the lowest hash of the (unique) key.

    Their number is the share of all rows rounded up, or with ``stratify`` the share of
    each class rounded to the nearest, nulls being a class. Rows are counted per class and
    range of the hash; only the range that holds the cut, one for each class, is ranked, so
    neither rows nor keys are shuffled.
    """
    text = ref(key).cast("string")
    at = F.struct(cleaning.key_hash(F.concat_ws(":", F.lit(str(seed)), text)).alias("h"), text.alias("k"))
    of = F.to_json(F.struct(ref(stratify).alias("v"))) if stratify else F.lit("")
    rows = df.withColumns({"_class": of, "_at": at})
    ranged = rows.select("_class", "_at", F.floor(F.col("_at.h") / ((1 << 32) // SPLIT_RANGES)).alias("_range"))
    take = (lambda total: F.floor(total * test_share + 0.5)) if stratify else (lambda total: F.ceil(total * test_share))
    upto = Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    counts = ranged.groupBy("_class", "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_upto": F.sum("_n").over(upto), "_take": take(F.sum("_n").over(Window.partitionBy("_class")))})
    holds = counts.filter((F.col("_take") > F.col("_upto") - F.col("_n")) & (F.col("_take") <= F.col("_upto")))
    holds = holds.select("_class", "_range", "_take", (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_class").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    # one row per class, and of each class the rows of one range
    near = ranged.join(F.broadcast(holds), ["_class", "_range"]).groupBy("_class", "_take", "_before", "_at").agg(F.count(F.lit(1)).alias("_n"))
    near = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    cuts = near.filter(F.col("_upto") >= F.col("_take")).groupBy("_class").agg(F.min("_at").alias("_cut"))
    return (rows.join(F.broadcast(cuts), "_class", "left").withColumn("part", F.when(F.col("_at") <= F.col("_cut"), "test").otherwise("train"))
            .drop("_class", "_at", "_cut"))


def split_shares(split: DataFrame, target: str) -> DataFrame:
    return (split.groupBy(ref(target).alias("target")).agg(F.count_if(F.col("part") == "test").alias("test"), F.count(F.lit(1)).alias("total"))
            .withColumn("test_share", ratio(F.col("test"), F.col("total"))))


# ---- training ----

#: Labels that ``train`` collects at most unless told otherwise; more is an error, as a wrong target is more likely than so many classes.
MAX_CLASSES = 10_000
#: Spark's deepest tree.
MAX_DEPTH = 30


@dataclass
class TrainedModel:
    """Everything scoring needs. Only bounded facts live here: one fill per column,
    at most ten categories per one-hot column, at most MAX_CLASSES labels. Code
    tables of label-encoded columns stay DataFrames."""

    features: list[str]
    target: str
    problem: str
    model_type: str
    fills: dict
    one_hot: dict[str, list[str]]
    codes: dict[str, DataFrame]
    scaler: dict[str, tuple[float, float]]
    inputs: list[str]
    labels: list | None
    pipeline: PipelineModel | None
    neighbours: DataFrame | None = None
    info: dict = field(default_factory=dict)

    def encode(self, df: DataFrame, fills: dict | None) -> DataFrame:
        lost = [c for c in self.features if c not in df.columns]
        if lost:
            raise ValueError(f"missing required features {lost}; required: {self.features}")
        if fills is not None:
            out = cleaning.impute(df, fills)
        else:  # scoring rule: 0 and 'missing'
            out = df.withColumns({c: F.coalesce(number(df, c), F.lit(0.0)) if kind_of(df.schema[c].dataType) == "numeric"
                                  else F.coalesce(ref(c).cast("string"), F.lit("missing")) for c in self.features})
        out = cleaning.one_hot(out, self.one_hot) if self.one_hot else out
        for c, table in self.codes.items():
            out = cleaning.label_encode(out, c, table)
        return cleaning.scale(out, self.scaler) if self.scaler else out


#: A forest of more train rows than the first number whose distinct rows are at most the second draws how often each of those is in each tree.
FOREST_ROWS, FOREST_DISTINCT = 100_000, 200_000
TREES, FOREST_SEED = 100, 42

#: Models whose fit is the same for equal rows and for one row with their number as its weight; a forest draws rows, neighbours are rows.
WEIGHTED = ("decision_tree", "logistic_regression", "linear_regression", "naive_bayes", "svm")


def _estimator(kind: str, problem: str, rows: int, classes: int, depth: int, iterations: int, squares: int | None = None):
    """``squares``: the sum of squared weights, when equal rows are one row with a weight."""
    common = {"featuresCol": "features", "labelCol": "label"}
    weight = {} if squares is None else {"weightCol": "weight"}
    # an L2 penalty of 1 on the summed loss is 1/rows on Spark's mean loss
    penalty = 1.0 / max(rows, 1)
    # Spark's variance divides by the weights less their mean square, not by the rows less one; the support vector machine's penalty follows it
    margin = penalty if squares is None or rows < 2 else penalty * (rows - squares / rows) / (rows - 1)
    if problem == "classification":
        made = {
            "random_forest": lambda: RandomForestClassifier(numTrees=TREES, maxDepth=depth, seed=FOREST_SEED, maxMemoryInMB=1024, **common),
            "decision_tree": lambda: DecisionTreeClassifier(maxDepth=depth, seed=42, **common, **weight),
            "logistic_regression": lambda: LogisticRegression(maxIter=iterations, regParam=penalty, standardization=False, **common, **weight),
            "naive_bayes": lambda: NaiveBayes(modelType="gaussian", **common, **weight),
            "svm": lambda: (LinearSVC(maxIter=iterations, regParam=margin, **common, **weight) if classes <= 2 else
                            OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=margin), parallelism=4, **common, **weight)),
        }
    else:
        made = {
            "random_forest": lambda: RandomForestRegressor(numTrees=TREES, maxDepth=depth, seed=FOREST_SEED, maxMemoryInMB=1024, **common),
            "decision_tree": lambda: DecisionTreeRegressor(maxDepth=depth, seed=42, **common, **weight),
            "linear_regression": lambda: LinearRegression(**common, **weight),
        }
    if kind not in made:
        raise ValueError(f"no {problem} model named {kind}; there are {sorted(made)} and knn")
    return made[kind]()


def _forest(ready: DataFrame, problem: str, classes: int, depth: int):
    """The forest of all rows, from (features, label, weight): distinct rows with their numbers.

    Spark's bootstrap takes each row a Poisson(1) number of times per tree, so of n equal
    rows a tree has a Poisson(n) number: the same forest drawn otherwise, and no pass over
    all rows per level. Trees are fitted by themselves, several at a time.
    """
    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # seeded by the row's content, not by its place
            pdf["draws"] = [np.random.default_rng([FOREST_SEED, h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF]).poisson(n, TREES).tolist()
                            for h, n in zip(pdf["h"].tolist(), pdf["weight"].tolist())]
            yield pdf[["values", "label", "draws"]]

    spark, values = ready.sparkSession, vector_to_array("features")
    # rows that filled gaps make equal have one draw
    rows = ready.groupBy(values.alias("values"), "label").agg(F.sum("weight").alias("weight")).withColumn("h", F.xxhash64("values", "label"))
    draws = rows.mapInPandas(drawn, "values array<double>, label double, draws array<long>").coalesce(1).sortWithinPartitions("values", "label")
    draws = settle(draws.select(array_to_vector("values").alias("features"), "label", "draws"), "draws")
    kind = "classification" if problem == "classification" else "regression"
    # a tree may miss a class
    label = F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": classes}} if kind == "classification" else {})
    made, share = (RandomForestClassifier, "sqrt") if kind == "classification" else (RandomForestRegressor, "onethird")

    def tree(t: int):
        own = draws.select("features", label, F.col("draws")[t].cast("double").alias("weight")).filter("weight > 0").coalesce(1)
        return made(numTrees=1, featureSubsetStrategy=share, bootstrap=False, maxDepth=depth, seed=FOREST_SEED + t, maxMemoryInMB=1024,
                    weightCol="weight").fit(own)._java_obj.trees()[0]

    with ThreadPoolExecutor(max(1, min(16, spark.sparkContext.defaultParallelism))) as pool:
        trees = list(pool.map(inheritable_thread_target(spark)(tree), range(TREES)))
    package = getattr(spark.sparkContext._jvm.org.apache.spark.ml, kind)
    single, whole, wrapped = ((package.DecisionTreeClassificationModel, package.RandomForestClassificationModel, RandomForestClassificationModel)
                              if kind == "classification" else
                              (package.DecisionTreeRegressionModel, package.RandomForestRegressionModel, RandomForestRegressionModel))
    array = spark.sparkContext._gateway.new_array(single, TREES)
    for t, one in enumerate(trees):
        array[t] = one
    forest = wrapped(whole(f"forest_{uuid.uuid4().hex[:12]}", array, trees[0].numFeatures(), *([classes] if kind == "classification" else [])))
    # a mean divides by this parameter, not by the trees there are
    forest._set(numTrees=TREES, maxDepth=depth, seed=FOREST_SEED, maxMemoryInMB=1024)
    forest._transfer_params_to_java()
    return forest


def auto_model(problem: str, classes: int) -> str:
    if problem == "regression":
        return "random_forest"
    return "logistic_regression" if classes == 2 else "random_forest"


def train(df: DataFrame, key: str, target: str, features: Sequence[str], problem: str, model: str = "auto",
          test_share: float = 0.2, seed: int = 42, depth: int = MAX_DEPTH, iterations: int = 1000,
          max_classes: int = MAX_CLASSES) -> tuple[TrainedModel, DataFrame]:
    """Fit on the train part; returns the model and the scored test part.

    A classification split is stratified. Fills, categories, codes and scaling are fitted
    on train rows only. Trees grow to ``depth`` at most, iterative fits to ``iterations``.
    Models that know weights are fitted on the distinct train rows with their numbers, a
    forest of many rows that are few distinct ones too.
    """
    features = list(features)
    started = time.time()
    used = list(dict.fromkeys([key, target, *features]))
    # read several times below (split, fills, categories, scaling, iterations)
    rows = settle(cleaning.drop_null_target(cleaning.select_checked(df, used), target), "rows")
    split = settle(train_test_split(rows, key, test_share, seed, target if problem == "classification" else None), "split")
    part = split.filter("part = 'train'")
    labels = None
    if problem == "classification":
        found = part.select(ref(target).alias("t")).distinct().limit(max_classes + 1).collect()
        if len(found) > max_classes:
            raise ValueError(f"{target} has more than {max_classes} classes")
        labels = sorted(r.t for r in found)
    classes = len(labels) if labels else 0
    chosen = auto_model(problem, classes) if model == "auto" else model
    fills = cleaning.fit_imputer(part, features)
    kept = [ref(c) for c in dict.fromkeys([target, *features])]
    weighted = chosen in WEIGHTED or chosen == "random_forest" and part.count() > FOREST_ROWS
    known = settle(part.groupBy(*kept).agg(F.count(F.lit(1)).alias("_weight")), "distinct") if weighted else part
    if weighted and chosen == "random_forest" and known.count() > FOREST_DISTINCT:
        weighted, known = False, part
    filled = cleaning.impute(known, fills)
    texts = [c for c in features if kind_of(df.schema[c].dataType) != "numeric"]
    sizes = {r.column_name: r.distinct_count for r in column_summary(filled, texts).collect()} if texts else {}
    one_hot = cleaning.fit_one_hot(filled, [c for c in texts if sizes.get(c, 0) <= cleaning.ONE_HOT_LIMIT])
    codes = {c: settle(cleaning.label_codes(filled, c), "codes") for c in texts if c not in one_hot}
    fitted = TrainedModel(features, target, problem, chosen, fills, one_hot, codes, {}, [], labels, None)

    encoded = fitted.encode(known, fills)
    hot = [f"{c}_{v}" for c, vs in one_hot.items() for v in [*vs, "nan"]]
    fitted.inputs = [c for c in features if c not in one_hot] + hot
    if model in ("svm", "knn", "auto"):
        fitted.scaler = cleaning.fit_scaler(fitted.encode(part, fills), fitted.inputs)
        encoded = cleaning.scale(encoded, fitted.scaler)
    label = (F.array_position(F.array(*[F.lit(v) for v in labels]), ref(target)) - 1).cast("double") if labels else number(known, target)
    encoded = encoded.withColumn("_label", label)
    if chosen == "knn":
        fitted.neighbours = settle(encoded.select(ref(key).alias("id"), _vector(fitted.inputs).alias("vec"), F.col("_label").alias("label")), "neighbours")
        count = fitted.neighbours.count()
    else:
        assembled = VectorAssembler(inputCols=fitted.inputs, outputCol="features")
        weight = [F.col("_weight").cast("double").alias("weight")] if weighted else []
        ready = spread(settle(assembled.transform(encoded).select("features", F.col("_label").alias("label"), *weight), "features"))
        count, squares = ready.count(), None
        if weight:
            sums = ready.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("weight")).alias("squares")).first()
            count, squares = int(sums.n or 0), sums.squares
        forest = weighted and chosen == "random_forest"
        fit = _forest(ready, problem, classes, depth) if forest else _estimator(chosen, problem, count, classes, depth, iterations, squares).fit(ready)
        fitted.pipeline = PipelineModel([assembled, fit])
    fitted.info = {"train_rows": count, "seconds": round(time.time() - started, 3), "features": len(features),
                   "inputs": len(fitted.inputs), "classes": classes}
    test = split.filter("part = 'test'")
    return fitted, score(fitted, test, key, fills)


def _vector(cols: Sequence[str]) -> Column:
    return F.array(*[ref(c).cast("double") for c in cols])


def score(model: TrainedModel, df: DataFrame, key: str, fills: dict | None = None) -> DataFrame:
    """Adds prediction, confidence and, where the model has them, class probabilities.

    Without ``fills`` gaps become 0 and 'missing'; pass ``model.fills`` for the
    training medians and modes.
    """
    ready = model.encode(df, fills)
    decode = (lambda p: F.element_at(F.array(*[F.lit(v) for v in model.labels]), (p + 1).cast("int"))) if model.labels else (lambda p: p)
    keep = [ref(c) for c in dict.fromkeys([key, model.target]) if c in df.columns]
    if model.neighbours is not None:
        asked = ready.select(ref(key).alias("query_id"), _vector(model.inputs).alias("vec"))
        votes = knn_predict(asked, model.neighbours, 5, model.problem).withColumnRenamed("query_id", key)
        base = df.select(*keep)
        return base.join(votes, key).withColumn("prediction", decode(F.col("prediction")))
    out = model.pipeline.transform(ready)
    if "probability" in out.columns:
        probability = vector_to_array("probability")
        confidence = F.array_max(probability)
    elif "rawPrediction" in out.columns:
        probability = F.lit(None).cast("array<double>")
        confidence = F.least(F.lit(1.0), F.array_max(F.transform(vector_to_array("rawPrediction"), lambda x: F.abs(x))))
    else:
        probability, confidence = F.lit(None).cast("array<double>"), F.lit(0.5)
    return out.select(*keep, decode(F.col("prediction")).alias("prediction"), probability.alias("probabilities"), confidence.alias("confidence"))


def knn_predict(queries: DataFrame, corpus: DataFrame, k: int = 5, problem: str = "classification") -> DataFrame:
    """(query_id, prediction, probabilities, confidence) from the k nearest rows.

    ``queries``: query_id, vec. ``corpus``: id, vec, label. Votes tie to the smaller label.
    """
    hits = nearest(queries, corpus, k).join(corpus.select("id", "label"), "id")
    if problem == "regression":
        return hits.groupBy("query_id").agg(F.avg("label").alias("prediction")).withColumn("confidence", F.lit(0.5))
    votes = hits.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("query_id").agg(
        F.min_by("label", F.struct((-F.col("votes")).alias("v"), "label")).alias("prediction"),
        (F.max("votes") / F.sum("votes")).alias("confidence"))


# ---- metrics ----

def classification_metrics(pred: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1; binary for the larger of two classes, else weighted by class size."""
    cells = pred.groupBy(ref(target).alias("y"), ref(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # confusion cells: classes x classes rows
    side = cells.select(F.inline(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))))
    per = side.groupBy("label").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    precision = F.coalesce(ratio(F.col("hit"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hit"), F.col("actual")), F.lit(0.0))
    per = per.withColumns({"precision": precision, "recall": recall})
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    weighted = lambda c: F.sum(F.col(c) * F.col("actual")) / F.sum("actual")
    present_label = F.when(F.col("actual") > 0, F.col("label"))
    positive = lambda c: F.max_by(c, present_label)
    out = per.agg(F.sum("actual").alias("rows"), (F.sum("hit") / F.sum("actual")).alias("accuracy"),
                  F.count_if(F.col("actual") > 0).alias("classes"),
                  *[F.struct(weighted(c).alias("w"), positive(c).alias("b")).alias(c) for c in ("precision", "recall", "f1")])
    pick = lambda c: F.when(F.col("classes") == 2, F.col(f"{c}.b")).otherwise(F.col(f"{c}.w")).alias(c)
    return out.select("rows", "classes", "accuracy", pick("precision"), pick("recall"), pick("f1"))


def roc_auc(pred: DataFrame, label: Column, score_col: Column) -> DataFrame:
    """Exact area under the ROC curve; ``label`` is boolean. Tied scores count half."""
    counted = (pred.select(score_col.cast("double").alias("value"), label.alias("y")).groupBy("value")
               .agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")))
    ranked = running(counted, [], "value", ["pos", "neg"])
    above = F.col("pos_total") - F.col("pos_upto")
    won = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    return ranked.agg(F.try_divide(won, F.max(F.col("pos_total").cast("double") * F.col("neg_total"))).alias("roc_auc"),
                      F.max("pos_total").alias("positives"), F.max("neg_total").alias("negatives"))


def regression_metrics(pred: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    y, p = number(pred, target), number(pred, prediction)
    return (pred.agg(F.count(F.lit(1)).alias("rows"), F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                     F.var_pop(y).alias("_var"))
            .select("rows", "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("_var"))).alias("r2")))


def feature_importance(model: TrainedModel, spark: SparkSession, by_source: bool = False) -> DataFrame:
    """Tree importances, or absolute coefficients (first class of several), largest first."""
    fitted = model.pipeline.stages[-1] if model.pipeline else None
    if fitted is not None and hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif fitted is not None and hasattr(fitted, "coefficientMatrix"):
        values = abs(fitted.coefficientMatrix.toArray()[0])
    elif fitted is not None and hasattr(fitted, "coefficients"):
        values = abs(fitted.coefficients.toArray())
    else:
        values = []
    rows = [(name, float(v), next((c for c in model.one_hot if name.startswith(f"{c}_")), name)) for name, v in zip(model.inputs, values)]
    out = spark.createDataFrame(rows, "feature string, importance double, source string")
    if by_source:
        out = out.groupBy(F.col("source").alias("feature")).agg(F.sum("importance").alias("importance"))
    return out.select("feature", "importance").orderBy(F.col("importance").desc(), "feature")


# ---- mutual information ----

def mutual_information(df: DataFrame, target: str, features: Sequence[str] | None = None, bins: int = 10, classes: int = 20) -> DataFrame:
    """Plug-in mutual information of every feature with the target, in nats.

    Numbers are cut at their deciles (a numeric target with more than ``classes`` values
    too), gaps are filled with the median or mode, text counts as it is. All
    features share one pass that counts (feature, x, y) cells.
    """
    features = [c for c in (features if features is not None else df.columns) if c != target]
    filled = cleaning.impute(df, cleaning.fit_imputer(df, features, default="Unknown"))
    filled = cleaning.drop_null_target(filled, target)
    nums = [c for c in features if kind_of(df.schema[c].dataType) == "numeric"]
    y_numeric = kind_of(df.schema[target].dataType) == "numeric"
    y_many = y_numeric and filled.select(ref(target)).distinct().limit(classes + 1).count() > classes
    cut = nums + ([target] if y_many else [])
    probs = [i / bins for i in range(1, bins)]
    names = [f"q{i}" for i in range(1, bins)]
    edges = {r.column_name: [r[n] for n in names] for r in quantiles(filled, probs, names, cut).collect()} if cut else {}

    def code(c):
        if c in edges:
            v = number(filled, c)
            return sum([(v > F.lit(e)).cast("int") for e in edges[c]], F.lit(0)).cast("string")
        return as_text(filled, c, digest=True)

    cells = (filled.select(code(target).alias("_y"), *[code(c).alias(c) for c in features])
             .unpivot(["_y"], [ref(c) for c in features], "column_name", "x").filter("x is not null")
             .groupBy("column_name", "x", "_y").agg(F.count(F.lit(1)).alias("n")))
    xs = cells.groupBy("column_name", "x").agg(F.sum("n").alias("nx"))
    ys = cells.groupBy("column_name", "_y").agg(F.sum("n").alias("ny"))
    # MI = (sum n ln n - sum nx ln nx - sum ny ln ny) / N + ln N: three aggregations, no join back
    part = lambda rows, n, sign: rows.groupBy("column_name").agg(
        F.sum(F.col(n) * F.log(F.col(n).cast("double")) * sign).alias("s"), F.sum(n).alias("total"))
    terms = part(cells, "n", 1.0).unionByName(part(xs, "nx", -1.0)).unionByName(part(ys, "ny", -1.0))
    total = F.max("total").cast("double")
    return terms.groupBy("column_name").agg(F.greatest(F.lit(0.0), F.sum("s") / total + F.log(total)).alias("mutual_information"))


def rank_features(df: DataFrame, target: str, keep: float = 0.1, count_from: float = 0.05, limit: int | None = None) -> DataFrame:
    """Features by mutual information: strong ones above ``keep``, selected ones above ``count_from``."""
    mi = F.col("mutual_information")
    ordered = mutual_information(df, target).orderBy(mi.desc(), "column_name")
    return ((ordered if limit is None else ordered.limit(limit))
            .withColumn("strong", mi > keep).withColumn("selected", mi > count_from))


def feature_recommendations(df: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """Redundant pairs, products, ratios and group means, as rows; with ``top`` products only among the best so many features."""
    nums = [c for c in numeric_columns(df) if c != target]
    texts = [c for c in text_columns(df) if c != target]
    pick = ["recommendation", "left_column", "right_column"]
    ranked = mutual_information(df, target)
    # one row per column
    best = [r.column_name for r in ranked.orderBy(F.col("mutual_information").desc(), "column_name").collect()][:top]
    pairs = [("interaction", a, b) for i, a in enumerate(best) for b in best[i + 1:] if a in nums and b in nums]
    pairs += [("ratio", a, b) for i, a in enumerate(nums) for b in nums[i + 1:]]
    pairs += [("group_mean", a, b) for a in nums for b in texts]
    made = df.sparkSession.createDataFrame(pairs, "recommendation string, left_column string, right_column string")
    redundant = high_correlations(df.drop(target), 0.9).select(F.lit("redundant").alias("recommendation"), "left_column", "right_column")
    return made.unionByName(redundant).select(*pick)


# ---- model store ----

META = ("name string, model_type string, problem string, target string, features array<string>, inputs array<string>, "
        "body string, created double")


def save_model(model: TrainedModel, spark: SparkSession, path: str, name: str) -> None:
    """Pipeline, code tables and one metadata row under ``path``."""
    if model.pipeline is not None:
        model.pipeline.write().overwrite().save(f"{path}/models/{name}")
    if model.neighbours is not None:
        model.neighbours.write.mode("overwrite").parquet(f"{path}/neighbours/{name}")
    for c, table in model.codes.items():
        table.write.mode("overwrite").parquet(f"{path}/codes/{name}/{c}")
    body = json.dumps({"fills": model.fills, "one_hot": model.one_hot, "codes": list(model.codes), "scaler": model.scaler,
                       "labels": model.labels, "info": model.info, "knn": model.neighbours is not None}, default=str)
    row = (name, model.model_type, model.problem, model.target, model.features, model.inputs, body, time.time())
    spark.createDataFrame([row], META).write.mode("overwrite").parquet(f"{path}/metadata/name={name}")


def list_models(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(META).parquet(f"{path}/metadata")
    return rows.select("name", "model_type", "problem", "target", F.size("features").cast("long").alias("features"),
                       F.size("inputs").cast("long").alias("inputs"))


def load_model(spark: SparkSession, path: str, name: str) -> TrainedModel:
    row = spark.read.schema(META).parquet(f"{path}/metadata").filter(F.col("name") == name).first()
    body = json.loads(row.body)
    return TrainedModel(
        list(row.features), row.target, row.problem, row.model_type, body["fills"], body["one_hot"],
        {c: spark.read.parquet(f"{path}/codes/{name}/{c}") for c in body["codes"]},
        {c: tuple(v) for c, v in body["scaler"].items()}, list(row.inputs), body["labels"],
        None if body["knn"] else PipelineModel.load(f"{path}/models/{name}"),
        spark.read.parquet(f"{path}/neighbours/{name}") if body["knn"] else None, body["info"])
