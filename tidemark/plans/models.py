"""Model fitting and scoring on labelled tables with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantile import null_safe_join
from tidemark.operators.rank import binary_metrics, multiclass_metrics
from tidemark.plans.evaluate import choose_threshold, fold_roles, fold_status
from tidemark.plans.gold import leaky_columns


def prepared(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Numeric features and label as double; refuses feature names that leak."""
    leaks = leaky_columns(features)
    if leaks:
        raise ValueError(f"features leak the future: {leaks}")
    casts = {c: F.col(c).cast("double") for c in features}
    return df.withColumns({**casts, "label": F.col(label).cast("double")}).where(F.col("label").isNotNull())


def with_class_weights(df: DataFrame, label: str = "label", split: str | None = "split") -> DataFrame:
    """``weight`` = n / (classes x rows of the class), so every class counts the same.

    Only training rows are counted (all rows without a ``split`` column); a class that does
    not occur in training weighs 1.
    """
    seen = df.where(F.col(split) == "train") if split and split in df.columns else df
    counts = seen.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    weights = null_safe_join(counts, total, []).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return df.join(weights, label, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


FIT_ROWS = 250_000  # some 70 MB in the form that the trees keep


@contextmanager
def spread(rows: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """These columns of training rows, in partitions of about ``FIT_ROWS`` rows at most, kept while models are fitted.

    A fit keeps its own form of each partition and reads it again in every iteration, while the
    partitions of a scan grow with the table. Up to ``FIT_ROWS`` rows stay as they are.
    """
    rows = rows.select(*dict.fromkeys(columns))
    n = rows.count()
    if n <= FIT_ROWS:
        yield rows
        return
    parts = max(-(-n // FIT_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    kept = rows.repartition(parts).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def _fitted(pipeline: Pipeline, rows: DataFrame, columns: Sequence[str]) -> PipelineModel:
    with spread(rows, columns) as kept:
        return pipeline.fit(kept)


def _inputs(features: Sequence[str]) -> list:
    filled = [f"{c}__f" for c in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="vector", handleInvalid="keep"),
    ]


def logistic(features: Sequence[str], *, balanced: bool = False, max_iter: int = 100) -> Pipeline:
    """Median impute, standardise, logistic regression (binary or multinomial)."""
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=max_iter)
    if balanced:
        lr = lr.setWeightCol("weight")
    return Pipeline(
        stages=[*_inputs(features), StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True), lr]
    )


def boosted(features: Sequence[str], *, balanced: bool = False, max_iter: int = 50, depth: int = 5, seed: int = 42) -> Pipeline:
    """Gradient-boosted trees; stops early on the rows whose ``is_valid`` is true."""
    gbt = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=max_iter, maxDepth=depth, seed=seed,
        validationIndicatorCol="is_valid", stepSize=0.1,
    )
    if balanced:
        gbt = gbt.setWeightCol("weight")
    return Pipeline(stages=[*_inputs(features), gbt])


def boosted_multiclass(features: Sequence[str], *, max_iter: int = 20, depth: int = 4, seed: int = 42) -> Pipeline:
    """One boosted model per class, the largest score wins."""
    one = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=max_iter, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_inputs(features), OneVsRest(classifier=one, featuresCol="vector", labelCol="label")])


def boosted_regression(features: Sequence[str], target: str, *, max_iter: int = 50, depth: int = 5, seed: int = 43) -> Pipeline:
    return Pipeline(
        stages=[
            *_inputs(features),
            GBTRegressor(featuresCol="vector", labelCol=target, predictionCol="pred_edge", maxIter=max_iter, maxDepth=depth, seed=seed),
        ]
    )


def score(model: PipelineModel, df: DataFrame, name: str = "p_model") -> DataFrame:
    """Probability of class 1 per row; works on a table and on a stream."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def with_edges(df: DataFrame, prob: str = "p_model") -> DataFrame:
    return df.withColumns(
        {
            "edge_model_yes_ask": F.col(prob) - F.col("yes_ask"),
            "edge_model_no_ask": (1.0 - F.col(prob)) - F.col("no_ask"),
        }
    )


def fit_binary(
    df: DataFrame, *, features: Sequence[str], label: str, split: str = "split", kind: str = "logistic",
    balanced: bool = False, max_iter: int = 50,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on train (early stopping on valid where supported) and score the test rows."""
    ready = prepared(df, features, label)
    if balanced:
        ready = with_class_weights(ready)
    columns = [*features, "label", *(["weight"] if balanced else [])]
    if kind == "logistic":
        model = _fitted(logistic(features, balanced=balanced, max_iter=max_iter), ready.where(F.col(split) == "train"), columns)
    elif kind == "boosted":
        seen = ready.where(F.col(split).isin("train", "valid")).withColumn("is_valid", F.col(split) == "valid")
        model = _fitted(boosted(features, balanced=balanced, max_iter=max_iter), seen, [*columns, "is_valid"])
    else:
        raise ValueError("kind must be 'logistic' or 'boosted'")
    return model, score(model, ready.where(F.col(split) == "test"))


def model_comparison(
    df: DataFrame, *, features: Sequence[str], label: str, baselines: Sequence[str], kinds: Sequence[str] = ("logistic", "boosted"),
    max_iter: int = 50,
) -> DataFrame:
    """Test metrics of each model next to the baseline probability columns."""
    parts = []
    for kind in kinds:
        _, scored = fit_binary(df, features=features, label=label, kind=kind, max_iter=max_iter)
        parts.append(binary_metrics(scored, label="label", prob="p_model").withColumn("model", F.lit(kind)))
    test = df.where("split = 'test'")
    for b in baselines:
        parts.append(binary_metrics(test, label=label, prob=b).withColumn("model", F.lit(b)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def net_edge_model(
    df: DataFrame, *, features: Sequence[str], edges: Sequence[float], probabilities: Sequence[float], min_trades: int,
    max_iter: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Regression of the net result, a classifier calibrated on valid, thresholds chosen on valid.

    Input has ``net_pnl``, ``label_net`` and ``split``. Returns the chosen thresholds and
    the scored test rows with ``selected``.
    """
    ready = prepared(df, features, "label_net")
    seen = with_class_weights(ready.where("split IN ('train', 'valid')").withColumn("is_valid", F.col("split") == "valid"))
    with spread(seen, [*features, "label", "weight", "is_valid", "net_pnl"]) as kept:
        classifier = boosted(features, balanced=True, max_iter=max_iter).fit(kept)
        regressor = boosted_regression(features, "net_pnl", max_iter=max_iter).fit(kept.where("NOT is_valid"))

    def both(rows: DataFrame) -> DataFrame:
        raw = score(classifier, rows, "pred_raw")
        return regressor.transform(raw).select(*raw.columns, "pred_edge")

    valid = both(ready.where("split = 'valid'"))
    # equal scores are counted first: the fit pools them anyway, and brings all of one score to one task
    points = valid.groupBy("pred_raw", "label").agg(F.count("*").cast("double").alias("points"))
    iso = IsotonicRegression(featuresCol="pred_raw", labelCol="label", weightCol="points", predictionCol="pred_prob").fit(points)
    chosen = choose_threshold(iso.transform(valid), keys=[], edges=edges, probabilities=probabilities, min_trades=min_trades)
    test = iso.transform(both(ready.where("split = 'test'")))
    picked = null_safe_join(test, chosen.select("edge_threshold", "prob_threshold"), [], "inner")
    keep = (F.col("pred_edge") >= F.col("edge_threshold")) & (F.col("pred_prob") >= F.col("prob_threshold"))
    return chosen, picked.withColumn("selected", keep)


def per_parameter_models(
    df: DataFrame, *, features: Sequence[str], sets: Sequence[Mapping[str, object]], labels: Mapping[str, str], max_iter: int = 20
) -> DataFrame:
    """One model per parameter set and direction; the driver only loops over the sets."""
    parts = []
    for params in sets:
        rows = df
        for name, value in params.items():
            rows = rows.where(F.col(name) == value)
        for direction, label in labels.items():
            _, scored = fit_binary(rows, features=features, label=label, kind="logistic", max_iter=max_iter)
            tags = {n: F.lit(x) for n, x in params.items()} | {"direction": F.lit(direction)}
            parts.append(binary_metrics(scored, label="label", prob="p_model").withColumns(tags))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def walk_forward(
    df: DataFrame, *, folds: Sequence[tuple[str, str, str, str, str]], features: Sequence[str], label: str, min_rows: int = 1000,
    max_iter: int = 20,
) -> DataFrame:
    """Fit each fold that is large enough and score its test day; folds come back with status."""
    roles = fold_roles(df, folds)
    status = fold_status(roles, min_rows=min_rows)
    # one row per fold
    fitted = {r["fold"] for r in status.where("status = 'ok'").select("fold").collect()}
    parts = []
    for fold in folds:
        if fold[0] not in fitted:
            continue
        rows = roles.where(F.col("fold") == fold[0]).withColumn("split", F.col("role"))
        _, scored = fit_binary(rows, features=features, label=label, kind="logistic", max_iter=max_iter)
        parts.append(binary_metrics(scored, label="label", prob="p_model").withColumn("fold", F.lit(fold[0])))
    if not parts:
        return status
    metrics = parts[0]
    for p in parts[1:]:
        metrics = metrics.unionByName(p)
    return status.join(metrics, "fold", "left")


def fit_three_way(
    df: DataFrame, *, features: Sequence[str], label: str, classes: Sequence[str] = ("DOWN", "FLAT", "UP"), kind: str = "logistic",
    max_iter: int = 50,
) -> DataFrame:
    """Three-class model on train; per-class metrics on test."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    ready = prepared(df.withColumn("__y", index), features, "__y")
    train = ready.where("split = 'train'")
    if kind == "logistic":
        model = _fitted(logistic(features, balanced=True, max_iter=max_iter), with_class_weights(train), [*features, "label", "weight"])
    else:
        model = _fitted(boosted_multiclass(features, max_iter=max_iter), train, [*features, "label"])
    scored = model.transform(ready.where("split = 'test'"))
    names = F.array(*[F.lit(c) for c in classes])
    scored = scored.withColumn("predicted", F.get(names, F.col("prediction").cast("int")))
    return multiclass_metrics(scored, actual=label, predicted="predicted", classes=classes)
