"""Lifetime classification with Spark ML: train, score, evaluate, persist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scores import confidence_gate, fail_safe_label, label_display, label_seconds, prob_map
from .metrics import classification_report
from .ranking import class_counts, dedup_keep_first, stratified_folds, stratified_split

DEFAULT_ENCODER = "BAAI/bge-small-en-v1.5"


@dataclass
class LifetimeModel:
    """A fitted classifier with what is needed to interpret it."""

    pipeline: PipelineModel
    classes: list[str]
    encoder_name: str = DEFAULT_ENCODER
    confidence_threshold: float = 0.40
    fallback_label: str = C.VOLATILE

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        row = (self.classes, self.encoder_name, self.confidence_threshold, self.fallback_label)
        schema = (
            "classes array<string>, encoder_name string, "
            "confidence_threshold double, fallback_label string"
        )
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LifetimeModel:
        """Fields missing from an older save take their defaults."""
        params = spark.read.json(f"{path}/params").first().asDict()
        known = {k: v for k, v in params.items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(PipelineModel.load(f"{path}/model"), **known)


def _vectors(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(embedding)))


def _whole(embedding: str):
    return F.coalesce(F.col(embedding).isNotNull() & ~F.exists(F.col(embedding), lambda x: x.isNull()), F.lit(False))


def _labelled(df: DataFrame, label: str, embedding: str) -> DataFrame:
    """Rows a model can learn from: a label and a complete vector."""
    return df.filter(F.col(label).isNotNull() & _whole(embedding))


def _by_class(values: dict, column: str):
    """A per-class constant as a column; there are only as many as classes."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs)[F.col(column)]


def _fit(train: DataFrame, label: str, classes: list[str], c: float = 1.0, max_iter: int = 2000) -> PipelineModel:
    """Multinomial L2 logistic regression with balanced class weights.

    The penalty is applied to the summed loss elsewhere and to the mean loss
    here; balanced weights sum to the row count, hence 1 / (C * rows).
    """
    counts = class_counts(train, label)
    rows = sum(counts.values())
    codes = {name: float(i) for i, name in enumerate(classes)}
    weights = {name: rows / (len(counts) * n) for name, n in counts.items()}
    ready = train.withColumn("label_code", _by_class(codes, label)).withColumn(
        "weight", _by_class(weights, label)
    )
    regression = LogisticRegression(
        labelCol="label_code", featuresCol="features", weightCol="weight", family="multinomial",
        elasticNetParam=0.0, regParam=1.0 / (c * rows), standardization=False, maxIter=max_iter,
    )
    return PipelineModel([regression.fit(ready.select("features", "label_code", "weight"))])


def prepare_training(df: DataFrame, question: str, seq: str) -> DataFrame:
    """Duplicate questions removed, first one kept."""
    return dedup_keep_first(df, [question], seq)


def train_lifetime(
    df: DataFrame,
    question: str = "Question",
    label: str = "Temporal_Category",
    embedding: str = "embedding",
    row_id: str = "row_id",
    test_size: float = 0.2,
) -> tuple[LifetimeModel, DataFrame]:
    """(model, hold-out report)."""
    clean = prepare_training(_labelled(df, label, embedding), question, row_id)
    split = _vectors(stratified_split(clean, label, row_id, test_size), embedding).cache()
    classes = sorted(class_counts(split, label))
    model = LifetimeModel(_fit(split.filter("NOT is_test"), label, classes), classes)
    scored = predict_lifetime(model, split.filter("is_test"), embedding, gate=False)
    return model, classification_report(scored, label, "label")


def predict_lifetime(
    model: LifetimeModel,
    df: DataFrame,
    embedding: str = "embedding",
    lifetimes=C.CLASSIFIER_LIFETIMES,
    gate: bool = True,
) -> DataFrame:
    """Adds ``label, confidence, stage, ttl, ttl_display, all_probs``.

    With ``gate`` an unconvincing top class gives the fallback label while the
    true probabilities stay visible.  A vector that is NULL or holds a NULL gets
    the fail-safe label with confidence 0 and no probabilities.
    """
    size = model.pipeline.stages[-1].numFeatures
    whole = _whole(embedding)
    filled = df.withColumn("_v", F.when(whole, F.col(embedding)).otherwise(F.array_repeat(F.lit(0.0), size)))
    scored = model.pipeline.transform(_vectors(filled, "_v")).withColumn(
        "_p", F.when(whole, vector_to_array(F.col("probability")))
    ).drop("_v")
    threshold = model.confidence_threshold if gate else 0.0
    decided = scored.withColumn(
        "_d", F.when(whole, confidence_gate(F.col("_p"), model.classes, threshold, model.fallback_label))
    ).withColumn("_d", F.struct(fail_safe_label(F.col("_d.label"), F.col("_d.confidence")).alias("safe"), F.col("_d.stage").alias("stage")))
    d = F.col("_d")
    return decided.withColumns(
        {
            "label": d["safe"]["label"],
            "confidence": d["safe"]["confidence"],
            "stage": d["stage"],
            "ttl": label_seconds(d["safe"]["label"], lifetimes),
            "ttl_display": label_display(d["safe"]["label"]),
            "all_probs": prob_map(model.classes, F.col("_p")),
        }
    ).drop("_p", "_d", "features", "rawPrediction", "probability", "prediction")


def evaluate_lifetime(
    model: LifetimeModel,
    df: DataFrame,
    question: str = "Question",
    label: str = "Temporal_Category",
    embedding: str = "embedding",
) -> DataFrame:
    """Report over a labelled set; rows without question or label are dropped."""
    missing = {question, label} - set(df.columns)
    if missing:
        raise ValueError(f"dataset must contain '{question}' and '{label}' columns")
    rows = df.dropna(subset=[question, label]).withColumnRenamed(label, "true_label")
    return classification_report(predict_lifetime(model, rows, embedding), "true_label", "label")


def cross_validate(
    df: DataFrame,
    question: str = "Question",
    label: str = "Temporal_Category",
    embedding: str = "embedding",
    row_id: str = "row_id",
    folds: int = 5,
) -> DataFrame:
    """One row per fold: (fold, rows, accuracy); one Spark fit each."""
    clean = prepare_training(_labelled(df, label, embedding), question, row_id)
    data = _vectors(stratified_folds(clean, label, row_id, folds), embedding).cache()
    classes = sorted(class_counts(data, label))
    scored = None
    for fold in range(folds):
        fitted = LifetimeModel(_fit(data.filter(F.col("fold") != fold), label, classes), classes)
        held = predict_lifetime(fitted, data.filter(F.col("fold") == fold), embedding, gate=False)
        part = held.groupBy("fold").agg(
            F.count("*").alias("rows"),
            F.avg((F.col("label") == F.col(label)).cast("double")).alias("accuracy"),
        )
        scored = part if scored is None else scored.unionByName(part)
    return scored
