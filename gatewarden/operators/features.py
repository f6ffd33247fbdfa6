"""Features of routed events, the random forest on them, and scoring."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden import config
from gatewarden.operators.events import blocked, model_context

COLUMNS = ("flink_fraud_score", "asn", "prompt_length", "contains_scam_keyword", "flink_reason_count", "has_user_agent_signal", "has_burst_signal")


def features(score: Column, asn: Column, prompt: Column, reasons: Column) -> dict[str, Column]:
    """The feature columns, the same for training and for scoring; nulls count as 0 or as empty."""
    why = F.coalesce(reasons, F.array().cast("array<string>"))
    text = F.coalesce(prompt, F.lit(""))
    any_of = lambda names: F.arrays_overlap(why, F.array(*map(F.lit, names))).cast("int")
    return {
        "flink_fraud_score": F.coalesce(score.cast("double"), F.lit(0.0)), "asn": F.coalesce(asn.cast("double"), F.lit(0.0)), "prompt_length": F.length(text).cast("double"),
        "contains_scam_keyword": text.rlike(f"(?i){config.SCAM_WORDS}").cast("int"), "flink_reason_count": F.size(why).cast("double"),
        "has_user_agent_signal": any_of(config.UA_REASONS), "has_burst_signal": any_of(config.BURST_REASONS),
    }


def train(df: DataFrame, label: str = "is_fraud", trees: int = 100, depth: int = 12, min_rows: int = 20, seed: int = 42) -> PipelineModel:
    """Random forest with balanced class weights over the feature columns. Too few rows or one class raise."""
    counts = {r[label]: r["count"] for r in df.where(f"{label} is not null").groupBy(label).count().collect()}
    n = sum(counts.values())
    if n < min_rows:
        raise ValueError(f"{n} rows are too few to train on")
    if len(counts) < 2:
        raise ValueError("all rows are of one class")
    weights = F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, n / (len(counts) * m))])
    rows = df.where(f"{label} is not null").withColumn("weight", F.element_at(weights, F.col(label)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol=label, featuresCol="features", weightCol="weight")
    return Pipeline(stages=[VectorAssembler(inputCols=list(COLUMNS), outputCol="features"), forest]).fit(rows)


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``fraud_probability`` and ``model_verdict`` (fraud from the threshold on)."""
    p = vector_to_array("probability")[1]
    return model.transform(df).withColumn("fraud_probability", p).withColumn("model_verdict", F.when(F.col("fraud_probability") >= threshold, "fraud").otherwise("clean")).drop("features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, spark: SparkSession, path: str, version: str, threshold: float = 0.5) -> None:
    model.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"model_version": version, "threshold": threshold, "feature_columns": list(COLUMNS)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """Model and metadata; a model of other feature columns raises."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta["feature_columns"] != list(COLUMNS):
        raise ValueError("the model's features are not those of this version")
    return PipelineModel.load(f"{path}/model"), meta


def resolve_threshold(given: float | None, meta: dict, default: float = 0.5) -> float:
    return given if given is not None else meta.get("threshold", default)


def score_messages(scored: DataFrame, request: Column, version: str, threshold: float = 0.5) -> DataFrame:
    """(topic, value) of scored suspicious events: blocked from the threshold on, else cleared; both carry the model's context."""
    context = model_context(F.col("model_verdict"), F.col("fraud_probability"), F.lit(version), F.lit(threshold))
    bad = F.col("model_verdict") == "fraud"
    r = scored.withColumn("__q", request).withColumn("__q", F.col("__q").withField("rfc", context))
    stopped = blocked(F.col("__q"), F.lit("rfc_scoring"), F.lit("fraud"), F.col("fraud_probability"), F.array().cast("array<string>"))
    return r.select(F.when(bad, config.TOPICS["fraud"]).otherwise(config.TOPICS["clean"]).alias("topic"), F.when(bad, F.to_json(stopped)).otherwise(F.to_json("__q")).alias("value"))
