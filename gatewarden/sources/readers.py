"""Readers: message topics, JSON lines, parquet, log text, folders of several formats."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewarden.config import LOG_LINE
from gatewarden.operators.events import parse_json

MESSAGE = "topic string, value string"


def kafka_options(servers: str, topics: list[str], from_beginning: bool = False, **more) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest" if from_beginning else "latest"} | more


def topic_stream(spark: SparkSession, servers: str, topics: list[str], from_beginning: bool = False) -> DataFrame:
    """Stream of (topic, value) of one or several topics; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topics, from_beginning)).load().select("topic", F.col("value").cast("string").alias("value"))


def drain_topics(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """All messages of the topics up to now, as a batch."""
    return spark.read.format("kafka").options(**kafka_options(servers, topics, True, endingOffsets="latest")).load().select("topic", F.col("value").cast("string").alias("value"))


def line_stream(spark: SparkSession, folder: str, topic: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the lines of the files that appear in a folder, as messages of one topic; a bound on the
    files of a trigger makes it a rate-limited replay."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(F.lit(topic).alias("topic"), "value")


def union_topics(tables: dict[str, DataFrame]) -> DataFrame:
    """Messages of several tables with the name of their topic."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("topic", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def json_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Lines as VARIANT ``event``; blank lines are skipped, and lines that are no objects too, or raise if ``strict``."""
    rows = parse_json(spark.read.text(path).where(F.trim("value") != ""), "value")
    if strict:
        return rows.select(F.when(F.col("parse_error").isNull(), F.col("event")).otherwise(F.raise_error(F.concat(F.col("parse_error"), F.lit(": "), F.substring("value", 1, 200))).cast("variant")).alias("event"))
    return rows.where("parse_error is null").select("event")


def typed_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def folder_rows(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """Rows of all ``*.jsonl`` and ``*.parquet`` files under a folder, with missing columns as null."""
    lines = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)
    columns = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    return lines.unionByName(columns, allowMissingColumns=True)


def read_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Verdict, req_id, score, reasons and topic of each log line; other lines are dropped."""
    at = lambda i: F.regexp_extract(value, LOG_LINE, i)
    return lines.where(F.col(value).rlike(LOG_LINE)).select(F.lower(at(1)).alias("verdict"), at(2).alias("req_id"), at(3).cast("double").alias("score"), F.from_json(at(4), "array<string>").alias("reasons"), at(5).alias("topic"))


def with_labels(messages: DataFrame, labels: DataFrame, key: str = "req_id") -> DataFrame:
    """Messages with the label of their request, for a look at a topic; unlabelled ones keep a null label."""
    return messages.withColumn(key, F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "string")).join(labels, key, "left")


def debug_view(messages: DataFrame, chars: int = 800) -> DataFrame:
    return messages.select("topic", F.substring("value", 1, chars).alias("value"))


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines that set what the environment lacks; comments and other lines are skipped."""
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and not key.startswith("#"):
                    found[key.strip()] = os.environ.setdefault(key.strip(), value.strip().strip("\"'"))
    return found


def reference_terms(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Terms (sorted, distinct, lower case) and reference prompts of a JSON reference set."""
    row = spark.read.option("multiLine", True).schema("version string, bad_terms array<string>, reference_prompts array<struct<text: string, category: string>>").json(path)
    terms = row.select(F.array_sort(F.array_distinct(F.transform("bad_terms", lambda t: F.lower(F.trim(t)))))).first()[0]
    return terms, row.select(F.posexplode("reference_prompts").alias("ref_id", "r")).select("ref_id", "r.text", "r.category")
