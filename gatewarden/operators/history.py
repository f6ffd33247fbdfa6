"""History: labels joined to routed events, already exported ones left out, counters, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_label(labels: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``; a map-side ``max_by``, so a hot key costs one row per task."""
    rest = [c for c in labels.columns if c not in (key, order)]
    return labels.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def label_join(events: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    return events.join(last_label(labels, key, order), key)


def not_exported(events: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    return events.join(exported.select(key).distinct(), key, "left_anti")


def with_default_label(events: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Left join; an event without label counts as 0."""
    return events.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit(0)))


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by the given order; null keys are one group. Ties need a total order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def export_status(events: DataFrame, labels: DataFrame, exported: DataFrame, key: str, order: str) -> DataFrame:
    """Number of events by what the export does with them, and of all events (``consumed``).

    The place of an event among those of its key is a window by key; only the first matters, so it is found
    by a map-side minimum and joined on the unique order value.
    """
    firsts = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    marked = (
        events.join(firsts.select(F.col("__first").alias(order), F.lit(True).alias("__is_first")), order, "left")
        .join(exported.select(key).distinct().withColumn("__done", F.lit(True)), key, "left")
        .join(labels.select(key).distinct().withColumn("__labelled", F.lit(True)), key, "left")
    )
    status = (
        F.when(F.col(key).isNull(), "no_req_id").when(F.col("__done"), "already_exported").when(F.col("__is_first").isNull(), "duplicate_topic")
        .when(F.col("__labelled").isNull(), "skipped_unlabeled").otherwise("exported")
    )
    counted = marked.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return counted.unionByName(events.agg(F.count("*").alias("n")).withColumn("status", F.lit("consumed")))


def risk_rollup(df: DataFrame, key: str, label: str, score: str | None, names: tuple[str, ...]) -> DataFrame:
    """Count, fraud rate and, if a score is given, its mean, by key."""
    aggs = [F.count("*").alias(names[0]), F.avg(F.col(label).cast("double")).alias(names[1])]
    if score:
        aggs.append(F.avg(score).alias(names[2]))
    return df.groupBy(key).agg(*aggs)


def session_rollup(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("requests_per_session"), F.sum(F.col(label).cast("bigint")).alias("fraud_requests_per_session"))


def count_by(df: DataFrame, value: Column) -> DataFrame:
    """Rows per value, null as ``None``."""
    return df.groupBy(F.coalesce(value.cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n"))


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    """Adds ``is_train``: of each label the first share of rows by the SHA-256 of key and seed.

    A label with fewer than two rows is all train. Ranks are exact without one task per label: counts of
    hash buckets place a bucket, and only inside a bucket are rows ranked.
    """
    h = df.withColumn("__h", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)), 256)).withColumn("__b", F.substring("__h", 1, 3))
    buckets = h.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    by_label = Window.partitionBy(label).orderBy("__b")
    placed = buckets.withColumn("__before", F.coalesce(F.sum("__n").over(by_label.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(label))).drop("__n").withColumnRenamed(label, "__l")
    inside = h.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)))
    j = inside.join(placed.withColumnRenamed("__b", "__b2"), (F.col("__b") == F.col("__b2")) & F.col(label).eqNullSafe(F.col("__l")))
    rank = F.col("__r") + F.col("__before")
    return j.withColumn("is_train", (F.col("__all") < 2) | (rank <= F.floor(F.lit(share) * F.col("__all")))).select(*df.columns, "is_train")


def export_rows(events: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    """Events with the last label of their key and the time of the export (``exported_at``, seconds)."""
    return label_join(events, labels, key, order).withColumn("exported_at", F.unix_timestamp())
