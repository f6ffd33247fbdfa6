"""Metrics of verdicts against labels, and the sweep over rule weights and thresholds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """Counts and rates of a yes/no prediction; a rate without cases is 0."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns({
        "tpr": F.round(recall, 6), "fpr": F.round(_ratio(fp, fp + tn), 6), "prec": F.round(precision, 6),
        "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6), "accuracy": F.round(_ratio(tp + tn, tp + fp + fn + tn), 6),
    })


def class_report(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision, recall, F1 and support of both classes and their macro and weighted means."""
    one = lambda v: confusion(df.where(f"{actual} is not null"), F.col(predicted) == v, F.col(actual) == v).select(F.lit(str(v)).alias("label"), F.col("prec"), F.col("tpr").alias("recall"), "f1", (F.col("tp") + F.col("fn")).alias("support"))
    classes = one(0).unionByName(one(1))
    macro = classes.agg(F.lit("macro").alias("label"), *[F.round(F.avg(c), 6).alias(c) for c in ("prec", "recall", "f1")], F.sum("support").alias("support"))
    weighted = classes.agg(F.lit("weighted").alias("label"), *[F.round(_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")), 6).alias(c) for c in ("prec", "recall", "f1")], F.sum("support").alias("support"))
    return classes.unionByName(macro).unionByName(weighted)


def signature_histogram(df: DataFrame, reasons: str, label: str, names: tuple[str, ...]) -> DataFrame:
    """Rows by the bit mask of the named reasons: (mask, clean, fraud). At most 2^len(names) rows."""
    mask = sum((F.when(F.array_contains(F.col(reasons), n), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    return df.groupBy(F.coalesce(mask, F.lit(0)).cast("bigint").alias("mask")).agg(F.count_if(F.col(label) == 0).alias("clean"), F.count_if(F.col(label) == 1).alias("fraud"))


def weight_grid(base: list[int], vary: dict[int, list[int]], suspicious: list[int], fraud: list[int]) -> list[tuple]:
    """(weights in hundredths, suspicious threshold, fraud threshold) of all combinations with suspicious < fraud."""
    out = []
    for values in product(*vary.values()):
        weights = list(base)
        for at, v in zip(vary, values):
            weights[at] = v
        out += [(weights, s, f) for s in suspicious for f in fraud if s < f]
    return out


def sweep(histogram: DataFrame, grid: list[tuple]) -> DataFrame:
    """Counts and rates of every configuration of the grid over the signatures.

    Rows are first reduced to signatures, so the grid (given in the plan, thousands of rows) meets at most
    2^rules of them. A fraud judged suspicious is neither found nor missed.
    """
    spark = histogram.sparkSession
    configs = spark.createDataFrame([(i, w, s, f) for i, (w, s, f) in enumerate(grid)], "config int, weights array<int>, sus int, fra int")
    n = len(grid[0][0])
    points = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda acc, i: acc + F.when(F.getbit("mask", i) == 1, F.get("weights", i)).otherwise(0))
    joined = histogram.join(F.broadcast(configs)).withColumn("points", F.least(points, F.lit(100)))
    is_fraud, is_sus = F.col("points") >= F.col("fra"), (F.col("points") >= F.col("sus")) & (F.col("points") < F.col("fra"))
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    g = joined.groupBy("config", "sus", "fra").agg(
        total(is_fraud, "fraud").alias("tp"), total(is_fraud, "clean").alias("fp"), total(is_sus, "fraud").alias("sus_fraud"), total(is_sus, "clean").alias("sus_clean"),
        total(~is_fraud & ~is_sus, "fraud").alias("fn"), F.sum("fraud").alias("n_fraud"), F.sum("clean").alias("n_clean"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    return g.select("config", "sus", "fra", "tp", "fp", "fn", "sus_fraud", "sus_clean", F.round(_ratio(tp, F.col("n_fraud")), 6).alias("tpr"), F.round(_ratio(fp, F.col("n_clean")), 6).alias("fpr"), F.round(_ratio(tp, tp + fp), 6).alias("prec"))


def best(swept: DataFrame, n: int = 40) -> DataFrame:
    """The best configurations: found fraud first, then false alarms, then clean rows held back."""
    return swept.orderBy(F.desc("tpr"), "fp", "sus_clean", "config").limit(n)


def near_target(swept: DataFrame, first: str, second: str, n: int = 10) -> DataFrame:
    """Configurations that meet the first target, or, if none does, at most ``n`` that meet the second."""
    hits = swept.where(first)
    return hits if hits.limit(1).count() else swept.where(second).orderBy(F.desc("tpr"), "fp", "sus_clean", "config").limit(n)
