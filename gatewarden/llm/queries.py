"""Queries of the operators for training data, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.functions.text import clean_id
from gatewarden.llm import abuse, bpe, languages, leaks, overlap, pii, sentences, splits
from gatewarden.llm.records import records, row_count
from gatewarden.tables import table


def _abuse_scores(spark: SparkSession, folder: str, unnamed: bool = True) -> DataFrame:
    rows = records(spark, folder)
    net = abuse.fit_on(rows, abuse.verdicts_of(table(spark, folder, "moderated_requests")), row_count(spark, folder))
    return abuse.score_table(records(spark, folder, unnamed), net)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse_scores(spark, folder, unnamed=False).where(F.col("score") >= abuse.THRESHOLD).select("origin", "record_id").distinct()


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse_scores(spark, folder).select("origin", "record_id", "score")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(_abuse_scores(spark, folder))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_requests")
    return splits.components(splits.ties(rows.select(clean_id(F.col("publisher_id")).alias("left"), splits.session_key(F.col("request_context.session_id")).alias("right"))))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.linked_pairs(_links(spark, folder)).select(F.col("a").alias("publisher_id_a"), F.col("b").alias("publisher_id_b"))


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_requests")
    return splits.assign_splits(rows, "delivery_id", clean_id(F.col("publisher_id")), splits.session_key(F.col("request_context.session_id")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return languages.find_cases(rows, languages.fit_on(rows, about=row_count(spark, folder)))


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return languages.record_table(rows, languages.fit_on(rows, about=row_count(spark, folder)))


def p7_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return languages.segment_table(rows, languages.fit_on(rows, about=row_count(spark, folder)))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return pii.find_kinds(rows, pii.fit_on(rows, about=row_count(spark, folder)))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return pii.redacted_table(records(spark, folder, unnamed=True), pii.fit_on(rows, about=row_count(spark, folder)))


def _labeled(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labeled_requests")
    return rows.select(
        F.col("event.req_id").alias("req_id"), F.col("event.prompt").alias("prompt"), clean_id(F.col("split")).alias("split"),
        clean_id(F.col("event.publisher_id")).alias("publisher_id"), splits.session_key(F.col("event.request_context.session_id")).alias("session_id"),
    ).where("req_id is not null")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.cross_split(_labeled(spark, folder), "req_id", "prompt", "split")
    return pairs.select(F.least("train_key", "eval_key").alias("req_id_a"), F.greatest("train_key", "eval_key").alias("req_id_b"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and publisher: evaluation rows, those that overlap train, and their mean coverage by all of train."""
    rows = _labeled(spark, folder)
    best = overlap.Overlap(rows, "req_id", "prompt", "split").coverage()
    held = rows.where("split <> 'train'").join(best, "req_id", "left")
    return held.groupBy("split", "publisher_id").agg(
        F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_table(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_rates": p1_rates, "p3_found": p3_found, "p3_splits": p3_splits, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p7_records": p7_records, "p7_segments": p7_segments, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}

ORACLE = {
    "p3_found": r"""with recursive
      ids as (select nullif(regexp_replace(lower(publisher_id), '^\s+|\s+$', '', 'g'), '') as pub,
                     regexp_replace(lower(request_context.session_id), '^\s+|\s+$', '', 'g') as sid from raw_requests),
      ps as (select distinct pub, sid from ids where pub is not null and regexp_full_match(sid, '[0-9a-f]{32}') and sid <> repeat(substr(sid, 1, 1), 32)),
      e as (select distinct a.pub as a, b.pub as b from ps a join ps b using (sid) where a.pub <> b.pub),
      r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
      select distinct a as publisher_id_a, b as publisher_id_b from r where a < b""",
}
