"""Requests and documents as one table of records: (origin, record_id, text, label, source, publisher_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.functions.text import clean_id
from gatewarden.tables import table


def records(spark: SparkSession, folder: str, unnamed: bool = False) -> DataFrame:
    """Every delivery with a named message, and every document, without a shuffle.

    A message delivered several times comes several times: results are made distinct by record, which
    moves the few results in place of the texts. Rows with a null text are left out, and those with a
    blank req_id unless ``unnamed`` asks for them: their record_id is ``delivery:`` and the delivery_id.
    """
    own = clean_id(F.col("req_id"))
    name = F.coalesce(own, F.concat(F.lit("delivery:"), F.col("delivery_id").cast("string"))) if unnamed else own
    requests = table(spark, folder, "raw_requests").select(
        F.lit("request").alias("origin"), name.alias("record_id"), F.col("prompt").alias("text"),
        F.col("language").alias("label"), F.lit(None).cast("string").alias("source"), clean_id(F.col("publisher_id")).alias("publisher_id"),
    ).where("record_id is not null and text is not null")
    documents = table(spark, folder, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").cast("string").alias("record_id"), "text",
        F.col("lang").alias("label"), F.col("source"), clean_id(F.col("publisher_id")).alias("publisher_id"),
    ).where("record_id is not null and text is not null")
    return requests.unionByName(documents)


def row_count(spark: SparkSession, folder: str) -> int:
    """Rows that the records come from, from the files' footers: no column is read."""
    return table(spark, folder, "raw_requests").count() + table(spark, folder, "documents").count()


def bounded_sample(df: DataFrame, rows: int, *order: str, about: int | None = None) -> list:
    """At most ``rows`` rows, the first by the hash of the given columns: the same rows for the same table.

    Rows are first thinned by that hash to a few times as many, so that tasks send the driver little
    however many they are. ``about`` is an upper bound of the rows; without it they are counted, which is
    one scan more. A bound of over four times the rows there are gives fewer rows than asked for.
    """
    bits = 1 << 20
    place = F.pmod(F.xxhash64(*order), F.lit(bits))
    n = df.count() if about is None else about
    keep = bits if n <= 4 * rows else max(1, (2 if about is None else 4) * rows * bits // n)
    return df.where(place < keep).orderBy(place, *order).limit(rows).collect()
