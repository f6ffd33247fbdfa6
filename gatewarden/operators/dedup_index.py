"""Exactly-one delivery per identifier, over a persisted index of sorted identifier arrays.

The index is a set of immutable runs. A run is a table with one row per hash prefix that holds the
sorted 16-byte digests of the identifiers first seen in that run, and beside them the order value of
the copy that was kept. A batch is reduced to one row per identifier before it is shuffled (so a
single identifier with a third of all rows costs one row per map task), each prefix then searches
the arrays of the earlier runs by bisection, and what is new becomes the next run. Runs are merged
every ``merge_every`` batches. The number of prefixes follows from the rows, so that one prefix's arrays stay
small: the work and memory of a task follow from identifiers / prefixes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.functions.text import clean_id
from gatewarden.workspace import new_path, shuffle_width, stored

RUN_SCHEMA = "prefix int, ids binary, kept array<bigint>"
#: Rows of a hash prefix at most, in the mean: 24 bytes each in the task that holds them.
PREFIX_ROWS = 4_000_000


def _sorted_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="S16") if blob else np.empty(0, dtype="S16")


def _digests(values) -> np.ndarray:
    # all are 16 bytes long, so that S16 ignores trailing zeros leaves equality as it is
    return np.frombuffer(b"".join(values), dtype="S16")


def _known(ids: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """Which of ``ids`` occur in any sorted run (bisection)."""
    seen = np.zeros(len(ids), dtype=bool)
    for run in runs:
        if len(run):
            at = np.searchsorted(run, ids)
            at[at == len(run)] = 0
            seen |= run[at] == ids
    return seen


def _ingest(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if batch.empty:
        return pd.DataFrame([], columns=["prefix", "ids", "kept"], dtype=object)
    ids, order = _digests(batch["digest"]), batch["first"].to_numpy("int64")
    fresh = ~_known(ids, [_sorted_ids(b) for b in index["ids"]])
    ids, order = ids[fresh], order[fresh]
    rank = np.argsort(ids, kind="stable")
    return pd.DataFrame({"prefix": batch["prefix"].iloc[:1].to_list(), "ids": [ids[rank].tobytes()], "kept": [order[rank]]})


def _merge(runs: pd.DataFrame) -> pd.DataFrame:
    ids = np.concatenate([_sorted_ids(b) for b in runs["ids"]])
    kept = np.concatenate([np.asarray(k, dtype="int64") for k in runs["kept"]])
    rank = np.argsort(ids, kind="stable")
    return pd.DataFrame({"prefix": runs["prefix"].iloc[:1].to_list(), "ids": [ids[rank].tobytes()], "kept": [kept[rank]]})


class DedupIndex:
    """Index of identifiers already seen.

    ``ingest`` takes the next batch and adds its new identifiers, keeping of each the row with the
    smallest order value; identifiers of earlier batches are never kept again. Null and blank
    identifiers equal nothing: the index ignores them. Identifiers are compared by MD5 digest of the
    trimmed lower-case text.

    Runs are tables under ``folder`` (one of the shared workspace if none is given). After each batch a
    manifest names the runs that make up the index; ``open`` goes on from the last one.
    """

    def __init__(self, spark: SparkSession, prefixes: int = 64, merge_every: int = 2, folder: str | None = None):
        self.spark, self.prefixes, self.merge_every = spark, prefixes, merge_every
        self.folder = folder or new_path(spark, "dedup-index")
        self.paths: list[str] = []
        self.version = 0
        self.merges = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> DedupIndex:
        """The index that was built in the folder; raises if there is none."""
        rows = spark.read.schema("version int, prefixes int, merge_every int, paths array<string>").json(f"{folder}/manifest").orderBy(F.desc("version")).limit(1).collect()
        if not rows:
            raise ValueError(f"no index in {folder}")
        last = rows[0]
        index = cls(spark, last.prefixes, last.merge_every, folder)
        index.version, index.paths = last.version, list(last.paths)
        return index

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.read.schema(RUN_SCHEMA).parquet(p) for p in self.paths]

    def _store(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{self.version}-{uuid.uuid4().hex}"
        stored(df, name, path)
        return path

    def _commit(self) -> None:
        """The next manifest; runs that it does not name are no part of the index."""
        self.version += 1
        row = self.spark.createDataFrame([(self.version, self.prefixes, self.merge_every, self.paths)], "version int, prefixes int, merge_every int, paths array<string>")
        row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _index(self) -> DataFrame:
        out = self.spark.createDataFrame([], RUN_SCHEMA)
        for run in self.runs:
            out = out.unionByName(run)
        return out

    def ingest(self, batch: DataFrame, identifier: Column, order: Column) -> DataFrame:
        """Add a batch; returns its run (one row per hash prefix)."""
        width = min(self.prefixes, shuffle_width(self.spark))
        novel = (
            batch.select(F.unhex(F.md5(clean_id(identifier))).alias("digest"), order.cast("bigint").alias("first"))
            .where("digest is not null")
            .groupBy("digest")
            .agg(F.min("first").alias("first"))
            .withColumn("prefix", F.pmod(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int"), F.lit(self.prefixes)).cast("int"))
            .repartition(width, "prefix")
        )
        known = self._index().select("prefix", "ids").repartition(width, "prefix")
        path = self._store(novel.groupBy("prefix").cogroup(known.groupBy("prefix")).applyInPandas(_ingest, RUN_SCHEMA), "run")
        self.paths.append(path)
        if len(self.paths) > self.merge_every:
            self.paths = [self._store(self._index().groupBy("prefix").applyInPandas(_merge, RUN_SCHEMA), "merged")]
            self.merges += 1
        self._commit()
        return self.spark.read.schema(RUN_SCHEMA).parquet(path)

    def kept(self) -> DataFrame:
        """Order value of the one kept row of each identifier."""
        return self._index().select(F.explode("kept").alias("kept_order"))


def arrival_rounds(rows: DataFrame, order: str, rounds: int) -> Iterator[DataFrame]:
    """The rows in ``rounds`` ranges of the order column (its parquet statistics prune each read)."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return
    step = max(1, -(-(high - low + 1) // rounds))
    for start in range(low, high + 1, step):
        yield rows.where(F.col(order).between(start, min(high, start + step - 1)))


def build_index(rows: DataFrame, identifier: str, order: str, rounds: int = 3, **options) -> DedupIndex:
    """Index of a whole table, taken in as ``rounds`` batches in arrival order.

    There are as many hash prefixes as keep one prefix below ``PREFIX_ROWS`` rows, 64 at least.
    """
    options.setdefault("prefixes", max(64, -(-rows.count() // PREFIX_ROWS)))
    index = DedupIndex(rows.sparkSession, **options)
    for batch in arrival_rounds(rows.select(identifier, order), order, rounds):
        index.ingest(batch, F.col(identifier), F.col(order))
    return index


def superfluous(rows: DataFrame, index: DedupIndex, identifier: str, order: str) -> DataFrame:
    """Order values of the rows that are further copies of a kept row.

    Rows with a null or blank identifier are never superfluous. The anti join is on the unique order
    value, so no key is hot however many copies a message has. An empty table gives no rows.
    """
    named = rows.where(clean_id(F.col(identifier)).isNotNull()).select(order)
    return named.join(index.kept(), F.col(order) == F.col("kept_order"), "left_anti")


def exactly_once(rows: DataFrame, index: DedupIndex, identifier: str, order: str) -> DataFrame:
    """One row per identifier, and every row without one; all columns kept."""
    named = clean_id(F.col(identifier)).isNotNull()
    kept = rows.where(named).join(index.kept(), F.col(order) == F.col("kept_order"), "left_semi")
    return kept.unionByName(rows.where(~F.coalesce(named, F.lit(False))))
