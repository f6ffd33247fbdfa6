"""Records of one split that occur, the same or almost, in another.

Two texts are almost the same if at least ``share`` of the tokens of the longer one occur in the same
order in the other. Equal folded texts are one class, so copies are compared once, however many there
are. Of an evaluation text of m tokens at most m - ceil(share m) may be missing from a match; so of
its rarest distinct tokens, that many plus c, at least c occur in any match. These tokens, rarest by a
count over all texts, are the patterns of an Aho-Corasick automaton.

Evaluation texts are sharded by length band and, within a band, by hash into shards of a bounded size.
A match is in the same or a neighbouring band, so an evaluation text stands in the shards of three
bands and a training text is scanned by the shards of its own band alone. What an automaton leaves is
decided by the longest common subsequence; its matched intervals are merged over all training texts
into the coverage of each evaluation text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.llm import bitwise
from gatewarden.llm.fold import is_solid, tokens
from gatewarden.workspace import stored

LEAST_WORDS, LEAST_CHARS = 10, 30


def folded_texts(rows: DataFrame, key: str, text: str, side: str) -> DataFrame:
    """(key, side, line, n): folded tokens of each text long enough to be compared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            lines, sizes = [], []
            for t in pdf[text]:
                words = tokens(t)
                keep = len(words) >= (LEAST_CHARS if is_solid(t) else LEAST_WORDS)
                lines.append(" ".join(words) if keep else None)
                sizes.append(len(words))
            yield pd.DataFrame({key: pdf[key], side: pdf[side], "line": lines, "n": sizes})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, side)}
    folded = rows.select(key, side, text).where(F.col(text).isNotNull() & F.col(side).isNotNull())
    return folded.mapInPandas(run, f"`{key}` {kinds[key]}, `{side}` {kinds[side]}, line string, n int").where("line is not null").withColumn("class", F.unhex(F.md5("line")))


class Shard:
    """Automaton over the rare tokens of a shard of evaluation texts."""

    def __init__(self, evals: pd.DataFrame, share: float):
        self.classes = evals["class"].to_list()
        self.lines = [line.split() for line in evals["line"]]
        self.share = share
        self.distinct = [frozenset(x) for x in self.lines]
        self.sizes = np.array([len(x) for x in self.lines])
        may_miss = self.sizes - np.ceil(share * self.sizes - 1e-9).astype(int)
        uses: dict[str, list[int]] = {}
        need = []
        for i, rare in enumerate(evals["rare"]):
            for w in rare:
                uses.setdefault(w, []).append(i)
            need.append(len(rare) - int(may_miss[i]))
        self.need = np.array(need)
        self.least = [len(d) - int(k) for d, k in zip(self.distinct, may_miss)]  # distinct tokens that any match shares
        self.automaton = ahocorasick.Automaton()
        for w, at in uses.items():
            self.automaton.add_word(f" {w} ", np.array(at, dtype=np.int64))
        if uses:
            self.automaton.make_automaton()
        self.masks: dict[int, dict] = {}

    def matches(self, line: str) -> Iterator[tuple[int, int, list[int]]]:
        """(number, common tokens, rows of the comparison) of every evaluation text that is almost the same as ``line``."""
        words = line.split()
        n, hits = len(words), {}
        for end, at in self.automaton.iter(f" {line} "):
            hits[id(at)] = at
        if hits:
            left = np.nonzero(np.bincount(np.concatenate(list(hits.values())), minlength=len(self.need)) >= self.need)[0]
        else:
            left = np.nonzero(self.need <= 0)[0]
        mine = frozenset(words)
        for i in left.tolist():
            size = int(self.sizes[i])
            longer = max(size, n)
            if min(size, n) < self.share * longer - 1e-9 or len(mine & self.distinct[i]) < self.least[i]:
                continue
            at = self.masks.get(i)
            if at is None:
                at = self.masks[i] = bitwise.masks(self.lines[i])
            if bitwise.masked_lcs(at, size, words) >= self.share * longer - 1e-9:
                rows = bitwise.lcs_rows(at, size, words)
                yield i, size - rows[-1].bit_count(), rows


def _spans(rows: list[int], size: int) -> list[int]:
    """Matched stretches of the pattern as a flat list of starts and ends."""
    places = bitwise.lcs_places(rows, size)
    out: list[int] = []
    for p in places:
        if out and out[-1] == p:
            out[-1] = p + 1
        else:
            out += [p, p + 1]
    return out


MATCHES = "train_class binary, eval_class binary, common int, longer int, spans array<int>"


def matching_classes(texts: DataFrame, share: float = 0.8, spare: int = 6, shard_rows: int = 32_000, slice_rows: int = 20_000) -> DataFrame:
    """``MATCHES`` of texts (class, line, n, in_train, in_eval): common tokens, tokens of the longer text, matched stretches of the evaluation text.

    ``shard_rows`` evaluation texts at most are in an automaton, and about ``slice_rows`` training texts are scanned by one task.
    """
    spark = texts.sparkSession
    step = math.log(1 / share)
    texts = texts.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int"))
    words = F.array_distinct(F.split("line", " "))
    frequency = texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    may_miss = F.col("n") - F.ceil(share * F.col("n") - 1e-9)
    spared = F.greatest(F.lit(spare), F.ceil(F.col("n") / 6))
    evals = texts.where("in_eval")
    ranked = evals.select("class", F.explode(words).alias("w")).join(frequency, "w").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ranked"))
    rare = evals.join(ranked, "class").select("class", "line", F.col("band").alias("own"), F.slice(F.transform("ranked", lambda r: r["w"]), F.lit(1), (may_miss + spared).cast("int")).alias("rare"))
    patterns = stored(rare, "patterns")
    # bands are few: the logarithm of the longest text
    n_evals = {r["own"]: r["count"] for r in patterns.groupBy("own").count().collect()}
    n_trains = {r["band"]: r["count"] for r in texts.where("in_train").groupBy("band").count().collect()}
    near_evals = {b: sum(n_evals.get(b + k, 0) for k in (-1, 0, 1)) for b in n_trains}
    cells = {b: (max(1, -(-near_evals[b] // shard_rows)), max(1, -(-n_trains[b] // slice_rows))) for b in n_trains if near_evals[b]}
    if not cells:
        return spark.createDataFrame([], MATCHES)
    shards, slices = (F.element_at(F.create_map(*[F.lit(x) for b, v in cells.items() for x in (b, v[k])]), F.col("band")) for k in (0, 1))
    evals_out = (
        patterns.select("class", "line", "rare", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("band"))
        .where(F.col("band").isin(*cells))
        .withColumn("shard", F.pmod(F.xxhash64("class"), shards).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), (slices - 1).cast("int"))))
    )
    trains = (
        texts.where("in_train")
        .where(F.col("band").isin(*cells))
        .select("class", "line", "band", F.pmod(F.xxhash64("class", F.lit(7)), slices).cast("int").alias("slice"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), (shards - 1).cast("int"))))
    )

    def compare(train: pd.DataFrame, evaluation: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(train) and len(evaluation):
            shard = Shard(evaluation, share)
            for c, line in zip(train["class"], train["line"]):
                for i, common, rows in shard.matches(line):
                    if shard.classes[i] != c:
                        size = int(shard.sizes[i])
                        out.append((c, shard.classes[i], common, max(line.count(" ") + 1, size), _spans(rows, size)))
        return pd.DataFrame(out, columns=["train_class", "eval_class", "common", "longer", "spans"])

    keys = ("band", "shard", "slice")
    near = trains.groupBy(*keys).cogroup(evals_out.groupBy(*keys)).applyInPandas(compare, MATCHES)
    same = texts.where("in_train and in_eval").select(F.col("class").alias("train_class"), F.col("class").alias("eval_class"), F.col("n").alias("common"), F.col("n").alias("longer"), F.array(F.lit(0), F.col("n").cast("int")).alias("spans"))
    return near.unionByName(same)


#: Training rows of one class that a task joins with the evaluation rows.
COPIES = 50_000


class Overlap:
    """Overlap of the rows' train split with their other splits.

    ``split`` holds the lower-case split of each row; any value but ``train`` is evaluation. Rows with a
    null split, a null or a short text are compared with nothing, and an empty table gives no rows.
    """

    def __init__(self, rows: DataFrame, key: str, text: str, split: str, train: str = "train", share: float = 0.8):
        self.key = key
        side = rows.withColumn("__train", F.col(split) == train)
        self.folded = stored(folded_texts(side, key, text, "__train"), "folded")  # (key, __train, line, n, class) of the rows compared
        texts = stored(
            self.folded.groupBy("class").agg(
                F.first("line").alias("line"), F.first("n").alias("n"), F.count_if("__train").alias("train_rows"), F.bool_or("__train").alias("in_train"), F.bool_or(~F.col("__train")).alias("in_eval")
            ),
            "texts",
        )
        self.texts = texts
        self.classes = stored(matching_classes(texts, share), "classes")

    def pairs(self) -> DataFrame:
        """Pairs of rows (train_key, eval_key, coverage). Repeated rows pair one by one; a class with many copies is joined in parts."""
        sized = self.classes.join(self.texts.select(F.col("class").alias("train_class"), F.ceil(F.col("train_rows") / COPIES).cast("int").alias("parts")), "train_class")
        sized = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        copies = self.texts.where("in_train").select("class", F.ceil(F.col("train_rows") / COPIES).cast("int").alias("parts"))
        trains = self.folded.where("__train").join(copies, "class").select(F.col(self.key).alias("train_key"), F.col("class").alias("train_class"), F.pmod(F.xxhash64(self.key), F.col("parts")).cast("int").alias("part"))
        evals = self.folded.where("not __train").select(F.col(self.key).alias("eval_key"), F.col("class").alias("eval_class"))
        return sized.join(trains, ["train_class", "part"]).join(evals, "eval_class").select("train_key", "eval_key", (F.col("common") / F.col("longer")).alias("coverage"))

    def coverage(self) -> DataFrame:
        """(key, n, coverage) of every evaluation row that overlaps: training rows it pairs with, and the share of its
        tokens that the matched intervals of all training texts cover together. Counted by class, without the pairs."""
        copies = self.texts.select(F.col("class").alias("train_class"), "train_rows")
        cells = self.classes.join(copies, "train_class").select("eval_class", "train_rows", F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", 2 * i).alias("a"), F.get("spans", 2 * i + 1).alias("b"))).alias("cut"))
        counted = cells.groupBy("eval_class").agg(F.sum("train_rows").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("cut")))).alias("cuts"))
        covered = F.aggregate(
            "cuts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
            lambda acc, c: F.struct(F.greatest(acc["end"], c["b"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), c["b"] - F.greatest(acc["end"], c["a"]))).alias("sum")),
        )["sum"]
        by_class = counted.join(self.texts.select(F.col("class").alias("eval_class"), F.col("n").alias("size")), "eval_class").select("eval_class", "n", (covered / F.col("size")).alias("coverage"))
        evals = self.folded.where("not __train").select(self.key, F.col("class").alias("eval_class"))
        return evals.join(by_class, "eval_class").select(self.key, "n", "coverage")


def cross_split(rows: DataFrame, key: str, text: str, split: str, train: str = "train", share: float = 0.8) -> DataFrame:
    """Pairs of rows (train_key, eval_key, coverage of the longer text) of different splits that are almost the same."""
    return Overlap(rows, key, text, split, train, share).pairs()
