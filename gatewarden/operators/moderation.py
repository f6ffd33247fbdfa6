"""Moderation of prompts: term gate, keyword categories, similarity to reference prompts, providers."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewarden import config
from gatewarden.functions.text import fold_marks, padded, term_hit
from gatewarden.operators.events import blocked, moderation_context


def compatibility_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """NFKC of the lower-case text. ASCII texts, already in that form, do not leave the JVM."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))

    @F.pandas_udf(T.StringType())
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    plain = low.rlike(r"^\p{ASCII}*$")
    return df.withColumn("__n", nfkc(F.when(~plain, low))).withColumn(out, fold_marks(F.coalesce("__n", low))).drop("__n")


def hits(normalised: Column, terms: tuple[str, ...] = config.TERMS) -> Column:
    """Sorted terms of which the words occur in order, at most one other word between neighbours."""
    clean = sorted({t.lower().strip() for t in terms})
    return F.array_compact(F.array(*[F.when(term_hit(normalised, t), F.lit(t)) for t in clean]))


def hit_score(found: Column) -> Column:
    return F.least(F.size(found) / F.lit(10.0), F.lit(1.0))


def categories(normalised: Column, words: dict[str, tuple[str, ...]] = config.CATEGORY_WORDS) -> Column:
    """Categories of which a keyword occurs as whole words."""
    inner = padded(normalised)
    one = lambda ks: F.greatest(*[inner.contains(f" {k} ") for k in ks], F.lit(False))
    return F.array_compact(F.array(*[F.when(one(ks), F.lit(c)) for c, ks in words.items()]))


def category_score(found: Column) -> Column:
    return F.round(F.least(F.size(found) * F.lit(0.15), F.lit(1.0)), 3)


GRAM_SIZES = (3, 4, 5)
#: Bound of the reference side of the similarity: features times reference texts.
MAX_CELLS = 6_000_000


def word_grams(word: str) -> list[str]:
    """Character n-grams of a word with a space on both sides."""
    padded_word = f" {word} "
    return [padded_word[i : i + n] for n in GRAM_SIZES for i in range(len(padded_word) - n + 1)]


class SimilarityIndex:
    """TF-IDF vectors of reference texts: the most frequent n-grams, tf = 1 + ln(count), smoothed idf, unit length."""

    def __init__(self, texts: list[str], max_features: int = 3000):
        counts = [Counter(g for w in t.split() for g in word_grams(w)) for t in texts]
        total, df = Counter(), Counter()
        for c in counts:
            total.update(c)
            df.update(c.keys())
        kept = sorted(total, key=lambda g: (-total[g], g))[:max_features]
        if len(kept) * len(texts) > MAX_CELLS:
            raise ValueError(f"{len(texts)} reference texts are too many to compare with at once: take them in blocks")
        self.at = {g: i for i, g in enumerate(kept)}
        self.idf = np.array([math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in kept])
        self.matrix = np.zeros((len(kept), len(texts)), dtype=np.float64)
        for j, c in enumerate(counts):
            for g, n in c.items():
                if g in self.at:
                    self.matrix[self.at[g], j] = (1 + math.log(n)) * self.idf[self.at[g]]
        norm = np.sqrt((self.matrix**2).sum(0))
        self.matrix /= np.where(norm > 0, norm, 1)
        self.words: dict[str, np.ndarray] = {}

    def _features(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 500_000:
                self.words.clear()
            got = self.words[word] = np.array([i for g in word_grams(word) if (i := self.at.get(g)) is not None], dtype=np.int32)
        return got

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(highest cosine, place of the reference or -1) of each text; ties go to the first reference."""
        score, where = np.zeros(len(texts)), np.full(len(texts), -1)
        for k, t in enumerate(texts):
            parts = [self._features(w) for w in t.split()] if t else []
            ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
            if len(ids):
                some, n = np.unique(ids, return_counts=True)
                x = (1 + np.log(n)) * self.idf[some]
                cos = np.round((x / math.sqrt(float(x @ x))) @ self.matrix[some], 9)
                top = int(cos.argmax()) if len(cos) else -1
                if top >= 0 and cos[top] > 0:
                    score[k], where[k] = cos[top], top
        return score, where


def max_similarity(df: DataFrame, key: str, normalised: str, reference: DataFrame, ref_key: str, ref_text: str, terms: tuple[str, ...] = (), max_features: int = 3000) -> DataFrame:
    """(key, similarity, ref_key): best TF-IDF cosine of each text to the reference texts and the bad terms.

    The weights are fitted on the reference texts and the terms together. A term has no key, so a text that
    is most like a term gets its similarity and a null ``ref_key``; so does one without a common feature,
    with 0. The reference set is bounded (``MAX_CELLS``) and sent to the tasks once; texts are compared in
    one pass without a shuffle. Null and empty texts have similarity 0; ties go to the smaller key.
    """
    rows = reference.select(ref_key, ref_text).where(F.coalesce(ref_text, F.lit("")) != "").orderBy(ref_key).limit(MAX_CELLS // 100).collect()
    kind = reference.schema[ref_key].dataType.simpleString()
    keys = [r[0] for r in rows] + [None] * len(terms)
    index = df.sparkSession.sparkContext.broadcast(SimilarityIndex([r[1] for r in rows] + sorted(terms), max_features))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = index.value
        for pdf in frames:
            score, where = gate.best([t or "" for t in pdf[normalised]])
            yield pd.DataFrame({key: pdf[key], "similarity": score, ref_key: pd.Series([keys[i] if i >= 0 else None for i in where], dtype=object)})

    own = df.schema[key].dataType.simpleString()
    return df.select(key, normalised).mapInPandas(run, f"`{key}` {own}, similarity double, `{ref_key}` {kind}")


def with_provider(df: DataFrame, key: str, text: str, judge: Callable[[str], tuple[bool, float, list[str]]]) -> DataFrame:
    """Adds flagged, provider_score (at most 1, 3 places), provider_categories, provider_error and provider_message from an outside judge.

    Each distinct text is judged once (by its SHA-256); a call that fails allows its own text and says so.
    """
    cached = df.select(F.sha2(F.col(text), 256).alias("__k"), F.col(text).alias("__t")).where("__t is not null").dropDuplicates(["__k"])

    def ask(t: str) -> tuple:
        try:
            flagged, score, found = judge(t)
            return bool(flagged), round(min(float(score), 1.0), 3), list(found), False, ""
        except Exception as error:
            return False, 0.0, [], True, str(error)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(k, *ask(t)) for k, t in zip(pdf["__k"], pdf["__t"])], columns=["__k", "flagged", "provider_score", "provider_categories", "provider_error", "provider_message"])

    judged = cached.mapInPandas(run, "__k string, flagged boolean, provider_score double, provider_categories array<string>, provider_error boolean, provider_message string")
    names = F.array_sort(F.transform("provider_categories", lambda c: F.upper(F.replace(c, F.lit("/"), F.lit("_")))))
    joined = df.withColumn("__k", F.sha2(F.col(text), 256)).join(judged.withColumn("provider_categories", names), "__k", "left").drop("__k")
    return joined.withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def moderate(df: DataFrame, key: str, prompt: str, threshold: float = 0.01, terms: tuple[str, ...] = config.TERMS, judge: Callable | None = None, audit_share: float = 0.02) -> DataFrame:
    """Adds verdict, method, score, reasons, similarity_score, openai_called, openai_reason and openai_error.

    The term gate gives each prompt a similarity. Without a provider the gate decides. With one it is asked
    about the prompts that reach the threshold and about an audit sample of the others (by the hash of the
    key); what it is not asked about is clean, and so is a prompt on which it fails.
    """
    x = compatibility_form(df, prompt, "__form").withColumn("similarity_score", hit_score(hits(F.col("__form"), terms))).drop("__form")
    over = F.col("similarity_score") >= threshold
    none = F.array().cast("array<string>")
    if judge is None:
        return x.withColumns({
            "verdict": F.when(over, "unsafe").otherwise("clean"), "method": F.lit("tfidf_gate"), "score": F.col("similarity_score"), "reasons": F.when(over, F.array(F.lit("similarity_above_threshold"))).otherwise(none),
            "openai_called": F.lit(False), "openai_reason": F.lit(""), "openai_error": F.lit(False),
        })
    called = over | audit_sample(F.col(key), audit_share)
    asked = with_provider(x.where(called), key, prompt, judge)
    failed = F.coalesce("provider_error", F.lit(False))
    asked = asked.select(
        *x.columns, F.when(F.col("flagged") & ~failed, "unsafe").otherwise("clean").alias("verdict"), F.when(failed, "openai_error_allow").otherwise("openai").alias("method"),
        F.when(failed, F.col("similarity_score")).otherwise(F.coalesce("provider_score", F.lit(0.0))).alias("score"), F.when(failed, F.array(F.lit("openai_error_allowed"))).otherwise(F.coalesce("provider_categories", none)).alias("reasons"),
        F.lit(True).alias("openai_called"), F.coalesce("provider_message", F.lit("")).alias("openai_reason"), failed.alias("openai_error"),
    )
    rest = x.where(~F.coalesce(called, F.lit(False))).select(
        *x.columns, F.lit("clean").alias("verdict"), F.lit("tfidf_gate").alias("method"), F.col("similarity_score").alias("score"), none.alias("reasons"),
        F.lit(False).alias("openai_called"), F.lit("").alias("openai_reason"), F.lit(False).alias("openai_error"),
    )
    return asked.unionByName(rest)


def moderation_messages(judged: DataFrame, request: Column, threshold: float = 0.01, version: str = "") -> DataFrame:
    """(topic, value) of judged requests: unsafe ones blocked, clean ones passed on with their moderation context."""
    context = moderation_context(F.col("verdict"), F.col("method"), F.col("score"), F.col("reasons"), F.round("similarity_score", 4), threshold, version, F.col("openai_called"), F.col("openai_reason"), F.col("openai_error"))
    r = judged.withColumn("__q", request).withColumn("__m", context)
    unsafe = F.col("verdict") == "unsafe"
    stopped = blocked(F.col("__q"), F.lit("moderation"), F.col("verdict"), F.col("score"), F.col("reasons"))
    passed = F.col("__q").withField("moderation", F.col("__m"))
    return r.select(F.when(unsafe, config.TOPICS["fraud"]).otherwise(config.PASSED_TOPIC).alias("topic"), F.when(unsafe, F.to_json(F.when(unsafe, stopped))).otherwise(F.to_json(passed)).alias("value"))


def audit_sample(key: Column, share: float = 0.02) -> Column:
    """Whether a row falls in the audit sample: by the hash of its key, so the same in every run."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") < F.lit(int(share * 2**32))
