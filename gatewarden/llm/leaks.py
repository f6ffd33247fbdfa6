"""Documents that carry passages of held-out items: pigeonhole edit matching.

An item is cut into sentences, and sentences that several items share word for word (instructions)
are dropped. A sentence of n words may differ in about one word of six, so it is cut into one piece
more than it may have errors: any acceptable copy holds one piece unchanged. All pieces of all items
are looked up in a document at once by an automaton; each hit is verified where it stands by Myers'
bit-parallel distance. A verified sentence counts only if most of its own names and numbers (words
of few items) stand in the matched stretch, and a document is reported for an item of whose words
the verified sentences make up half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.llm import bitwise
from gatewarden.llm.broadcasts import bounded
from gatewarden.llm.fold import fold, is_solid, tokens
from gatewarden.workspace import stored

_ENDS = re.compile(r"(?<=[.!?।])\s+|(?<=[。！？])")
#: Numbers, and words with a capital inside the sentence.
_NAMED = re.compile(r"\d[\d.,]*|(?<=\S\s)[^\W\d_a-zß-ÿа-яё][^\W\d_]+")
_NOT_ASCII = re.compile(r"[^a-z0-9]+")


class Sentence:
    """One sentence of an item, ready to be matched."""

    def __init__(self, item: int, words: list[str], solid: bool, rate: int):
        self.item, self.words, self.solid = item, words, solid
        self.budget = max(1, -(-len(words) // rate))
        self.masks = bitwise.masks(words)
        self.own: list[str] = []

    def pieces(self) -> Iterator[tuple[int, int, str]]:
        """(first word, words, text) of budget + 1 pieces of nearly equal length."""
        n, k = len(self.words), min(self.budget + 1, len(self.words))
        for i in range(k):
            a, b = i * n // k, (i + 1) * n // k
            yield a, b - a, f" {' '.join(self.words[a:b])} "


def cut(text: str | None) -> list[tuple[str, list[str], bool]]:
    """(sentence, its symbols, whether they are characters) of an item."""
    out = []
    for part in _ENDS.split(text or ""):
        solid = is_solid(part)
        symbols = letters(part) if solid else tokens(part)
        if symbols:
            out.append((part, symbols, solid))
    return out


def statistics(items: Iterable[tuple[int, str]], shared_by: int = 3, rare: int = 3) -> tuple[set[str], set[str]]:
    """(folded sentences of ``shared_by`` items or more, words of more than ``rare`` items)."""
    sentences, ws = Counter(), Counter()
    for _, text in items:
        parts = cut(text)
        sentences.update({" ".join(symbols) for _, symbols, _ in parts})
        ws.update({w for part, _, _ in parts for w in tokens(part)})
    return {k for k, n in sentences.items() if n >= shared_by}, {k for k, n in ws.items() if n > rare}


class LeakIndex:
    """Automaton over the pieces of a block of items.

    ``shared`` are the sentences that count for no item, ``common`` the words that are no item's own.
    """

    def __init__(self, items: list[tuple[int, str]], shared: set[str], common: set[str], rate: int = 5, least_words: int = 5):
        self.sentences: list[Sentence] = []
        self.total: Counter = Counter()
        for item, text in items:
            for part, words, solid in cut(text):
                if " ".join(words) in shared:
                    continue
                self._add(item, part, words, solid, common, rate, least_words)
        self._build()

    def _add(self, item, part, words, solid, common, rate, least_words) -> None:
        self.total[item] += len(words)
        if len(words) >= least_words:
            s = Sentence(item, words, solid, rate)
            rare = [w for w in dict.fromkeys(tokens(part)) if (w.isascii() or not solid) and w not in common]
            named = {w for m in _NAMED.finditer(part) for w in tokens(m.group())}
            s.own = [w for w in rare if w in named] or rare
            self.sentences.append(s)

    def _build(self) -> None:
        at: dict[str, tuple[int, list[tuple[int, int]]]] = {}
        for i, s in enumerate(self.sentences):
            for first, size, piece in s.pieces():
                at.setdefault(piece, (size, []))[1].append((i, first))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, uses)
        if at:
            self.automaton.make_automaton()
        self.any_solid = any(s.solid for s in self.sentences)
        self.any_words = any(not s.solid for s in self.sentences)

    def _scan(self, words: list[str], solid: bool) -> dict[int, int]:
        """Verified sentences and how many of their words match."""
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for start, hits in self._hits(words):
            for i, first in hits:
                s = self.sentences[i]
                if s.solid is not solid or i in found:
                    continue
                low = max(0, start - first - s.budget)
                if (i, low) in tried:
                    continue
                tried.add((i, low))
                n = len(s.words)
                window = words[low : start - first + n + 2 * s.budget]
                distance, to = bitwise.best_match(s.masks, n, window)
                if distance <= s.budget and self._own(s, window[max(0, to - n - s.budget) : to]):
                    found[i] = n
        return found

    def _hits(self, words: list[str]) -> Iterator[tuple[int, list]]:
        """(word at which a piece starts, sentences and their words that it stands for)."""
        line = f" {' '.join(words)} "
        done, spaces = 0, 0
        for end, (size, uses) in self.automaton.iter(line) if self.sentences else ():
            spaces += line.count(" ", done, end + 1)
            done = end + 1
            yield spaces - 1 - size, uses

    @staticmethod
    def _own(s: Sentence, window: list[str]) -> bool:
        if not s.own:
            return True
        if s.solid:
            text = _NOT_ASCII.sub("", "".join(window))
            return 2 * sum(w in text for w in s.own) >= len(s.own)
        there = set(window)
        return 2 * sum(w in there for w in s.own) >= len(s.own)

    def search(self, text: str) -> list[int]:
        """Items of which the text carries at least half."""
        found: dict[int, int] = {}
        if self.any_words:
            found |= self._scan(tokens(text), False)
        if self.any_solid and is_solid_anywhere(text):
            found |= self._scan(letters(text), True)
        share: Counter = Counter()
        for i, n in found.items():
            share[self.sentences[i].item] += n
        return [item for item, n in share.items() if 2 * n >= self.total[item]]


def letters(text: str) -> list[str]:
    """Every letter and digit of the folded text, for scripts without spaces."""
    return [c for c in fold(text) if c.isalnum()]


def is_solid_anywhere(text: str) -> bool:
    return not text.isascii() and any("㐀" <= c <= "鿿" or "฀" <= c <= "๿" or "぀" <= c <= "ヿ" for c in text)


def _values(items: DataFrame, key: str, text: str) -> DataFrame:
    """(kind, value, item): folded sentences (s) and words (w) of every item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = set()
            for k, t in zip(pdf[key], pdf[text]):
                for part, symbols, _ in cut(t):
                    out.add(("s", " ".join(symbols), str(k)))
                    out.update(("w", w, str(k)) for w in tokens(part))
            yield pd.DataFrame(list(out), columns=["kind", "value", "item"])

    return items.select(key, text).mapInPandas(run, "kind string, value string, item string")


def _shared(values: DataFrame, shared_by: int = 3, rare: int = 3) -> DataFrame:
    """(kind, value) as ``statistics`` finds them, over all items wherever they are."""
    seen = values.groupBy("kind", "value").agg(F.count_distinct("item").alias("n"))
    return seen.where((F.col("kind") == "s") & (F.col("n") >= shared_by) | (F.col("kind") == "w") & (F.col("n") > rare)).select("kind", "value")


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, block: int = 20_000) -> DataFrame:
    """(key, item key) of every document and item leaked in it.

    The items are taken in blocks of about ``block`` rows, each broadcast behind a size check with those shared
    sentences and common words that occur in it, and all documents are scanned against each block. Null and empty texts on either side match nothing;
    repeated documents are reported each; no items give no rows.
    """
    spark = docs.sparkSession
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"`{key}` {key_type}, `{item_key}` {item_type}")
    rows = items.select(item_key, item_text).where(F.col(item_text).isNotNull())
    blocks = max(1, -(-rows.count() // block))
    values = _values(rows, item_key, item_text)
    often = _shared(values) if blocks == 1 else stored(_shared(values), "shared")
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == b)
        mine = often if blocks == 1 else often.join(_values(part, item_key, item_text).select("kind", "value").distinct(), ["kind", "value"])
        found = mine.collect()
        shared = bounded(spark, ([tuple(r) for r in part.collect()], {r["value"] for r in found if r["kind"] == "s"}, {r["value"] for r in found if r["kind"] == "w"}))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = LeakIndex(*shared.value)
            for pdf in frames:
                hits = [(k, item) for k, t in zip(pdf[key], pdf[text]) if t for item in index.search(t)] if index.sentences else []
                yield pd.DataFrame(hits, columns=[key, item_key])

        out = out.unionByName(docs.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, out.schema))
    return out
