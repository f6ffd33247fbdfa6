"""Languages of records and of the stretches in them, by word-first backoff.

A known word gives the log of its relative frequency in each language. An unknown one falls back to
the longest character n-grams that are known, then to shorter ones, with less weight. Sentences are
scored one by one, so a text in several languages yields each of them with its own confidence. The
tables are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``), twice: the second time each
sentence counts for the language that the first fit gave it, which removes wrong labels and mixtures.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gatewarden.llm.broadcasts import bounded
from gatewarden.llm.records import bounded_sample
from gatewarden.llm.sentences import boundaries

SAMPLE_ROWS = 4000
#: Words remembered by a worker before it starts afresh.
MAX_ROWS = 200_000
LEAST_CHARS = 20

#: Code, three-letter code and English name of the languages, those of the data first.
LANGUAGES = """en eng english; es spa spanish; fr fra french; de deu german; pt por portuguese; ru rus russian; zh zho chinese;
ja jpn japanese; ar ara arabic; hi hin hindi; th tha thai; it ita italian; nl nld dutch; pl pol polish; tr tur turkish; ko kor korean;
uk ukr ukrainian; sv swe swedish; no nor norwegian; da dan danish; fi fin finnish; el ell greek; ro ron romanian; hu hun hungarian;
he heb hebrew; fa fas persian; vi vie vietnamese; id ind indonesian; ms msa malay; cs ces czech"""
#: Other codes and names in use.
ALIASES = "fre=fr ger=de chi=zh jp=ja español=es espanol=es castellano=es français=fr francais=fr deutsch=de português=pt portugues=pt русский=ru 中文=zh 汉语=zh 日本語=ja العربية=ar हिन्दी=hi हिंदी=hi ไทย=th mandarin=zh farsi=fa"

NAMES = {n: e.split()[0] for e in LANGUAGES.replace("\n", " ").split(";") for n in e.split()} | dict(a.split("=") for a in ALIASES.split())

#: Letters of the other scripts under the language most written in them, and letters that make a word.
SCRIPTS = {"ru": ("Ѐ-ӿ", 5.0), "ar": ("ء-يٮ-ۓ", 4.5), "hi": ("ऄ-हक़-ॡ", 3.5), "th": ("ก-ฮ", 4.0), "ja": ("぀-ヿ", 1.5), "zh": ("㐀-鿿", 1.5), "ko": ("가-힣", 2.0), "el": ("Ͱ-Ͽἀ-῿", 5.0), "he": ("א-ת", 4.0)}
#: Further languages of a script, the letters that it lends to them alone, and letters that they lack.
VARIANTS = {"ru": [("uk", "іїєґ", "ыэъё")], "ar": [("fa", "پچژگکی", "ةىي")]}

_LATIN = re.compile("[a-zß-öø-ÿœ]+")
_OTHER = re.compile("[Ͱ-￿]")
_SCRIPTS = {c: (re.compile(f"[{r}]"), w) for c, (r, w) in SCRIPTS.items()}
_VARIANTS = {c: [(v, re.compile(f"[{own}]"), re.compile(f"[{lacks}]")) for v, own, lacks in vs] for c, vs in VARIANTS.items()}
OTHERS = {*SCRIPTS, *(v for vs in VARIANTS.values() for v, _, _ in vs)}
_MIXED = re.compile("[a-z][Ѐ-ӿ]|[Ѐ-ӿ][a-z]")
_SPEAKER = re.compile(r"^\s*(?:User|Assistant|System|Human|Bot|Agent)\s*[:：]\s*")
_LIST = re.compile(r"^[^,:：]{2,28}\s?[:：]\s*(?:[^\s,、،;]+(?:\s[^\s,、،;]+)?\s?[,、،;]\s*){2,}[^,、،;]{1,40}$")
_ADDRESS = re.compile(r"\S+@\S+|https?://\S+|\b\w+[./_-]\w[\w./_-]*")


LETTERS = {c: w for c, (_, w) in SCRIPTS.items()} | {v: SCRIPTS[c][1] for c, vs in VARIANTS.items() for v, _, _ in vs}


def label_code(label: str | None) -> str | None:
    """Two-letter code that a label stands for, whatever its spelling; None if it names no language."""
    if not label:
        return None
    key = label.strip().lower().replace("_", "-")
    return NAMES.get(key) or NAMES.get(re.split(r"[-\s(/,]", key)[0])


class LanguageModel:
    """Tables of word and n-gram log frequencies of the languages in Latin script; other scripts by their letters."""

    def __init__(self, min_word: int = 3, min_gram: int = 8, grams: tuple[int, ...] = (5, 4, 3)):
        self.min_word, self.min_gram, self.grams = min_word, min_gram, grams
        self.latin: list[str] = []
        self.words: dict[str, tuple[float, ...]] = {}
        self.ngrams: dict[str, tuple[float, ...]] = {}
        self.rows: _Rows | None = None

    def fit(self, labelled: Iterable[tuple[str, str]], rounds: int = 2) -> LanguageModel:
        """``labelled``: (text, code). Texts in which another script prevails are left out."""
        parts: list[tuple[str, list[str]]] = []
        for text, code in labelled:
            for s in split(text):
                words, script, _ = tokens(s)
                if words and not script:
                    parts.append((code, words))
        self.latin = sorted({c for c, _ in parts} - OTHERS) or ["en"]
        index = {c: i for i, c in enumerate(self.latin)}
        for turn in range(rounds):
            words: dict[str, Counter] = defaultdict(Counter)
            if turn:
                best, margin, _ = self._scores([ws for _, ws in parts])
                parts = [(self.latin[b], ws) for b, m, (_, ws) in zip(best, margin, parts) if m >= 3]
            for code, ws in parts:
                if code in index:
                    words[code].update(ws)
            self._tables(words)
        return self

    def _tables(self, words: dict[str, Counter]) -> None:
        self.rows = None
        self.words = self._logs({c: words.get(c, Counter()) for c in self.latin}, self.min_word)
        grams: dict[str, Counter] = {c: Counter() for c in self.latin}
        for c in self.latin:
            for w, n in words.get(c, Counter()).items():
                for g in self._grams(w):
                    grams[c][g] += n
        self.ngrams = self._logs(grams, self.min_gram)

    def _grams(self, word: str) -> Iterator[str]:
        padded = f"^{word}$"
        for n in self.grams:
            for i in range(len(padded) - n + 1):
                yield padded[i : i + n]

    def _logs(self, counts: dict[str, Counter], least: int) -> dict[str, tuple[float, ...]]:
        """Log frequency less its mean over the languages, bounded, of entries seen ``least`` times."""
        total = Counter()
        for c in counts.values():
            total.update(c)
        sums = {c: sum(counts[c].values()) + 1 for c in self.latin}
        out = {}
        for w, n in total.items():
            if n < least:
                continue
            share = [(counts[c][w] + 0.05) / sums[c] for c in self.latin]
            top = max(share)
            logs = [max(-6.0, math.log(s / top)) for s in share]
            if max(logs) - min(logs) > 0.7:
                out[w] = tuple(logs)
            else:
                out[w] = (0.0,) * len(logs)
        return out

    def word(self, w: str) -> tuple[float, ...] | None:
        """Scores of an unknown word from the longest n-grams known, or None."""
        padded = f"^{w}$"
        for n in self.grams:
            found = [g for g in (self.ngrams.get(padded[i : i + n]) for i in range(len(padded) - n + 1)) if g]
            if found and len(found) * 2 >= len(padded) - n + 1:
                return tuple(0.3 * sum(x) / len(found) for x in zip(*found))
        return None

    def _scores(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, margin over the next, known telling words) of many sentences of words."""
        if self.rows is None or len(self.rows) > MAX_ROWS:
            self.rows = _Rows(self)
        row = self.rows.__getitem__
        ids = np.fromiter((row(w) for ws in sentences for w in ws), dtype=np.int64)
        sizes = np.array([len(ws) for ws in sentences])
        table, telling = self.rows.table(), self.rows.telling()
        ends = np.cumsum(sizes)
        running = np.zeros((len(ids) + 1, len(self.latin) + 1))
        np.cumsum(np.column_stack([table[ids], telling[ids]]), axis=0, out=running[1:])
        sums = running[ends] - running[ends - sizes]
        scores, known = sums[:, :-1], np.rint(sums[:, -1]).astype(int)
        best = scores.argmax(1)
        if len(self.latin) > 1:
            part = np.partition(scores, -2, axis=1)
            margin = part[:, -1] - part[:, -2]
        else:
            margin = np.full(len(sizes), 9.0)
        return best, margin, known

    def sentences(self, texts: list[str]) -> list[tuple[str | None, float, int]]:
        """(language or None, confidence, size in words) of each sentence."""
        parts = [tokens(t) for t in texts]
        if not parts:
            return []
        best, margin, known = self._scores([p[0] for p in parts])
        conf = 1 / (1 + np.exp(-margin / 2))
        out = []
        for (words, script, size), b, c, k in zip(parts, best.tolist(), conf.tolist(), known.tolist()):
            share = 0.0
            if script:
                letters = size * LETTERS[script]
                share = letters / (letters + sum(map(len, words)))
            if script and (size > k or share > 0.5):
                out.append((script, max(share, min(1.0, 0.5 + size / 12)), max(1, round(size))))
            elif k < 2:
                out.append((None, 0.0, len(words)))
            else:
                out.append((self.latin[b], c, k))
        return out

    def _cut(self, texts: list[str]) -> tuple[list[list[tuple[int, int]]], Iterator]:
        spans = [list(boundaries(t)) for t in texts]
        return spans, iter(self.sentences([t[a:b] for t, bs in zip(texts, spans) for a, b in bs]))

    def segments(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, confidence) of each text: neighbouring sentences of a language joined."""
        spans, scored = self._cut(texts)
        result = []
        for bs in spans:
            out: list[tuple[int, int, str, float]] = []
            for a, b in bs:
                code, conf, _ = next(scored)
                if code is None:
                    continue
                if out and out[-1][2] == code:
                    out[-1] = (out[-1][0], b, code, max(out[-1][3], conf))
                else:
                    out.append((a, b, code, conf))
            result.append(out)
        return result

    def detect(self, texts: list[str], sure: float = 0.9, least_words: int = 3) -> list[tuple[str | None, float, list[str]]]:
        """(language of most words, its share of them as confidence, languages of at least one sure sentence) of each text.

        A sentence in the script of one language is sure by its share of the letters, however short; one in
        Latin script needs ``least_words`` telling words.
        """
        spans, scored = self._cut(texts)
        result = []
        for text, bs in zip(texts, spans):
            sizes: dict[str, float] = {}
            firm: dict[str, None] = {}
            for _ in bs:
                code, conf, size = next(scored)
                if code:
                    sizes[code] = sizes.get(code, 0.0) + size * conf
                    if conf >= sure and (size >= least_words or code in OTHERS):
                        firm[code] = None
            if sizes:
                code = max(sizes, key=sizes.get)
                result.append((code, sizes[code] / sum(sizes.values()), list(firm)))
            else:
                words, script, _ = tokens(text)
                code = script or (self.latin[self._scores([words])[0][0]] if words else None)
                result.append((code, 0.5 if code else 0.0, []))
        return result


class _Rows(dict):
    """Row of each word in one table of scores; unknown words get theirs from n-grams when first met."""

    def __init__(self, model: LanguageModel):
        super().__init__({w: i for i, w in enumerate(model.words)})
        self.model = model
        self.scores: list[tuple[float, ...]] = list(model.words.values())
        self.known = len(self.scores)
        self.built = np.zeros((0, len(model.latin)))

    def __missing__(self, w: str) -> int:
        self[w] = at = len(self.scores)
        self.scores.append(self.model.word(w) or (0.0,) * len(self.model.latin))
        return at

    def table(self) -> np.ndarray:
        if len(self.built) < len(self.scores):
            fresh = np.array(self.scores[len(self.built) :], dtype=float).reshape(-1, len(self.model.latin))
            self.built = np.concatenate([self.built, fresh])
        return self.built

    def telling(self) -> np.ndarray:
        """Words that speak against some language; of an unknown one, by its n-grams."""
        return self.table().min(1, initial=0.0) < -1


def split(text: str) -> list[str]:
    return [text[a:b] for a, b in boundaries(text)]


def tokens(sentence: str) -> tuple[list[str], str | None, float]:
    """(words in Latin script, language of another script if any, words of that script).

    Speaker marks, keyword lists, addresses, links, file names and words of letters of two scripts give nothing.
    """
    s = _SPEAKER.sub("", sentence) if ":" in sentence[:12] or "：" in sentence[:12] else sentence
    if (":" in s or "：" in s) and _LIST.match(s):
        return [], None, 0.0
    if "@" in s or "/" in s or "." in s[:-1]:
        s = _ADDRESS.sub(" ", s)
    s = s.lower()
    if s.isascii():
        return _LATIN.findall(s), None, 0.0
    if not unicodedata.is_normalized("NFC", s):
        s = unicodedata.normalize("NFC", s)
    if "’" in s:
        s = s.replace("’", " ")
    script, size = None, 0.0
    if _OTHER.search(s):
        if _MIXED.search(s):
            s = " ".join(w for w in s.split() if not _MIXED.search(w))
        counts = {c: len(r.findall(s)) / w for c, (r, w) in _SCRIPTS.items()}
        kana, han = counts["ja"], counts.pop("zh")
        if kana > 0.15 * han:
            counts["ja"] = kana + han
        else:
            counts["zh"], counts["ja"] = han + kana, 0
        script, size = max(counts.items(), key=lambda x: x[1])
        if size < 1:
            script = None
        for variant, own, lacks in _VARIANTS.get(script, ()):
            if len(own.findall(s)) > 2 * len(lacks.findall(s)):
                script = variant
    return _LATIN.findall(s), script, size


def fit_on(rows: DataFrame, limit: int = SAMPLE_ROWS, about: int | None = None) -> LanguageModel:
    """Model fitted on at most ``limit`` labelled records (origin, record_id, text, label)."""
    sample = bounded_sample(rows.where("label is not null and length(text) between 20 and 3000").select("text", "label"), limit, "text", about=about)
    return LanguageModel().fit((r["text"], c) for r in sample if (c := label_code(r["label"])))


def _mapped(rows: DataFrame, model: LanguageModel, columns: str, of_texts, of_record) -> DataFrame:
    shared = bounded(rows.sparkSession, (model.latin, model.words, model.ngrams))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LanguageModel()
        m.latin, m.words, m.ngrams = shared.value
        names = [c.split()[0] for c in columns.split(", ")]
        for pdf in frames:
            texts = list(dict.fromkeys(pdf["text"]))
            got = dict(zip(texts, of_texts(m, texts)))
            out = []
            for o, r, t, label in zip(pdf["origin"], pdf["record_id"], pdf["text"], pdf["label"]):
                out.extend((o, r, *x) for x in of_record(t, label, got[t]))
            yield pd.DataFrame(out, columns=names)

    return rows.select("origin", "record_id", "text", "label").mapInPandas(run, columns)


def _case(text: str, label: str | None, got: tuple) -> list[tuple[str]]:
    if len(text.strip()) < LEAST_CHARS:
        return []
    code, _, firm = got
    if len(firm) > 1:
        return [(c,) for c in firm]
    return [] if code is None or label_code(label) == code else [(code,)]


def find_cases(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(origin, record_id, lang) of records with a missing or wrong label, or with several languages.

    Blank texts and texts of under 20 characters give no case; a message delivered several times is one
    record. An empty table gives no rows.
    """
    return _mapped(rows, model, "origin string, record_id string, lang string", LanguageModel.detect, _case).distinct()


def segment_table(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(origin, record_id, start_pos, end_pos, lang, confidence) of every stretch in one language."""
    columns = "origin string, record_id string, start_pos int, end_pos int, lang string, confidence double"
    return _mapped(rows, model, columns, LanguageModel.segments, lambda text, label, got: [(a, b, c, round(p, 4)) for a, b, c, p in got]).distinct()


def record_table(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(origin, record_id, lang, confidence, n_languages) of every record; null language where no word tells."""
    columns = "origin string, record_id string, lang string, confidence double, n_languages int"
    return _mapped(rows, model, columns, LanguageModel.detect, lambda text, label, got: [(got[0], round(got[1], 4), max(1, len(got[2])))]).distinct()
