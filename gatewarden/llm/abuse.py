"""Scores for abusive, hateful or sexual text: a bidirectional gated recurrent network with attention.

A text becomes words (pairs of characters in scripts without spaces) after the usual disguises are
undone. A word's input is its own vector plus the mean of the vectors of its character n-grams, so
unseen and misspelled words have one too. A gated recurrent network runs over the text in both
directions, once; attention pools its states within every window of 12 words, one at each start, and
the text's score is that of its worst window. Everything is numpy: training by back-propagation with
Adam on the driver, over a bounded number of stretches, and scoring in batches of like length.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.functions.text import clean_id
from gatewarden.llm import abuse_examples as ex
from gatewarden.llm.broadcasts import bounded
from gatewarden.llm.records import bounded_sample

#: Words of a window, of a stretch that the network runs over at once, and around a window in it.
WINDOW, SEGMENT, HALO = 12, 60, 8
DIM, HIDDEN = 20, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 15
SAMPLE_ROWS, FLAGGED_ROWS, NEGATIVES = 12000, 1500, 14000
THRESHOLD = 0.5
MAX_ROWS = 120_000
#: Words scored at a time.
MAX_WORDS = 200_000

_HIDDEN = re.compile("[​-‏⁠﻿­️]")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_SOLID = "฀-๿぀-ヿ㐀-鿿"
_GAP = re.compile(rf"(?<=[{_SOLID}])[ .*_-](?=[{_SOLID}])")
_ONE_SOLID = re.compile(f"[{_SOLID}]")
_TOKEN = re.compile(rf"[{_SOLID}]|[^\W_{_SOLID}][^\s{_SOLID}]*")
_JOINED = re.compile(r"^[^\W\d_](?:([-_.*])[^\W\d_])(?:\1[^\W\d_])+$")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = ".,;:!?\"'()[]{}«»“”„‘’。，！？、…-—–/\\|<>`~"
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[a-z]")
_UNLOOK = {ord(v): k for k, v in ex.LOOKALIKE.items()} | {ord("к"): "k", ord("м"): "m", ord("т"): "t", ord("в"): "b", ord("н"): "h"}


def undisguise(word: str) -> str:
    """A token in its plain form: letters joined, look-alikes and digits as letters, long repeats cut."""
    w = word.strip(_EDGE)
    if not w:
        return ""
    if w.isalpha():
        if not w.isascii() and _CYRILLIC.search(w) and _LATIN.search(w):
            w = w.translate(_UNLOOK)
    else:
        if w.isdigit():
            return "0"
        if _JOINED.match(w):
            w = re.sub(r"[-_.*]", "", w)
        letters = sum(c.isalpha() for c in w)
        digits = sum(c.isdigit() for c in w)
        if letters and (digits or "@" in w or "$" in w or "!" in w):
            if letters * 2 >= digits and "." not in w and len(w) > 2:
                w = w.translate(_LEET)
            else:
                return "0"
        elif not letters:
            return "0" if digits else ""
        w = w.replace("'", "").replace("’", "")
    return _REPEAT.sub(r"\1", w)


def raw_tokens(text: str) -> list[str]:
    """Tokens of a text, still disguised; of scripts without spaces each character with the next."""
    if text.isascii():
        t = text.lower()
    else:
        t = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower()
        if not t.isascii():
            t = _GAP.sub("", t)
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: m.group().replace(" ", ""), t)
    if t.isascii():
        return t.split()
    tokens = _TOKEN.findall(t)
    if _ONE_SOLID.search(t):
        solid = [len(k) == 1 and k >= "\u0e00" for k in tokens]
        tokens = [k + tokens[i + 1] if here and after else k for i, (k, here, after) in enumerate(zip(tokens, solid, [*solid[1:], False]))]
    return tokens


def plain_word(token: str) -> str:
    w = undisguise(token)
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not "̀" <= c <= "ͯ")


def words(text: str, memo: dict[str, str]) -> list[str]:
    """Plain words of a text; ``memo`` remembers the plain form of tokens."""
    if len(memo) > MAX_ROWS:
        memo.clear()
    out = []
    for k in raw_tokens(text):
        w = memo.get(k)
        if w is None:
            w = memo[k] = plain_word(k)
        if w:
            out.append(w)
    return out


@lru_cache(maxsize=200_000)
def grams(word: str) -> list[int]:
    """Buckets of all character 2- to 4-grams of the word, 1-based."""
    p = f"^{word}$"
    return [zlib.crc32(p[i : i + n].encode()) % GRAM_BUCKETS + 1 for n in (3, 4, 2) for i in range(len(p) - n + 1)]


def segments(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping stretches of a text of n words that the network runs over.

    Every window of ``WINDOW`` words lies within one with at least ``HALO`` words (or the text's end) on
    either side, so that the states of a window know what stands around it.
    """
    if n <= SEGMENT:
        return [(0, n)]
    step = SEGMENT - 2 * HALO - WINDOW + 1
    return [(max(0, s - HALO), min(n, s - HALO + SEGMENT)) for s in range(0, n - WINDOW + 1, step)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of ``values`` by index 0..n-1, each of which occurs."""
    order = np.argsort(index, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(index, minlength=n))[:-1]])
    return np.add.reduceat(values[order], starts, axis=0)


def _sliding(x: np.ndarray) -> np.ndarray:
    """Sums of x (T, B) over all windows of ``WINDOW`` rows, or of all rows if there are fewer."""
    c = np.cumsum(x, axis=0)
    if len(x) <= WINDOW:
        return c[-1:]
    out = c[WINDOW - 1 :].copy()
    out[1:] -= c[:-WINDOW]
    return out


def _spread(x: np.ndarray, steps: int) -> np.ndarray:
    """For each of ``steps`` rows the sum of x (S, B) over the windows that hold the row."""
    c = np.zeros((steps + 1, x.shape[1]), dtype=x.dtype)
    c[: len(x)] += x
    width = min(WINDOW, steps)
    c[width : width + len(x)] -= x
    return np.cumsum(c, axis=0)[:steps]


class AbuseNet:
    """Parameters and passes of the network."""

    SHAPES = {
        "word": (WORD_BUCKETS + 1, DIM), "gram": (GRAM_BUCKETS + 1, DIM),
        "wf": (DIM, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "bf": (3 * HIDDEN,), "wb": (DIM, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "bb": (3 * HIDDEN,),
        "att": (2 * HIDDEN, HIDDEN), "av": (HIDDEN,), "out": (2 * HIDDEN,), "bias": (1,),
    }

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 5):
        if params is None:
            r = np.random.default_rng(seed)
            params = {k: (r.standard_normal(s) * (0.02 if k in ("word", "gram") else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in self.SHAPES.items()}
            params["word"][0] = params["gram"][0] = 0
            for k in ("bf", "bb", "bias"):
                params[k][:] = 0
        self.p = params

    # ---- inputs ----

    def bucket(self, word: str) -> int:
        return zlib.crc32(word.encode()) % WORD_BUCKETS + 1

    def vectors(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word buckets, gram buckets of all words in a row, number of grams of each) of words; index 0 is padding."""
        b = np.array([0] + [self.bucket(w) for w in vocabulary])
        lists = [[0], *map(grams, vocabulary)]
        return b, np.fromiter((x for g in lists for x in g), dtype=np.int64), np.array([len(g) for g in lists])

    def embed(self, b: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.p["gram"][g], np.cumsum(n) - n, axis=0)
        return self.p["word"][b] + sums / n[:, None].astype(np.float32)

    # ---- passes ----

    def _run(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, order, keep: list | None):
        """States of one direction over projected inputs x (T, B, 3H); padding leaves the state as it is."""
        steps, size, _ = x.shape
        h = np.zeros((size, HIDDEN), dtype=np.float32)
        states = np.empty((steps, size, HIDDEN), dtype=np.float32)
        uz, uc = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
        for t in order:
            g = _sigmoid(x[t, :, : 2 * HIDDEN] + h @ uz)
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            rh = r * h
            c = np.tanh(x[t, :, 2 * HIDDEN :] + rh @ uc)
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, rh, c, m))
            h = new
            states[t] = h
        return states

    def logits(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Logit of every window (S, B), one at every start, from projected inputs (T, B, 3H) and mask (T, B).

        The states are computed once; attention pools them within each window. Windows that begin so
        that they reach into the padding of a longer text get -30.
        """
        steps = range(len(xf))
        kf, kb = ([], []) if cache is not None else (None, None)
        hs = np.concatenate([self._run(xf, mask, self.p["uf"], steps, kf), self._run(xb, mask, self.p["ub"], reversed(steps), kb)], axis=2)
        a = np.tanh(hs @ self.p["att"])
        e = a @ self.p["av"]
        w = np.exp(np.clip(e, -4, 4)) * mask
        v = hs @ self.p["out"]
        total, weighted = _sliding(w) + 1e-6, _sliding(w * v)
        raw = weighted / total
        sizes = mask.sum(0)
        valid = np.arange(len(raw))[:, None] <= np.maximum(0, sizes - WINDOW)[None, :]
        if cache is not None:
            cache.update(hs=hs, a=a, e=e, w=w, v=v, total=total, raw=raw, kf=kf, kb=kb, mask=mask)
        return np.where(valid, raw + self.p["bias"], np.float32(-30))

    def _back(self, dh_all: np.ndarray, keep: list, u: np.ndarray, shape) -> tuple[np.ndarray, np.ndarray]:
        du, dx = np.zeros_like(u), np.zeros(shape, dtype=np.float32)
        uz, uc = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
        dh = np.zeros_like(dh_all[0])
        for t, h, z, r, rh, c, m in reversed(keep):
            dh = dh + dh_all[t]
            dn = dh * m
            dz, dc = dn * (c - h) * z * (1 - z), dn * z * (1 - c * c)
            drh = dc @ uc.T
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dz, dr], axis=1)
            dx[t, :, : 2 * HIDDEN], dx[t, :, 2 * HIDDEN :] = dg, dc
            du[:, : 2 * HIDDEN] += h.T @ dg
            du[:, 2 * HIDDEN :] += rh.T @ dc
            dh = dh - dn * z + drh * r + dg @ uz.T
        return dx, du

    def fit(self, texts: list[list[str]], labels: np.ndarray, cores: list[tuple[int, int]] | None = None, epochs: int = 3, batch: int = 192, rate: float = 4e-3, seed: int = 3) -> AbuseNet:
        """Train on stretches of at most ``SEGMENT`` words with labels 0 or 1 (cross-entropy, Adam).

        ``cores`` are the words (start, end) that make a stretch abusive: the windows that hold the core, or
        lie within it, are pulled up. Of an ordinary stretch all windows are pulled down, the highest the most.
        """
        cores = cores or [(0, len(t)) for t in texts]
        vocabulary = sorted({w for t in texts for w in t})
        at = {w: i for i, w in enumerate(vocabulary, 1)}
        b, g, n = self.vectors(vocabulary)
        begin = np.cumsum(n) - n
        sizes = np.array([min(len(t), SEGMENT) for t in texts])
        rows = [[at[w] for w in t[:SEGMENT]] for t in texts]
        r = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, total = 0, epochs * max(1, len(texts) // batch)
        for _ in range(epochs):
            order = np.argsort(sizes + r.random(len(sizes)) * 6, kind="stable")  # stretches of like length together
            chunks = np.array_split(order, max(1, len(texts) // batch))
            for k in r.permutation(len(chunks)):
                chunk = chunks[k]
                x = np.zeros((len(chunk), int(sizes[chunk].max())), dtype=np.int64)
                for i, j in enumerate(chunk):
                    x[i, : sizes[j]] = rows[j]
                mask = (x.T > 0).astype(np.float32)
                x = np.where(r.random(x.shape) < 0.04, 0, x)  # words left out, so that no single one decides
                used, where = np.unique(x, return_inverse=True)
                where = where.reshape(x.shape)
                size = n[used]
                mine = g[np.repeat(begin[used] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                e = self.embed(b[used], mine, size)
                xin = e[where.T]
                cache: dict = {}
                logits = self.logits(xin @ self.p["wf"] + self.p["bf"], xin @ self.p["wb"] + self.p["bb"], mask, cache)
                grads = self._gradients(cache, self._pull(logits, labels[chunk], [cores[j] for j in chunk], sizes[chunk]), xin)
                de = np.zeros_like(e)
                de += _sums(where.T.ravel(), grads.pop("xin").reshape(-1, DIM), len(e))
                de[used == 0] = 0
                step += 1
                lr = rate * (1 - 0.8 * step / total)
                rw, at_w = np.unique(b[used], return_inverse=True)
                gw = _sums(at_w.ravel(), de, len(rw))
                rg, at_g = np.unique(mine, return_inverse=True)
                gg = _sums(at_g.ravel(), np.repeat(de / size[:, None].astype(np.float32), size, axis=0), len(rg))
                gw[rw == 0], gg[rg == 0] = 0, 0
                for k2, d, rs in [*((k2, d, slice(None)) for k2, d in grads.items()), ("word", gw, rw), ("gram", gg, rg)]:
                    m, v = moments[k2]
                    m[rs] += 0.1 * (d - m[rs])
                    v[rs] += 0.001 * (d * d - v[rs])
                    self.p[k2][rs] -= (lr * (m[rs] / (1 - 0.9**step)) / (np.sqrt(v[rs] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self

    @staticmethod
    def _pull(logits: np.ndarray, labels: np.ndarray, cores: list[tuple[int, int]], sizes: np.ndarray) -> np.ndarray:
        """Gradient of the loss by each window's logit."""
        starts = np.arange(len(logits))[:, None]
        a, b = (np.array([c[i] for c in cores])[None, :] for i in (0, 1))
        held = np.minimum(b, starts + WINDOW) - np.maximum(a, starts)
        valid = logits > -29
        share = np.where((labels[None, :] > 0) & (held >= np.minimum(b - a, WINDOW)) & valid, 1.0, 0.0)
        share += (labels[None, :] == 0) * valid * 0.5
        share /= np.maximum(share.sum(0), 1e-6)
        top = np.zeros_like(share)
        top[logits.argmax(0), np.arange(logits.shape[1])] = 1
        share = np.where(labels[None, :] > 0, share, 0.4 * share + 0.6 * top)
        return ((_sigmoid(logits) - labels[None, :]) * share * np.where(labels > 0, 1.5, 1.0)[None, :] / len(sizes)).astype(np.float32)

    def _gradients(self, c: dict, dlogit: np.ndarray, xin: np.ndarray) -> dict[str, np.ndarray]:
        hs, a, w, v = c["hs"], c["a"], c["w"], c["v"]
        steps = len(hs)
        dn = dlogit / c["total"]
        from_sums = _spread(dn, steps)
        dv = from_sums * w
        dw = from_sums * v - _spread(dn * c["raw"], steps)
        de = dw * w * (np.abs(c["e"]) < 4)
        out = {"out": np.einsum("tbh,tb->h", hs, dv), "bias": np.array([dlogit.sum()], dtype=np.float32), "av": np.einsum("tbh,tb->h", a, de)}
        da = de[:, :, None] * self.p["av"] * (1 - a * a)
        out["att"] = np.tensordot(hs, da, ((0, 1), (0, 1)))
        dhs = dv[:, :, None] * self.p["out"] + da @ self.p["att"].T
        dxf, out["uf"] = self._back(dhs[:, :, :HIDDEN], c["kf"], self.p["uf"], (*xin.shape[:2], 3 * HIDDEN))
        dxb, out["ub"] = self._back(dhs[:, :, HIDDEN:], c["kb"], self.p["ub"], (*xin.shape[:2], 3 * HIDDEN))
        out["wf"], out["wb"] = np.tensordot(xin, dxf, ((0, 1), (0, 1))), np.tensordot(xin, dxb, ((0, 1), (0, 1)))
        out["bf"], out["bb"] = dxf.sum((0, 1)), dxb.sum((0, 1))
        out["xin"] = dxf @ self.p["wf"].T + dxb @ self.p["wb"].T
        return out


class Scorer:
    """A network with the projected inputs of the tokens met so far."""

    def __init__(self, net: AbuseNet):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}  # row of the table of each plain word
        self.of_token: dict[str, int] = {}  # the same of each token as written; 0 if nothing is left of it
        p = self.net.p
        self.table = np.concatenate([p["bf"], p["bb"]])[None, :].astype(np.float32)
        self.held = 1

    def _learn(self) -> None:
        """Project the words that have a row number but no row yet."""
        fresh = list(self.rows)[self.held - 1 :]
        if not fresh:
            return
        b, g, n = self.net.vectors(fresh)
        e = self.net.embed(b, g, n)[1:]
        p = self.net.p
        rows = np.concatenate([e @ p["wf"] + p["bf"], e @ p["wb"] + p["bb"]], axis=1)
        if self.held + len(rows) > len(self.table):
            self.table = np.concatenate([self.table[: self.held], np.empty((self.held + 2 * len(rows), self.table.shape[1]), dtype=np.float32)])
        self.table[self.held : self.held + len(rows)] = rows
        self.held += len(rows)

    def _row(self, word: str) -> int:
        return self.rows.setdefault(word, len(self.rows) + 1) if word else 0

    def _ids(self, text: str) -> np.ndarray:
        tokens = raw_tokens(text)
        got = list(map(self.of_token.get, tokens))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.of_token[tokens[i]] = self._row(plain_word(tokens[i]))
        ids = np.array(got, dtype=np.int32)
        return ids[ids > 0] if 0 in got else ids

    def score(self, texts: list[str]) -> np.ndarray:
        """Score of each text: that of its worst window; 0 for a text without words."""
        return self._score(texts, self._ids)

    def score_words(self, cut: list[list[str]]) -> np.ndarray:
        """The same of texts that are cut into plain words."""
        return self._score(cut, lambda ws: np.array([self._row(w) for w in ws], dtype=np.int32))

    def _score(self, texts: list, ids_of, chunk: int = 512) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.float64)
        parts: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            if len(self.of_token) + len(self.rows) > 3 * MAX_ROWS:
                self._flush(parts, out, chunk)
                parts, held = [], 0
                self._reset()
            ids = ids_of(text)
            for a, b in segments(len(ids)) if len(ids) else ():
                parts.append((i, ids[a:b]))
                held += b - a
                if held >= MAX_WORDS:
                    self._flush(parts, out, chunk)
                    parts, held = [], 0
        self._flush(parts, out, chunk)
        return out

    def _flush(self, parts: list[tuple[int, np.ndarray]], out: np.ndarray, chunk: int) -> None:
        self._learn()
        parts.sort(key=lambda x: len(x[1]))
        for k in range(0, len(parts), chunk):
            some = parts[k : k + chunk]
            ids = np.zeros((len(some), len(some[-1][1])), dtype=np.int32)
            for j, (_, row) in enumerate(some):
                ids[j, : len(row)] = row
            x = self.table[ids.T]
            top = self.net.logits(x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], (ids.T > 0).astype(np.float32)).max(0)
            np.maximum.at(out, [i for i, _ in some], _sigmoid(top))


_PIECE = re.compile(r"[.!?。！？।؟…]+[\s\"'”’»)）」』]*|[。！？]|\n+")


def pieces(text: str, memo: dict[str, str]) -> list[list[str]]:
    """Words of the rough sentences of a text, long ones in parts."""
    out = []
    for part in _PIECE.split(text):
        ws = words(part, memo) if part.strip() else []
        out += [ws[i : i + SEGMENT - 2 * HALO] for i in range(0, len(ws), SEGMENT - 2 * HALO)]
    return out


def _pairs(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(["^", *ws], [*ws, "$"]))


class Evidence:
    """How much more often word pairs occur in texts judged unsafe than in others."""

    def __init__(self, flagged: list[list[list[str]]], others: list[list[list[str]]]):
        self.share = max(1, len(flagged)) / max(1, len(others))
        self.bad, self.all = Counter(), Counter()
        for texts, into in ((flagged, self.bad), (others, self.all)):
            for cut in texts:
                into.update(set().union(*map(_pairs, cut)) if cut else ())

    def of(self, ws: list[str]) -> tuple[float, float, float]:
        """Mean log ratio of the pairs met three times or more, with a lower and an upper bound (one deviation
        of the count); 0 and no upper bound if there are none."""
        got = [(self.bad[p], self.all[p] * self.share + 0.5) for p in _pairs(ws) if self.bad[p] + self.all[p] >= 3]
        if len(got) < 2:
            return 0.0, 0.0, 9.0
        low = sum(math.log((f - math.sqrt(f) + 0.5) / e) for f, e in got) / len(got)
        mid = sum(math.log((f + 0.5) / e) for f, e in got) / len(got)
        high = sum(math.log((f + math.sqrt(f + 1) + 0.5) / e) for f, e in got) / len(got)
        return low, mid, high


def _examples(ordinary: list[list[list[str]]], seed: int) -> tuple[list, list, list]:
    """Stretches with a written sentence of either kind set among ordinary words."""
    r = random.Random(seed)
    memo: dict[str, str] = {}
    plain = [ws for cut in ordinary for ws in cut if ws]
    texts, labels, cores = [], [], []
    for lists, copies, label, disguise in ((ex.ABUSIVE, 8, 1, 0.4), (ex.BENIGN, 10, 0, 0.1), (ex.EVERYDAY, 8, 0, 0.05), (ex.OTHER, 6, 0, 0.05)):
        for s in ex.sentences(lists, seed, copies, disguise):
            core = words(s, memo)[: SEGMENT - 2 * HALO]
            left, right = (r.choice(plain) if plain and r.random() < 0.6 else [] for _ in range(2))
            left, right = left[-r.randint(1, HALO) :], right[: r.randint(1, HALO)]
            texts.append(left + core + right)
            labels.append(label)
            cores.append((len(left), len(left) + len(core)))
    return texts, labels, cores


def train(ordinary: list[str], flagged: list[str]) -> AbuseNet:
    """Network from written sentences and from the texts' own.

    ``ordinary`` and ``flagged`` are bounded samples of texts not judged unsafe and judged unsafe by a rough
    judge, who misses much and flags for other reasons too. A first net learns the written sentences
    among ordinary ones. Then, three times, every sentence of the samples is labelled anew by the net's score
    and by the evidence of the judge (how much more often its word pairs stand in flagged texts):
    abusive if both speak for it, ordinary if one clearly does not; the others are left out. The net goes
    on with these, the ordinary ones that look abusive first.
    """
    memo: dict[str, str] = {}
    cut = [pieces(t, memo) for t in ordinary]
    bad = [pieces(t, memo) for t in flagged]
    evidence = Evidence(bad, cut)
    seen = Counter(tuple(ws) for text in (*cut, *bad) for ws in text if ws)
    mine = [list(ws) for ws in seen]
    low, mid, high = np.array([evidence.of(ws) for ws in mine] or [(0.0, 0.0, 9.0)]).T
    r = random.Random(11)
    texts, labels, cores = _examples(cut, 9)
    joined = _stretches(cut, r)[:NEGATIVES]
    net = AbuseNet().fit(texts + joined, np.array(labels + [0] * len(joined), dtype=np.float32), cores + [(0, len(t)) for t in joined], epochs=3)
    for turn in range(3):
        scorer = Scorer(net)
        score = scorer.score_words(mine)
        odds = np.log((score + 1e-4) / (1.0001 - score)) + 1.5 * np.minimum(low, 2.5)
        abusive = ((odds >= 0.8) & (low >= 0.5)) | ((score >= 0.95) & (low >= 0.3))
        ordinary_now = ((odds < -1) & (low >= 0.5)) | ((score < 0.9) & (mid < 0.3)) | (high < 0.6)
        doubtful = {tuple(ws) for ws, p, q in zip(mine, abusive, ordinary_now) if p or not q}
        clean = [[ws for ws in text if tuple(ws) not in doubtful] for text in cut]
        more = [(ws, 1) for ws, k in zip(mine, abusive) if k] + [(ws, 0) for ws, n, k, s in zip(mine, seen.values(), ordinary_now, score) if k and s > 0.05 for _ in range(min(30, 3 + n // 2))]
        around = [ws for text in clean for ws in text if ws]
        extra, extra_labels, extra_cores = [], [], []
        for ws, label in more:
            left, right = (r.choice(around) if around and r.random() < 0.6 else [] for _ in range(2))
            left, right = left[-r.randint(1, HALO) :], right[: r.randint(1, HALO)]
            extra.append(left + ws + right)
            extra_labels.append(label)
            extra_cores.append((len(left), len(left) + len(ws)))
        joined = _stretches(clean, r)[: 2 * NEGATIVES]  # those that look abusive first: they teach the most
        looks = scorer.score_words(joined)
        hard = [joined[i] for i in np.argsort(-looks, kind="stable")[: NEGATIVES // 4] if looks[i] > 0.03]
        joined = hard + hard + joined[: NEGATIVES - 2 * len(hard)]
        net.fit(
            texts + extra + joined, np.array(labels + extra_labels + [0] * len(joined), dtype=np.float32),
            cores + extra_cores + [(0, len(t)) for t in joined], epochs=2, seed=5 + turn, rate=3e-3,
        )
    return net


def _stretches(cut: list[list[list[str]]], r: random.Random) -> list[list[str]]:
    """The words of the texts in stretches, some of them short, in random order."""
    out = []
    for text in cut:
        ws = [w for part in text for w in part]
        at = 0
        while at < len(ws):
            n = r.choice((SEGMENT, SEGMENT, 24, 8))
            out.append(ws[at : at + n])
            at += n
    r.shuffle(out)
    return out


def fit_on(rows: DataFrame, verdicts: DataFrame, about: int | None = None) -> AbuseNet:
    """Network trained on at most ``FLAGGED_ROWS`` requests whose verdict is unsafe and ``SAMPLE_ROWS`` other records.

    ``rows`` has (origin, record_id, text), ``verdicts`` (record_id, verdict) of the moderation stage. Records
    without a verdict count as not judged unsafe.
    """
    unsafe = verdicts.where(F.lower(F.trim("verdict")) == "unsafe").select("record_id").distinct()
    texts = rows.where("length(text) between 3 and 4000")
    ids = [r["record_id"] for r in bounded_sample(unsafe, FLAGGED_ROWS, "record_id")]
    is_bad = (F.col("origin") == "request") & F.col("record_id").isin(ids)
    flagged = sorted({(r["record_id"], r["text"]) for r in texts.where(is_bad).select("record_id", "text").dropDuplicates(["record_id", "text"]).collect()}) if ids else []
    known = {i for i, _ in flagged}
    ordinary = [r["text"] for r in bounded_sample(texts.select("origin", "record_id", "text"), SAMPLE_ROWS, "record_id", "text", about=about) if r["origin"] != "request" or r["record_id"] not in known]
    return train(ordinary, [t for _, t in flagged])


def verdicts_of(moderated: DataFrame) -> DataFrame:
    return moderated.select(clean_id(F.col("req_id")).alias("record_id"), F.col("moderation.verdict").alias("verdict")).where("record_id is not null and verdict is not null")


def score_table(rows: DataFrame, net: AbuseNet) -> DataFrame:
    """(origin, record_id, source, publisher_id, score) of every row of the records; one pass without a shuffle.

    Texts without a word score 0; repeated rows are scored once a batch and given each.
    """
    shared = bounded(rows.sparkSession, net.p)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(AbuseNet(shared.value))
        for pdf in frames:
            texts = list(dict.fromkeys(pdf["text"]))
            got = dict(zip(texts, scorer.score(texts).round(6)))
            yield pd.DataFrame({"origin": pdf["origin"], "record_id": pdf["record_id"], "source": pdf["source"], "publisher_id": pdf["publisher_id"], "score": pdf["text"].map(got)})

    return rows.select("origin", "record_id", "source", "publisher_id", "text").mapInPandas(run, "origin string, record_id string, source string, publisher_id string, score double")


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(scope, value, n, n_abusive, rate) per source and per publisher, each record counted once."""
    once = scores.groupBy("origin", "record_id").agg(F.max("score").alias("score"), F.max("source").alias("source"), F.max("publisher_id").alias("publisher_id"))
    parts = once.select(F.explode(F.array(F.struct(F.lit("source").alias("scope"), F.col("source").alias("value")), F.struct(F.lit("publisher").alias("scope"), F.col("publisher_id").alias("value")))).alias("s"), "score")
    g = parts.where("s.value is not null").groupBy("s.scope", "s.value").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("n_abusive"))
    return g.withColumn("rate", F.round(F.col("n_abusive") / F.col("n"), 6))
