"""Personal information in free text, by a semi-Markov conditional random field.

A text is cut into tokens (words, runs of digits, single marks, single characters of scripts without
spaces). Every segment of tokens up to a bounded length is scored for every type: by the words within,
at its edges and around it, and by features of the whole span (its length, the pattern of its pieces,
its digits, its first and last piece). A dynamic program over the segments with a positive score then
chooses the set without overlap of the highest total, so boundaries and types are decided together;
a segment of negative score is in no best set. All of it is arithmetic on whole arrays of tokens.

Weights are fitted by the gradient of the log likelihood, with sums over all segmentations, on texts
generated from written sentences and made-up values. Then the field labels a bounded sample of corpus
sentences: those on which it is sure, of personal information or of none, join the training texts.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gatewarden.llm import pii_lexicon as lex
from gatewarden.llm.broadcasts import bounded
from gatewarden.llm.records import bounded_sample

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
#: Tokens of the longest segment of each type.
LONGEST = (22, 18, 18, 26, 8)
SAMPLE_ROWS = 3000
BUCKETS = 1 << 15
MAX_TOKENS = 150_000

#: Full-width forms and dashes to their plain ones, character by character, so that places stay.
PLAIN = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF20: "@", 0xFF0E: ".", 0xFF0D: "-", 0x2212: "-", 0x2010: "-", 0x2011: "-", 0x2013: "-", 0xFF08: "(", 0xFF09: ")", 0xFF0B: "+", 0xA0: " ", 0x202F: " ", 0x2009: " ", 0x3000: " "}
PLAIN |= {0xFF21 + i: 0x41 + i for i in range(26)} | {0xFF41 + i: 0x61 + i for i in range(26)}
_WIDE = re.compile("[" + "".join(map(re.escape, map(chr, PLAIN))) + "]")
_HIDDEN = re.compile("[​-‍⁠﻿­]")
_SOLID = "฀-๿぀-ヿ㐀-鿿々"
_PIECE = re.compile(rf"\s+|[{_SOLID}]|[0-9]+|(?:[^\W\d_{_SOLID}]|[̀-ًͯ-ْऀ-ःऺ-ॏॢॣ])+|.", re.S)

_INNER, _BEGIN, _END, _LEFT1, _LEFT2, _LEFTS, _RIGHT1, _RIGHT2 = range(8)
_N = len(TYPES)
_NEVER = np.float32(-1e4)
_BAG = 4  # tokens of the left surroundings beyond the next two
_GAP = 6  # separators between texts


def _kind(piece: str) -> str:
    c = piece[0]
    if c.isdigit():
        return f"d{min(len(piece), 12)}"
    if not (c.isalpha() or "ऀ" <= c <= "ॿ"):
        return piece
    if c >= "฀" and not "가" <= c <= "힣":
        return "thai" if c < "຀" else "kana" if "぀" <= c <= "ヿ" else "han" if c >= "㐀" else "word"
    if "؀" <= c <= "ۿ":
        return "arab"
    if "ऀ" <= c <= "ॿ":
        return "deva"
    if len(piece) == 1:
        return "A" if piece.isupper() else "a"
    return "up" if piece.isupper() else "Cap" if c.isupper() else "low"


def _features(piece: str, low: str, kind: str, flags: tuple[str, ...]) -> list[str]:
    out = ["k=" + kind]
    if kind[0] == "d" and kind != "deva" and piece[0].isdigit():
        out += ["digits", f"z={piece[0] == '0'}", f"k={kind}&{piece[0]}"]
    elif piece[0].isalpha() or kind == "deva":
        out.append("w=" + low)
        if len(low) > 3:
            out += ["s=" + low[-3:], "p=" + low[:3]]
        if len(low) > 5:
            out.append("s=" + low[-5:])
        for n in flags:
            out += [f"in={n}", f"in={n}&{kind}"]
    return out


class Tokens:
    """Feature rows, pattern codes and counts of the distinct pieces met; row 0 stands between texts."""

    _GROUPS = ("at", "digit", "title", "street", "legal")

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[list[int]] = [[zlib.crc32(b"edge") % BUCKETS]]
        #: length, gap (0 for no white space), digits, at-sign, letter; pattern of the piece, hash of the piece
        self._numbers: list[tuple[int, ...]] = [(0, 0, 0, 0, 0, 1, 1)]
        self._built = np.zeros((0, 7), dtype=np.uint64)

    def learn(self, piece: str) -> int:
        self.at[piece] = got = len(self.rows)
        if piece.isspace():
            n = piece.count("\n") + piece.count("\r") - piece.count("\r\n")
            self._numbers.append((len(piece), 3 if n > 1 else 2 if n else 1, 0, 0, 0, 1, 1))
            self.rows.append([0])
            return got
        low, kind = piece.lower(), _kind(piece)
        flags = lex.FLAGS.get(low, ())
        group = next((n for n in self._GROUPS if n in flags), "") if flags else ""
        crc = zlib.crc32
        digit = piece[0].isdigit()
        self._numbers.append((len(piece), 0, len(piece) if digit else int(group == "digit"), int(piece == "@" or group == "at"), int(piece[0].isalpha()), crc(f"{kind}|{group}".encode()) | 1, crc(low.encode())))
        self.rows.append([crc(f.encode()) % BUCKETS for f in _features(piece, low, kind, flags)])
        return got

    def numbers(self) -> np.ndarray:
        fresh = self._numbers[len(self._built) :]
        if fresh:
            self._built = np.concatenate([self._built, np.array(fresh, dtype=np.uint64)])
        return self._built


class Flat:
    """Texts as one run of tokens with separators before and after each."""

    def __init__(self, texts: list[str], tokens: Tokens):
        get, learn = tokens.at.get, tokens.learn
        ids, owner, first = [], [], []
        edge = [0] * _GAP
        base = 0
        for text in texts:
            pieces = _PIECE.findall(text)
            got = list(map(get, pieces))
            if None in got:
                got = [get(p) or learn(p) for p in pieces]
            ids += edge
            ids += got
            owner.append(len(pieces) + _GAP)
            first.append(base)
            base += len(text)
        ids += edge
        raw = np.array(ids, dtype=np.int64)
        numbers = tokens.numbers()
        size, space = (numbers[:, k].astype(np.int64)[raw] for k in (0, 1))
        stop = np.cumsum(size)
        real = np.nonzero(space == 0)[0]
        self.id = raw[real]
        self.stop = stop[real]
        self.start = self.stop - size[real]
        before, edge_before = (np.concatenate([x[:1], x[:-1]])[real] for x in (space, raw == 0))
        self.gap = np.where(self.id == 0, 3, np.where(before > 0, before, np.where(edge_before, 2, 0)))  # 0 none, 1 space, 2 new line or edge, 3 blank line
        self.text = np.repeat(np.arange(len(texts) + 1), [*owner, _GAP])[real]
        self.first = first
        self.tokens = tokens
        mine = numbers[self.id]
        self.digits = np.concatenate([[0], np.cumsum(mine[:, 2].astype(np.int64))])
        self.sign = np.concatenate([[0], np.cumsum(mine[:, 3].astype(np.int64))])
        self.alpha = mine[:, 4] > 0
        self.code, self.name = mine[:, 5], mine[:, 6]
        with np.errstate(over="ignore"):
            mixed = self.code * np.uint64(4) + np.minimum(self.gap, 1).astype(np.uint64)
            self.roll = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(_BASE, len(self.id))[:-1])])

    def __len__(self) -> int:
        return len(self.id)


#: Base of the rolling pattern, and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONE = np.ones(1, dtype=np.uint64)
_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n of ``base`` modulo 2^64."""
    got = _KNOWN.get(int(base), _ONE)
    if len(got) <= n:
        with np.errstate(over="ignore"):
            got = _KNOWN[int(base)] = np.cumprod(np.concatenate([_ONE, np.full(2 * n, base, dtype=np.uint64)]))
    return got[: n + 1]


class SpanField:
    """Weights of the field: of token features by role, of gaps, of lengths, of word pairs before, and of whole spans."""

    SHAPES = {"token": (BUCKETS, 8 * _N), "gap": (4, 3 * _N), "length": (max(LONGEST) + 1, _N), "pair": (BUCKETS, _N), "span": (2 * BUCKETS, _N)}

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            weights = {k: np.zeros(s, dtype=np.float32) for k, s in self.SHAPES.items()}
            weights["length"][:] = -1.0
        self.w = weights
        self.tokens = Tokens()
        self.scored = np.zeros((0, 8 * _N), dtype=np.float32)
        self.fitting = False

    def _sums(self, rows: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        return np.add.reduceat(self.w["token"][np.fromiter((x for r in rows for x in r), dtype=np.int64)], np.cumsum(sizes) - sizes, axis=0)

    def _token_scores(self, ids: np.ndarray) -> np.ndarray:
        """Role scores of tokens: while fitting those of the pieces at hand, else of all pieces met, kept."""
        if self.fitting:
            once, where = np.unique(ids, return_inverse=True)
            return self._sums([self.tokens.rows[t] for t in once.tolist()])[where]
        rows = self.tokens.rows[len(self.scored) :]
        if rows:
            self.scored = np.concatenate([self.scored, self._sums(rows)])
        return self.scored[ids]

    @staticmethod
    def _pairs(f: Flat) -> np.ndarray:
        """Bucket of the two pieces before each token."""
        one = np.concatenate([_ONE, f.name[:-1]])
        two = np.concatenate([_ONE, _ONE, f.name[:-2]])
        with np.errstate(over="ignore"):
            return ((one * _BASE + two) * _BASE >> np.uint64(40)).astype(np.int64) % BUCKETS

    @staticmethod
    def _span_rows(f: Flat, i: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Buckets of the whole-span features of the segments of n tokens from i: pattern, digits and length, first and last piece."""
        with np.errstate(over="ignore"):
            shape = (f.roll[i + n] - f.roll[i] - np.minimum(f.gap[i], 1).astype(np.uint64) * _powers(_BASE, len(f))[i]) * _powers(_UNBASE, len(f))[i]
            digits = np.minimum(f.digits[i + n] - f.digits[i], 24).astype(np.uint64)
            count = digits * np.uint64(32) + np.minimum(n, 31).astype(np.uint64)
            edges = f.code[i] * np.uint64(31) + f.code[i + n - 1]
            total = digits + np.uint64(7777)
            return [((x * _BASE + np.uint64(salt)) * _BASE >> np.uint64(33)).astype(np.int64) % (2 * BUCKETS) for salt, x in enumerate((shape, count, edges, total), 1)]

    def additive(self, f: Flat) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(type, length, starts, scores without whole-span features) of all segments that may be of the type, for every type and length.

        An e-mail address holds an at-sign or a word for it, a number five digits, an address a digit, and
        a name begins with a letter and holds no digit; no segment spans a blank line or two texts.
        """
        size = len(f)
        s = self._token_scores(f.id).reshape(size, 8, _N)
        gap = self.w["gap"].reshape(4, 3, _N)
        shift = lambda x, k: np.concatenate([np.zeros((k, *x.shape[1:]), x.dtype), x[:-k]])
        ahead = lambda x, k: np.concatenate([x[k:], np.zeros((k, *x.shape[1:]), x.dtype)])
        bag = np.concatenate([np.zeros((1, _N), np.float32), np.cumsum(s[:, _LEFTS], axis=0)])
        low, high = np.maximum(np.arange(size) - 2 - _BAG, 0), np.maximum(np.arange(size) - 2, 0)
        begin = s[:, _BEGIN] + gap[f.gap, 0] + shift(s[:, _LEFT1], 1) + shift(s[:, _LEFT2], 2) + bag[high] - bag[low] + self.w["pair"][self._pairs(f)] - gap[f.gap, 1]
        inside = s[:, _INNER] + gap[f.gap, 1]
        end = s[:, _END] + ahead(gap[f.gap, 2], 1) + ahead(s[:, _RIGHT1], 1) + ahead(s[:, _RIGHT2], 2)
        # tokens that may follow the first of a segment: up to the next edge or blank line
        wall = np.nonzero((f.id == 0) | (f.gap == 3))[0]
        wall = np.append(wall, size)
        room = wall[np.searchsorted(wall, np.arange(size), side="right")] - np.arange(size)
        room[f.id == 0] = 0
        for y in range(_N):
            most = LONGEST[y]
            reach = np.arange(size) + np.minimum(room, most)
            if y == 0:
                starts = np.nonzero(f.sign[reach] > f.sign[:-1])[0]
            elif y in (1, 2):
                starts = np.nonzero(f.digits[reach] - f.digits[:-1] >= 5)[0]
            elif y == 3:
                starts = np.nonzero(f.digits[reach] > f.digits[:-1])[0]
            else:
                starts = np.nonzero(f.alpha & (room > 0))[0]
            if not len(starts):
                continue
            running = np.concatenate([[0.0], np.cumsum(inside[:, y], dtype=np.float64)])
            b = begin[starts, y] - running[starts]
            e = end[:, y] + running[1:]
            left, d0, s0 = room[starts], f.digits[starts], f.sign[starts]
            for n in range(1, most + 1):
                last = starts + (n - 1)
                ok = left >= n
                if not ok.all():
                    starts, last, b, left, d0, s0 = starts[ok], last[ok], b[ok], left[ok], d0[ok], s0[ok]
                    if not len(starts):
                        break
                score = b + e[last] + self.w["length"][n, y]
                if y == 0:
                    ok = f.sign[last + 1] > s0
                elif y in (1, 2):
                    ok = f.digits[last + 1] - d0 >= 5
                elif y == 3:
                    ok = f.digits[last + 1] > d0
                else:
                    ok = f.digits[last + 1] == d0
                yield y, n, starts[ok], score[ok].astype(np.float32)

    def _most(self) -> np.ndarray:
        """Bound of the whole-span features of each type."""
        return 4 * np.maximum(self.w["span"].max(0), 0)

    def segments(self, f: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, type, score) of every segment of positive score."""
        most = self._most()
        out = []
        for y, n, i, score in self.additive(f):
            some = score > -most[y]
            i, score = i[some], score[some]
            if len(i):
                total = score + sum(self.w["span"][r, y] for r in self._span_rows(f, i, np.full(len(i), n)))
                keep = total > 0
                out.append((i[keep], np.full(keep.sum(), n), np.full(keep.sum(), y), total[keep]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Best set of (start, end, type) without overlap of each text."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (held == 0 or held + len(texts[stop]) < MAX_TOKENS):
                held += len(texts[stop]) + 1
                stop += 1
            if len(self.tokens.rows) > 400_000:
                self.tokens, self.scored = Tokens(), self.scored[:0]
            f = Flat(texts[at:stop], self.tokens)
            i, n, y, score = self.segments(f)
            order = np.lexsort((i, i + n))
            group: dict[int, list] = {}
            for k in order.tolist():
                a = int(i[k])
                group.setdefault(int(f.text[a]), []).append((a, a + int(n[k]), float(score[k]), int(y[k])))
            for k, spans in group.items():
                found[at + k] = [(int(f.start[a]) - f.first[k], int(f.stop[b - 1]) - f.first[k], TYPES[t]) for a, b, t in best_set(spans)]
            at = stop
        return found

    # ---- fitting ----

    def fit(self, examples: Iterable[tuple[str, list[tuple[int, int, str]]]], epochs: int = 5, batch: int = 48, rate: float = 0.25, decay: float = 2e-5, seed: int = 7) -> SpanField:
        """Gradient of the log likelihood of the given segmentations (AdaGrad).

        A given span is widened to whole tokens; one longer than the bound of its type is left out.
        """
        data = [(plain(t), spans) for t, spans in examples if t]
        data.sort(key=lambda x: len(x[0]))
        chunks = [data[k : k + batch] for k in range(0, len(data), batch)]
        sums = {k: np.full(v.shape, 1e-2, dtype=np.float32) for k, v in self.w.items()}
        rng = random.Random(seed)
        self.tokens, self.fitting = Tokens(), True
        for _ in range(epochs):
            rng.shuffle(chunks)
            for chunk in chunks:
                f = Flat([t for t, _ in chunk], self.tokens)
                for name, rows, d in self._gradient(f, self._gold(f, [s for _, s in chunk])):
                    some, where = np.unique(rows, return_inverse=True)
                    order = np.argsort(where, kind="stable")
                    g = np.add.reduceat(d[order], np.concatenate([[0], np.cumsum(np.bincount(where))[:-1]]), axis=0)
                    g = g - decay * len(chunk) * self.w[name][some]
                    sums[name][some] += g * g
                    self.w[name][some] += rate * g / np.sqrt(sums[name][some])
        self.scored, self.fitting = self.scored[:0], False
        return self

    @staticmethod
    def _gold(f: Flat, spans: list[list[tuple[int, int, str]]]) -> list[tuple[int, int, int]]:
        out = []
        for k, some in enumerate(spans):
            for a, b, t in some:
                y = TYPES.index(t)
                i = int(np.searchsorted(f.stop, f.first[k] + a, side="right"))
                j = int(np.searchsorted(f.start, f.first[k] + b, side="left"))
                while i < len(f) and f.id[i] == 0:
                    i += 1
                while j > i and f.id[j - 1] == 0:
                    j -= 1
                if 0 < j - i <= LONGEST[y]:
                    out.append((i, j - i, y))
        return out

    def dense(self, f: Flat) -> np.ndarray:
        """Score (token, length - 1, type) of every segment; ``_NEVER`` where none may be."""
        size = len(f)
        out = np.full((size, max(LONGEST), _N), _NEVER, dtype=np.float32)
        for y, n, i, score in self.additive(f):
            if len(i):
                out[i, n - 1, y] = score + sum(self.w["span"][r, y] for r in self._span_rows(f, i, np.full(len(i), n)))
        return out

    def marginals(self, f: Flat, scores: np.ndarray) -> np.ndarray:
        """Probability of each segment over all segmentations of its text (forward and backward sums in logs)."""
        most = scores.shape[1]
        begin = np.concatenate([[0], np.nonzero(np.diff(f.text))[0] + 1, [len(f)]])
        rows = [(a, b) for a, b in zip(begin, begin[1:])]
        width = max(b - a for a, b in rows)
        place = np.zeros((len(rows), width + most), dtype=np.int64)
        real = np.zeros(place.shape, dtype=bool)
        for k, (a, b) in enumerate(rows):
            place[k, : b - a] = np.arange(a, b)
            real[k, : b - a] = True
        top = scores.max(2)
        total = top + np.log(np.exp(scores - top[:, :, None]).sum(2))
        s = np.where(real[:, :, None], total[place], _NEVER)  # (text, start, length)
        alpha = np.zeros((len(rows), width + most + 1))
        lengths = np.arange(1, most + 1)
        for j in range(1, width + 1):
            n = lengths[: min(j, most)]
            x = alpha[:, j - n] + s[:, j - n, n - 1]
            alpha[:, j] = np.logaddexp(alpha[:, j - 1], _logsum(x))
        z = alpha[:, width]
        beta = np.zeros((len(rows), width + most + 1))
        for i in range(width - 1, -1, -1):
            n = lengths[: min(most, width - i)]
            x = beta[:, i + n] + s[:, i, n - 1]
            beta[:, i] = np.logaddexp(beta[:, i + 1], _logsum(x))
        ends = np.arange(width)[:, None] + lengths[None, :]
        around = alpha[:, :width, None] + beta[:, ends] - z[:, None, None]
        flat = np.full((len(f), most), -1e9)
        inside = real[:, :width]
        flat[place[:, :width][inside]] = around[inside]
        return np.exp(np.minimum(0, flat[:, :, None] + scores))

    def _gradient(self, f: Flat, gold: list[tuple[int, int, int]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        scores = self.dense(f)
        d = -self.marginals(f, scores)
        for i, n, y in gold:
            if scores[i, n - 1, y] > _NEVER / 2:
                d[i, n - 1, y] += 1
        size, most = len(f), scores.shape[1]
        role = np.zeros((size + 2, 8, _N))
        role[:size, _BEGIN] = starts = d.sum(1)
        ends, cover = np.zeros((size + 2, _N)), np.zeros((size + most + 1, _N))
        cover[:size] += starts
        for n in range(1, most + 1):
            ends[n - 1 : size] += d[: size - n + 1, n - 1]
            cover[n : size + n] -= d[:, n - 1]
        role[:size, _INNER] = inner = np.cumsum(cover, axis=0)[:size]
        role[:, _END] = ends
        role[: size - 1, _LEFT1], role[: size - 2, _LEFT2] = starts[1:], starts[2:]
        for k in range(3, 3 + _BAG):
            role[: size - k, _LEFTS] += starts[k:]
        role[1 : size + 2, _RIGHT1], role[2 : size + 2, _RIGHT2] = ends[: size + 1], ends[:size]
        role = role[:size]
        once, where = np.unique(f.id, return_inverse=True)
        order = np.argsort(where, kind="stable")
        summed = np.add.reduceat(role.reshape(size, -1)[order], np.concatenate([[0], np.cumsum(np.bincount(where))[:-1]]), axis=0).astype(np.float32)
        rows = [self.tokens.rows[t] for t in once.tolist()]
        yield "token", np.fromiter((x for r in rows for x in r), dtype=np.int64), np.repeat(summed, [len(r) for r in rows], axis=0)
        gap = np.zeros((size, 3, _N))
        gap[:, 0], gap[:, 1] = starts, inner - starts
        gap[1:, 2] = ends[: size - 1]
        yield "gap", f.gap, gap.reshape(size, -1).astype(np.float32)
        yield "length", np.arange(1, most + 1), d.sum(0).astype(np.float32)
        yield "pair", self._pairs(f), starts.astype(np.float32)
        i, n, y = np.nonzero(np.abs(d) > 1e-3)
        if len(i):
            value = np.zeros((len(i), _N), dtype=np.float32)
            value[np.arange(len(i)), y] = d[i, n, y]
            rows = self._span_rows(f, i, n + 1)
            yield "span", np.concatenate(rows), np.concatenate([value] * len(rows))


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def best_set(spans: list[tuple[int, int, float, int]]) -> list[tuple[int, int, int]]:
    """(start, end, type) of the set of spans (start, end, score, type), sorted by end, that has the highest sum without overlap."""
    best, taken = [0.0], [(0, False)]
    for k, (a, _, score, _) in enumerate(spans):
        j = k
        while j > 0 and spans[j - 1][1] > a:
            j -= 1
        if best[j] + score > best[k]:
            best.append(best[j] + score)
            taken.append((j, True))
        else:
            best.append(best[k])
            taken.append((k, False))
    out, k = [], len(spans)
    while k > 0:
        j, used = taken[k]
        if used:
            out.append((spans[k - 1][0], spans[k - 1][1], spans[k - 1][3]))
        k = j
    return out[::-1]


def plain(text: str) -> str:
    """Text of the same length in plain forms; invisible characters stay in place as they are."""
    return text.translate(PLAIN) if _WIDE.search(text) else text


def find(field: SpanField, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) in each text as it is; invisible characters inside a span do not hide it."""
    shown: list[str] = []
    kept: dict[int, list[int]] = {}
    for k, text in enumerate(texts):
        s = text if text.isascii() else plain(text)
        if not s.isascii() and _HIDDEN.search(s):
            keep = kept[k] = [i for i, c in enumerate(s) if not _HIDDEN.match(c)]
            s = "".join(s[i] for i in keep)
        shown.append(s)
    out = field.decode(shown)
    for k, keep in kept.items():
        out[k] = [(keep[a], keep[b - 1] + 1, t) for a, b, t in out[k]]
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with a typed placeholder in the place of each span and all else untouched."""
    out, at = [], 0
    for a, b, t in spans:
        out += [text[at:a], PLACEHOLDER[t]]
        at = b
    return "".join(out) + text[at:]


def sure_sentences(field: SpanField, texts: list[str], most: int = 3500, seed: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences of the texts on which the field is sure, labelled by it: at most ``most`` with and ``most`` without spans.

    Sure is a span of a probability of 0.95 or more with no other of 0.2 or more beside it, or no span of more than 0.3.
    """
    from gatewarden.llm.sentences import boundaries

    seen = list(dict.fromkeys(s for t in texts for a, b in boundaries(t) if 3 < len(s := plain(_HIDDEN.sub("", t[a:b]))) < 300))
    random.Random(seed).shuffle(seen)
    found = field.decode(seen)
    seen = [s for s, x in zip(seen, found) if x][: 2 * most] + [s for s, x in zip(seen, found) if not x][: 2 * most]
    seen.sort(key=len)
    yes, no = [], []
    for k in range(0, len(seen), 64):
        some = seen[k : k + 64]
        f = Flat(some, field.tokens)
        p = field.marginals(f, field.dense(f))
        highest: dict[int, float] = {}
        spans: dict[int, list] = {}
        for i, n, y in zip(*np.nonzero(p > 0.05)):
            q, t = float(p[i, n, y]), int(f.text[i])
            if q >= 0.95:
                spans.setdefault(t, []).append((int(f.start[i]) - f.first[t], int(f.stop[i + n]) - f.first[t], TYPES[y]))
            else:
                highest[t] = max(highest.get(t, 0.0), q)
        for t, s in enumerate(some):
            if t in spans and highest.get(t, 0.0) < 0.2:
                yes.append((s, sorted(spans[t])))
            elif t not in spans and highest.get(t, 0.0) < 0.3:
                no.append((highest.get(t, 0.0), s))
    no.sort(reverse=True)  # the least plain ones teach the most
    half = no[: most // 2] + no[most // 2 :: max(1, 2 * len(no) // most)]
    return yes[:most] + [(s, []) for _, s in half[:most]]


def train(texts: list[str]) -> SpanField:
    """Field from the written sentences, which goes on with the sentences of ``texts`` on which it is sure."""
    from gatewarden.llm.pii_examples import generated

    written = list(generated())
    field = SpanField().fit(written, epochs=4)
    return field.fit([*written, *sure_sentences(field, texts)], epochs=2, rate=0.15) if texts else field


def fit_on(rows: DataFrame, limit: int = SAMPLE_ROWS, about: int | None = None) -> SpanField:
    """Field fitted on written texts and on at most ``limit`` records."""
    return train([r["text"] for r in bounded_sample(rows.where("length(text) between 4 and 3000").select("text"), limit, "text", about=about)])


def _mapped(rows: DataFrame, field: SpanField, columns: str, each) -> DataFrame:
    shared = bounded(rows.sparkSession, field.w)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = SpanField(shared.value)
        names = [c.split()[0] for c in columns.split(", ")]
        for pdf in frames:
            texts = list(dict.fromkeys(pdf["text"]))
            memo = dict(zip(texts, find(f, texts)))
            out = []
            for o, r, t in zip(pdf["origin"], pdf["record_id"], pdf["text"]):
                out.extend((o, r, *x) for x in each(t, memo[t]))
            yield pd.DataFrame(out, columns=names)

    return rows.select("origin", "record_id", "text").mapInPandas(run, columns)


def find_kinds(rows: DataFrame, field: SpanField) -> DataFrame:
    """(origin, record_id, kind) of every kind found in a record; texts without any give no row, nor do empty ones."""
    return _mapped(rows, field, "origin string, record_id string, kind string", lambda text, spans: [(k,) for k in {t for _, _, t in spans}]).distinct()


def redacted_table(rows: DataFrame, field: SpanField) -> DataFrame:
    """(origin, record_id, text, n_found) of every row, repeated ones included, with placeholders."""
    return _mapped(rows, field, "origin string, record_id string, text string, n_found int", lambda text, spans: [(redact(text, spans), len(spans))])
