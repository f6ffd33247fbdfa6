"""Byte-level BPE by prefix dynamic programming.

The encoding of every byte prefix of a text ends in exactly one token, and a token may follow another
only if encoding the two together gives the two again. So one pass over the prefixes that stores each
prefix's last token is enough: appending extends the table, and an edit invalidates it only from the
piece it touches. Text is first cut into pieces by the vocabulary's pattern, as tokens never cross
pieces; equal pieces are encoded once per process.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gatewarden.llm.broadcasts import bounded

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-tokenisation pattern of the public 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Rank of a merge that never comes.
NEVER = 1 << 60


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixEncoder:
    """Encoder over one vocabulary; ``cache_size`` bounds the pieces remembered."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 300_000):
        self.ranks, self.cache_size = ranks, cache_size
        self.longest: dict[bytes, int] = {}  # longest token by its last two bytes
        for token in ranks:
            self.longest[token[-2:]] = max(len(token), self.longest.get(token[-2:], 1))
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.edges: dict[bytes, tuple[list, list]] = {}

    def _merge(self, data: bytes, below: int) -> list[bytes]:
        """Parts of ``data`` after all merges of a rank under ``below``, lowest rank first, leftmost first."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: bytes) -> tuple[list, list]:
        """(part, its rank, rank of the part that swallows it) down the left and the right edge of a token's merges."""
        known = self.edges.get(token)
        if known is None:
            known = self.edges[token] = ([], [])
            for side, out in enumerate(known):
                part, above = token, NEVER
                while True:
                    rank = self.ranks[part]
                    out.append((part, rank if len(part) > 1 else -1, above))
                    if len(part) == 1:
                        break
                    part, above = self._merge(part, rank)[-side], rank
        return known

    def _stay_apart(self, a: bytes, b: bytes) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= self.cache_size:
                self.apart.clear()
            known = self.apart[a, b] = self._no_merge_between(a, b)
        return known

    def _no_merge_between(self, a: bytes, b: bytes) -> bool:
        """Whether encoding ``a + b`` gives the tokens ``a`` and ``b``: no merge across the seam comes
        at a time when both of its parts stand there (of equal ranks the left one comes first)."""
        ranks = self.ranks
        for x, made_x, gone_x in self._edges(a)[1]:
            for y, made_y, gone_y in self._edges(b)[0]:
                rank = ranks.get(x + y)
                if rank is not None and made_x < rank < gone_x and made_y < rank <= gone_y:
                    return False
        return True

    def extend(self, data: bytes, last: list[int]) -> None:
        """Continue the table ``last`` (length of the last token of each prefix; last[0] = 0) over ``data``."""
        ranks = self.ranks
        for end in range(len(last), len(data) + 1):
            for start in range(max(0, end - self.longest.get(data[max(0, end - 2) : end], 1)), end):
                token = data[start:end]
                if token in ranks and (not start or self._stay_apart(data[start - last[start] : start], token)):
                    last.append(end - start)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def read(self, data: bytes, last: list[int]) -> tuple[int, ...]:
        out, end = [], len(data)
        while end:
            out.append(self.ranks[data[end - last[end] : end]])
            end -= last[end]
        return tuple(reversed(out))

    def piece(self, text: str) -> tuple[int, ...]:
        known = self.pieces.get(text)
        if known is None:
            data, last = text.encode("utf-8", "replace"), [0]
            if data in self.ranks:
                known = (self.ranks[data],)
            else:
                self.extend(data, last)
                known = self.read(data, last)
            if len(self.pieces) >= self.cache_size:
                self.pieces.clear()
            self.pieces[text] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """Token ids; the empty list for null and for empty text."""
        out: list[int] = []
        get = self.pieces.get
        for p in self.split(text or ""):
            out += get(p) or self.piece(p)
        return out


class EditableText:
    """A text whose encoding follows appends and edits without encoding the rest again."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.parts = encoder.split(text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]``: pieces are cut again from two pieces before the edit until the cuts agree."""
        at, first = 0, 0
        while first < len(self.parts) and at + len(self.parts[first]) < start:
            at += len(self.parts[first])
            first += 1
        for _ in range(2):
            if first:
                first -= 1
                at -= len(self.parts[first])
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        old_ends, pos = {}, 0
        for i, p in enumerate(self.parts):
            pos += len(p)
            if pos > end:
                old_ends[pos + shift] = i
        fresh, pos = [], at
        for m in regex.finditer(PATTERN, self.text, pos=at):
            fresh.append(m.group())
            pos = m.end()
            if pos in old_ends and pos > start + len(new) + 1:
                self.parts = self.parts[:first] + fresh + self.parts[old_ends[pos] + 1 :]
                return
        self.parts = self.parts[:first] + fresh

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [t for p in self.parts for t in self.encoder.piece(p)]


#: Encoders of this worker process by vocabulary, so that pieces stay known from task to task.
_ENCODERS: dict[str, PrefixEncoder] = {}


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (list of integers) of every row; the empty list for null and empty texts.

    One pass without a shuffle. The vocabulary is read by the driver and broadcast (under 1 MB).
    Rows are kept as they are, repeated ones included; other columns are ignored.
    """
    shared = bounded(df.sparkSession, read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, PrefixEncoder(shared.value))
        for batch in batches:
            flat, offsets = [], [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat += encoder.encode(t)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
