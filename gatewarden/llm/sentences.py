"""Sentence boundaries for all scripts.

Character properties decide where a sentence may end (a character that Unicode calls a sentence
terminal, of whatever script, with the closing marks and the emoji that follow it) and whether what
follows can begin another (no lower-case letter, no comma or dash). Abbreviations, initials, numbers, links and file names hold a full stop back; quoted and
bracketed stretches hold back all terminators within. A blank line always ends a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that do not end a sentence, whatever follows, by language.
NEVER_FINAL = {
    "en": "approx cf dr eg esp est ft gen hon ie messrs mr mrs ms mt prof rev sec tel viz vs apt fig figs eq ca",
    "de": "abb abs bzw bzgl ca dr evtl fr ggf hr hrsg inkl nr prof sog str tel vgl zzgl",
    "es": "aprox art cap dr dra ej fig núm pág pags prof sr sra srta tel ud uds",
    "fr": "art env ex fig mme mlle mm chap dr prof tél vol",
    "pt": "aprox art cap dr dra ex fig núm pág prof sr sra tel",
    "ru": "гл гр ул им кв руб см стр разд рис тел тыс млн обл проф",
    "hi": "क्र डॉ प्रो श्री",
}
#: Abbreviations that may end a sentence, if a capital follows.
MAY_END = "etc inc ltd corp co usw ltda jr bros st rd ave blvd ct"
#: Abbreviations only before a number, names of months among them.
BEFORE_NUMBER = "ap apto apdo no nr nº núm num p pp vol ch art sec jan feb mar apr jun jul aug sep sept oct nov dec"
#: Months that a German ordinal stands before.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember"

_NEVER = frozenset(w for words in NEVER_FINAL.values() for w in words.split())
_MAY_END = frozenset(MAY_END.split())
_NUMERIC = frozenset(BEFORE_NUMBER.split())
_MONTHS = frozenset(MONTHS.split())

EMOJI = "(?:[\U0001f1e6-\U0001f1ff]{2}|[☀-➿⬀-⯿⌚-⏿\U0001f300-\U0001faff])(?:[\U0001f3fb-\U0001f3ff️⃣]|‍[☀-➿\U0001f300-\U0001faff])*"
_BLANK = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85 ])[^\S\r\n]*(?:\r\n|[\n\r\x0b\x0c\x85 ])\s*| \s*")
_ALL = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000))))  # the planes beyond hold no marks
#: Marks that end sentences of running text but have no such character property: ellipses, Khmer and Tibetan stops.
_MORE = "…‥។៕།༎"
TERMINATORS = frozenset(regex.findall(r"[\p{Sentence_Terminal}\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}]", _ALL)) | frozenset(_MORE)
_CLASS = "".join(re.escape(c) for c in sorted(TERMINATORS))
_TERMINATOR = re.compile(f"[{_CLASS}]+")
_PAIRS = re.compile("[“”„«»‘’()（）「」『』【】《》\\[\\]\"]")
_AFTER = re.compile(rf"(?:[)\]}}\"”’»」』）】》]|\s?»|\s?[།༎]|{EMOJI})*")
_THAI = re.compile(rf"(?<=[ก-๎])(?:{EMOJI})?(\s+)(?=[ก-๎])")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-़ͯा-्]|\.(?=\w))*$")
_LAST_TOKEN = re.compile(r"\S*$")
_WHOLE = re.compile(r"(?:[^\W\d_]{5}|[\w%]*\d[\d.,]*%?)[)\]»”’]*$")
_SPACE = re.compile(r"\s*")
_NEXT_TOKEN = re.compile(r"\S*")
_CLOSES = {"”": "“„", "»": "«", "’": "‘", ")": "(", "）": "（", "」": "「", "』": "『", "】": "【", "》": "《", "]": "["}
#: Marks that end a sentence whatever follows, with or without a space: those of one script, and the wide ones.
_HARD = TERMINATORS - frozenset(".!?…‥؟․")
_CONTINUES = frozenset(",;:，、；：،؛—–-/＝=")
_OPENERS = "“„«‘(（「『【《[\"¿¡'"


def _spans(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Outermost quoted or bracketed stretches (opening, closing character)."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in _PAIRS.finditer(text, low, high):
        c, i = m.group(), m.start()
        if c == "’" and 0 < i < high - 1 and text[i - 1].isalnum() and text[i + 1].isalnum():
            continue  # apostrophe
        opens = None
        if c == "“" and any(o == "„" for o, _ in stack):
            opens = "„"
        elif c == '"':
            opens = '"' if any(o == '"' for o, _ in stack) else None
        elif c in _CLOSES:
            opens = _CLOSES[c]
        if opens is None:
            stack.append((c, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in opens:
                out.append((stack[k][1], i))
                del stack[k:]
                break
    out.sort()
    top: list[tuple[int, int]] = []
    for a, b in out:
        if not top or a > top[-1][1]:
            top.append((a, b))
    return top


def _first_letter(text: str, at: int, high: int) -> str:
    """First character at or after ``at`` that is no opening mark."""
    while at < high and text[at] in _OPENERS:
        at += 1
    return text[at] if at < high else ""


def _full_stop_holds(text: str, start: int, low: int, after: int, follow: int, high: int, gap: bool) -> bool:
    """Whether the full stop at ``start`` belongs to an abbreviation, a number, a link or a file name."""
    letter = _first_letter(text, follow, high)
    head = text[max(low, start - 40) : start]
    if not gap and after < high and follow == after == start + 1:
        before = text[start - 1] if start > low else ""
        if not letter.isalpha() or letter.islower() or before in _OPENERS or "฀" <= letter <= "๿" or letter >= "぀":
            return True
        if not letter.isupper() and not re.match(r"\w{2}", text[follow : follow + 2]):
            return True
        token = _LAST_TOKEN.search(head).group()
        rest = _NEXT_TOKEN.match(text, start, min(high, start + 60)).group()
        if "/" in token or "@" in token or "@" in rest or "://" in rest:
            return True
        tail = rest.rstrip(".!?,;:)”\"")
        if re.search(r"\.[a-z][a-z0-9]{0,4}$", tail):
            return True  # file name
        if before.isupper() and not token[:-1].rstrip(".").islower():
            return True
        if token in ("e.g", "i.e"):
            return True
    m = _WORD.search(head)
    word = m.group() if m else ""
    if not word:
        number = re.search(r"(?<![\w.])\d{1,4}$", head)
        if number and gap:
            after_word = re.match(r"[^\W\d_]+", text[follow : follow + 14])
            if after_word and len(number.group()) <= 2 and after_word.group().lower() in _MONTHS:
                return True
            if start - len(number.group()) == low:
                return True  # number of a list
        return False
    lower = word.lower()
    if "." in lower:
        parts = lower.split(".")
        if lower in ("e.g", "i.e", "z.b", "d.h", "u.a", "p.ej", "p.ex", "т.е"):
            return True
        if all(len(p) == 1 for p in parts):
            return not letter.isupper()
        lower = parts[-1]
    if len(lower) == 1:
        if lower in "дп" and re.search(r"т\.\s?[дп]$", head):
            return not letter.isupper()
        return letter.isalnum()
    if lower in _NEVER:
        return True
    if lower in _NUMERIC and (letter.isdigit() or lower in ("no", "nr") and re.match(r"[A-Z]{1,3}\d|\d", text[follow : follow + 4])):
        return True
    if lower.endswith("str") and letter.isdigit():
        return True  # a street
    if lower in _MAY_END:
        return not letter.isupper() or lower == "co" and text.startswith("KG", follow)
    return False


def _is_end(text: str, m: re.Match, low: int, high: int, after: int, quoted: bool) -> bool:
    """Whether the terminator ``m``, with its closing marks up to ``after``, ends a sentence."""
    follow = _SPACE.match(text, after, high).end()
    if follow >= high:
        return True
    mark, gap = m.group(), follow > after
    c = text[follow]
    if c in _CONTINUES and not (c in "-–—" and not gap):
        return False
    if c in "-–—":
        return False
    letter = _first_letter(text, follow, high)
    caseless = letter.isalpha() and not letter.isupper() and not letter.islower()
    if quoted and caseless:
        return False
    if mark[-1] in _HARD:
        return not (quoted and letter.islower())
    if letter.islower():
        if mark == "." and gap and not quoted:  # only after a whole word or a number, as an abbreviation is short
            return bool(_WHOLE.search(text, max(low, m.start() - 12), m.start())) and not _full_stop_holds(text, m.start(), low, after, follow, high, True)
        return c in "¿¡" and mark[-1] in "!?؟" and gap
    if len(mark) > 1 and set(mark) <= {".", "…"} or mark[-1] == "…":
        return letter.isupper() and gap
    if mark[-1] == ".":
        return not _full_stop_holds(text, m.start(), low, after, follow, high, gap or after > m.end())
    if not gap and after == m.end() and letter.isdigit():
        return False
    return True


def boundaries(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every sentence, in code points, without white space around."""
    at = 0
    n = len(text)
    while at < n:
        blank = _BLANK.search(text, at)
        stop = blank.start() if blank else n
        yield from _paragraph(text, at, stop)
        at = blank.end() if blank else n


def _paragraph(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    spans = _spans(text, low, high)
    ends: list[int] = []
    k = 0
    start = low
    for m in _TERMINATOR.finditer(text, low, high):
        pos, after = m.start(), m.end()
        if after <= start:
            continue
        while k < len(spans) and spans[k][1] < pos:
            k += 1
        quoted = k < len(spans) and spans[k][0] < pos < spans[k][1]
        if quoted:
            close = spans[k][1]
            if text[after:close].strip("   ”’»\"）)]」』"):
                continue
            after = close + 1
        after = _AFTER.match(text, after, high).end()
        if _is_end(text, m, start, high, after, quoted):
            ends.append(after)
            start = _SPACE.match(text, after, high).end()
    if any("฀" <= c <= "๿" for c in text[low:high]):
        for m in _THAI.finditer(text, low, high):
            if not any(a < m.start() < b for a, b in spans):
                ends.append(m.start(1))
        ends.sort()
    ends.append(high)
    a = low
    for b in ends:
        piece = text[a:b]
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            yield a + lead, a + len(piece.rstrip())
        a = max(a, b)


def sentence_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence of every document, zero-based in code points.

    Null, empty and white-space texts have no sentences; repeated rows are given each. One pass without
    a shuffle; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys, starts, ends = [], [], []
            for k, t in zip(pdf[key], pdf[text]):
                for a, b in boundaries(t):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({key: keys, "start_pos": starts, "end_pos": ends})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, start_pos int, end_pos int")
