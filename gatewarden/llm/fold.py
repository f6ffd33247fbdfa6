"""Folding of text for comparison: case, width, accents, punctuation, white space, invisible characters."""

from __future__ import annotations

import re
import unicodedata

#: Scripts written without spaces, whose characters count one by one: Thai, Kana and Han.
SOLID = "฀-๿぀-ヿ㐀-䶿一-鿿豈-﫿"
_SOLID = re.compile(f"[{SOLID}]")
#: Vowel signs and other marks inside words of Indic scripts.
_SIGNS = "ऀ-ःऺ-़ा-ॏ॑-ॗॢॣ"
_TOKENS = re.compile(rf"[{SOLID}]|[^\W_{SOLID}](?:[^\W_{SOLID}]|[{_SIGNS}])*")
_MARKS = re.compile("[̀-ͯ҃-҉ؐ-ًؚ-ٰٟ​-‏‪-‮⁠-⁤﻿­ـ︀-️]")


def fold(text: str) -> str:
    """Lower case, compatibility forms, Latin, Cyrillic and Arabic marks and invisible characters removed."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold())).casefold()


def tokens(text: str) -> list[str]:
    """Words of the folded text; each character of Thai, Kana and Han is one of its own."""
    return _TOKENS.findall(fold(text))


def is_solid(text: str) -> bool:
    """Whether most letters are of a script that is counted by characters."""
    n = len(_SOLID.findall(text))
    return n > 0 and 2 * n > sum(map(str.isalpha, text))
