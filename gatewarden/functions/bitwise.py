"""Bit-parallel string comparison over sequences of any symbols."""

from __future__ import annotations

from collections.abc import Sequence


def masks(pattern: Sequence) -> dict:
    """Bit positions of each symbol of the pattern."""
    out: dict = {}
    for i, s in enumerate(pattern):
        out[s] = out.get(s, 0) | 1 << i
    return out


def best_match(pattern_masks: dict, size: int, text: Sequence) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of the text, end of the first such stretch), after Myers."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    vp, vn, score = full, 0, size
    best, at = size, 0
    get = pattern_masks.get
    for j, s in enumerate(text, 1):
        eq = get(s, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1, hn << 1
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
        if score < best:
            best, at = score, j
    return best, at


def masked_lcs(pattern_masks: dict, size: int, text: Sequence) -> int:
    """Length of the longest common subsequence of the pattern and the text."""
    full = row = (1 << size) - 1
    get = pattern_masks.get
    for s in text:
        u = row & get(s, 0)
        if u:
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def lcs_length(a: Sequence, b: Sequence) -> int:
    return masked_lcs(masks(a), len(a), b)
