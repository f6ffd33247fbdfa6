"""Bit-parallel string comparison, as in the core, and the places of a common subsequence."""

from __future__ import annotations

from collections.abc import Sequence

from gatewarden.functions.bitwise import best_match, lcs_length, masked_lcs, masks

__all__ = ["best_match", "lcs_length", "lcs_places", "lcs_rows", "masked_lcs", "masks"]


def lcs_rows(pattern_masks: dict, size: int, text: Sequence) -> list[int]:
    """After each symbol of the text, the bits of the pattern at which the common subsequence does not grow."""
    full = row = (1 << size) - 1
    rows = [full]
    get = pattern_masks.get
    for s in text:
        u = row & get(s, 0)
        if u:
            row = ((row + u) | (row - u)) & full
        rows.append(row)
    return rows


def lcs_places(rows: list[int], size: int) -> list[int]:
    """Places of the pattern that one longest common subsequence matches, ascending."""
    out = []
    i, j = len(rows) - 1, size
    while i and j:
        if rows[i] >> (j - 1) & 1:  # nothing gained by the pattern's last symbol
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:  # nor by the text's
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(j)
    return out[::-1]
