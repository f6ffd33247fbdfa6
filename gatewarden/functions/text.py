"""Column builders for text: every one stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: digits read as letters by the moderation normaliser.
LEET_DIGITS, LEET_LETTERS = "013457", "oieast"


def strip(c: Column) -> Column:
    """Trim every Unicode white space, not only U+0020."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_id(c: Column) -> Column:
    """Identifier trimmed and in lower case; blank becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def collapse_space(c: Column) -> Column:
    """Trimmed text whose runs of white space are one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def or_unknown(c: Column, what: str) -> Column:
    """Key with the sentinel ``unknown_<what>`` for a missing or blank value."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(f"unknown_{what}"))


def first_non_empty(*cs: Column, default: str | None = None) -> Column:
    """First argument that is neither null, blank nor NaN."""
    texts = [F.nullif(F.nullif(strip(c.cast("string")), F.lit("")), F.lit("NaN")) for c in cs]
    return F.coalesce(*texts, F.lit(default))


def normalise(c: Column) -> Column:
    """Lower case, look-alike digits as letters, punctuation as spaces, single spaces."""
    return fold_marks(F.lower(c))


def fold_marks(c: Column) -> Column:
    """Look-alike digits as letters, punctuation as spaces, single spaces; case stays."""
    return collapse_space(F.regexp_replace(F.translate(c, LEET_DIGITS, LEET_LETTERS), r"\p{P}", " "))


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def term_hit(normalised: Column, term: str) -> Column:
    """Words of ``term`` in order, at most one foreign word between neighbours.

    Each gap takes its first match and is not tried again (atomic groups), so ``a b b x c`` does
    not hold the term ``a b c``.
    """
    first, *rest = term.split()
    pattern = f"(?:^| ){first}" + "".join(rf"(?> {w}(?= |$)| \S+ {w}(?= |$))" for w in rest) + "(?= |$)"
    if len(rest) == 0:
        pattern = f"(?:^| ){first}(?= |$)"
    return F.coalesce(normalised, F.lit("")).rlike(pattern)


def hex_prefix(length: int, *parts: Column) -> Column:
    """Stable identifier: the first hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def hex_number(digest: Column, byte: int) -> Column:
    return F.conv(F.substring(digest, 2 * byte + 1, 2), 16, 10).cast("int")
