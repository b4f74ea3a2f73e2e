"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters that end a word (those of Unicode, with the ASCII separators).
SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII first: one range to test for most characters. The same words as without the first branch.
WORD = f"[!-~]++[^{SPACES}]*+|[^{SPACES}]++"
#: The same over ASCII, where no wide class need be tested.
_ASCII_WORD = r"[!-\x7f]++[\x00-\x08\x0e-\x1b!-\x7f]*+|[\x00-\x08\x0e-\x1b]++[\x00-\x08\x0e-\x1b!-\x7f]*+"
ENTITY = r"(?<![A-Za-z0-9_])blk_-?[0-9]+(?![A-Za-z0-9_])"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

#: Shape classes: a run of letters, digits, the marks that stand in for lost digits and those within paths is one ``w``.
_WORDLIKE, _GAP = "[A-Za-z0-9#?_.$/-]++", r"\s++"


def _is_ascii(col: Column) -> Column:
    """Whether each character is one byte."""
    return F.length(col) == F.octet_length(col)


def words(col: Column | str) -> Column:
    """The words of a text, in order: runs of characters other than white space. Null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(_is_ascii(col), F.regexp_extract_all(col, F.lit(_ASCII_WORD), F.lit(0))).otherwise(F.regexp_extract_all(col, F.lit(WORD), F.lit(0)))


def word_count(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(_is_ascii(col), F.regexp_count(col, F.lit(_ASCII_WORD))).otherwise(F.regexp_count(col, F.lit(WORD)))


def entities(col: Column | str, pattern: str = ENTITY) -> Column:
    """Distinct entity ids of a line, in order of first mention (null for a null line)."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)))


def shape(col: Column | str, fields: int) -> Column:
    """The shape of a line's first ``fields`` fields: words and paths as ``w``, gaps as one space, other marks kept."""
    head = F.regexp_extract(col, rf"^(?:\s*+\S++){{0,{fields}}}", 0)
    return F.regexp_replace(F.regexp_replace(head, _WORDLIKE, "w"), _GAP, " ")


def real_time(digits: Column) -> Column:
    """Timestamp of ``yyyyMMddHHmmss``; null for anything else, also for dates and times that do not exist."""
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))
