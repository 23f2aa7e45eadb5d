"""Text predicates and small text transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns identifiers, tags and hashes must match in full.
IDENTIFIER = r"^[A-Z_][A-Z0-9_$]*$"
FQN = r"^[A-Z_][A-Z0-9_$]*(\.[A-Z_][A-Z0-9_$]*){3}$"
TAG_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"
REPETITION = r"^[1-9][0-9]*$"
SHA256_HEX = r"^[0-9a-f]{64}$"
PLAIN_NUMBER = r"^-?[0-9]*(\.[0-9]+)?$"


def null_if_blank(text: Column) -> Column:
    """The trimmed text, or null when nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def trimmed(text: Column) -> Column:
    """Leading and trailing whitespace of any kind removed."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_documented(description: Column) -> Column:
    """A description that is blank after trimming counts as missing."""
    return trimmed(F.coalesce(description, F.lit(""))) != ""


def sensitivity_or_default(sensitivity: Column) -> Column:
    """A column without a sensitivity tag is read as restricted."""
    return F.coalesce(sensitivity, F.lit("restricted"))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Case-folded phrase-in-text."""
    return F.contains(F.lower(text), F.lower(phrase))


def share_percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to one decimal as text with ``%``; ``n/a`` on a zero whole.

    Whole numbers go in and the division is decimal, so no float rounding shows. The
    tie rule is half-even, as an exact fraction formats.
    """
    exact = F.bround(
        (F.lit(100).cast("decimal(18,0)") * part.cast("decimal(18,0)"))
        / F.nullif(whole.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)")),
        1,
    ).cast("decimal(18,1)")
    return F.coalesce(F.concat(exact.cast("string"), F.lit("%")), F.lit("n/a"))


def bare_table_name(name: Column) -> Column:
    """A table as someone may write it: quotes dropped, upper case."""
    return F.upper(F.regexp_replace(name, '"', ""))
