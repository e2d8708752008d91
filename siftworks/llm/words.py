"""Native word splitting that the decontamination and fingerprint operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, in lower-cased text and in text of either case; a word is a run of anything else.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, also where then uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is fast, and the same where every character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Null counts as empty; an empty text has no words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def words_sql(text: str) -> str:
    """words_of as SQL text, for expressions that must be parsed whole."""
    gap = GAP.replace("\\", "\\\\")
    t = f"coalesce({text}, '')"
    return f"array_remove(split(CASE WHEN length({t}) = octet_length({t}) THEN lower({t}) ELSE translate({t}, '{UPPER}', '{LOWER}') END, '{gap}'), '')"
