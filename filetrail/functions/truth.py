"""Three-valued logic helpers: missing is neither true nor false, and rules must never yield NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(predicate: Column) -> Column:
    """A predicate with NULL read as false."""
    return F.coalesce(predicate, F.lit(False))


def filled(text: Column) -> Column:
    """True for a string that is neither NULL nor empty."""
    return holds(text != "")


def first_filled(*texts: Column) -> Column:
    """The first string that is neither NULL nor empty; the last one is returned as it is."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts[:-1]], texts[-1])


def mentions(text: Column, word: str) -> Column:
    """Case-insensitive containment, false for NULL."""
    return holds(F.lower(text).contains(word))
