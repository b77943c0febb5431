"""Similarity of two texts, from 0 to 1, as Column expressions. Edit distances and Jaro-Winkler need latin.register."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsieve.functions import latin
from rowsieve.functions.normalize import trim_control


def tokens(text: Column) -> Column:
    """Distinct words between white space, but for bars."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: (t != "") & (t != "|")))


def token_set(left: Column, right: Column) -> Column:
    """The harmonic mean of the shares of each side's distinct words that the other has."""
    a, b = tokens(left), tokens(right)
    common = F.size(F.array_intersect(a, b))
    return F.when(common > 0, 2.0 * common / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def levenshtein(left: Column, right: Column) -> Column:
    """1 - distance / longer length, or 0 where even the best prefix of the right text is further away than 0.7 of it."""
    a, b = (trim_control(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit(""))) for x in (left, right))
    longer = F.greatest(F.length(a), F.length(b))
    limit = F.ceil(longer * F.lit(0.7)).cast("int")
    # -1 where even the best prefix of the right text is too far.
    distance = latin.edits(a, b, limit)
    empty = (a == "") | (b == "") | (F.abs(F.length(a) - F.length(b)) > limit)
    return F.when(empty | (distance < 0), F.lit(0.0)).otherwise(F.lit(1.0) - distance / longer)


def jaro_winkler(left: Column | str, right: Column | str) -> Column:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return latin.jaro_winkler(col(left), col(right))
