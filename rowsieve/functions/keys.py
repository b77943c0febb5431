"""Keys and comparisons of the exact stage, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsieve.functions.normalize import trim_control

#: Separators of tokens, and patterns of the types.
BARS = r"\s*\|\s*"
NO_WORD = r"[^\p{IsAlphabetic}\d]"
SYMBOLS = NO_WORD + "+"
ISBN = r"(?i)\b(?:isbn(?::|\s))?\s*(97[89][- ]?)?\d{1,5}[- ]?\d{1,7}[- ]?\d{1,7}[- ]?[\dX]\b"
HASH = r"\b[0-9a-fA-F]{32}\b|\b[0-9a-fA-F]{40}\b|\b[0-9a-fA-F]{64}\b"
TYPED_URL = r"(?i)\A(?:[a-z][a-z0-9+.-]*://.*|\w+\.[a-z]{2,}.*)\z"


def original(value: Column) -> Column:
    return trim_control(F.coalesce(value, F.lit("")))


def _split(value: Column, pattern: str, chars: str) -> Column:
    """Tokens with those that are empty at the end left off, but not one at the start; of an empty value the empty token.
    chars: the class of characters of separators."""
    # One class and tried from the start of a run only, so that it takes linear time.
    tokens = F.split(F.regexp_replace(value, rf"(?<!{chars}){chars}+\z", ""), pattern, -1)
    only = value.rlike(rf"\A{chars}+\z")
    return F.when(value == "", F.array(F.lit(""))).when(only, F.array().cast("array<string>")).otherwise(tokens)


def canonical_tokens(value: Column) -> Column:
    """Sorted tokens, repeats included: cells of a row with bars, else words."""
    return F.array_sort(F.when(value.contains("|"), _split(value, BARS, r"[\s|]")).otherwise(_split(value, SYMBOLS, NO_WORD)))


def canonical(value: Column) -> Column:
    return F.array_join(canonical_tokens(value), "\u0001")


def alnum(value: Column) -> Column:
    """ASCII letters and digits only."""
    return F.regexp_replace(value, r"[^\p{Alnum}]", "")


def detect_type(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (
        F.when(value == "", "PLAIN")
        .when(value.rlike(ISBN), "ISBN")
        .when(value.rlike(HASH), "HASH")
        .when(value.rlike(TYPED_URL), "URL")
        .when(digits >= 10, "PHONE")
        .otherwise("PLAIN")
    )


def jaccard_at_least_half(a: Column, b: Column) -> Column:
    """Of token lists with repeats: 2 * common >= all together."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    whole = F.size(a) + F.size(b) - common
    return (whole > 0) & (common * 2 >= whole)
