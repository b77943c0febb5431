"""Trigrams, MinHash signatures and the pair predicates of the candidate stage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsieve.config import LshParams, MinHashConfig
from rowsieve.functions.javarandom import JavaRandom
from rowsieve.functions.latin import composed

#: The finalizer's multipliers; trigrams are counted by the low bits of their hashes.
FIRST, SECOND, LOW_BITS = 0x7FEB352D, 0x846CA68B, 0xFFFFFF


# Columns.


def padded(value: Column) -> Column:
    return F.concat(F.lit(" "), F.replace(value, F.lit("|"), F.lit(" ")), F.lit(" "))


def trigrams(value: Column) -> Column:
    """Distinct trigrams of characters of the padded value."""
    text = padded(value)
    n = F.length(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)))
    return F.array_distinct(F.when(n >= 3, every).otherwise(F.array().cast("array<string>")))


def effective_length(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def acronym(value: Column) -> Column:
    words = F.filter(F.split(value, r"\W+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.lower(F.left(w, F.lit(1)))), "")


def long_words(value: Column) -> Column:
    return F.filter(F.split(value, r"\W+"), lambda w: F.length(w) > 3)


def same_acronym(a: Column, b: Column) -> Column:
    return (a == b) & (a != "")


def lengths_compatible(a: Column, b: Column) -> Column:
    """Of effective lengths."""
    return (F.least(a, b) < 16) | (F.abs(a - b) * 2 <= F.greatest(a, b))


def threshold(len_a: Column, len_b: Column, cfg: MinHashConfig = MinHashConfig()) -> Column:
    """Least Jaccard index: thr_short up to a length of 5, thr_long from short_row_max_length on, linear between."""
    p, shorter, top = cfg.lsh, F.least(len_a, len_b), cfg.short_row_max_length
    part = (shorter - 5).cast("double") / F.lit(float(top - 5))
    between = F.lit(p.thr_short) - part * F.lit(p.thr_short - p.thr_long)
    return F.when(shorter < 5, F.lit(p.thr_short)).when(shorter >= top, F.lit(p.thr_long)).otherwise(between)


def least_overlap(len_a: Column, len_b: Column, cfg: MinHashConfig = MinHashConfig()) -> Column:
    shorter = F.least(len_a, len_b)
    usual = F.when(shorter <= 40, F.lit(cfg.min_ngram_overlap)).otherwise(F.greatest(F.lit(cfg.min_ngram_overlap), F.ceil(shorter / F.lit(4.0)).cast("int")))
    return F.when(shorter < cfg.very_short_len, F.lit(cfg.min_overlap_very_short)).otherwise(usual)


def passes(grams_a: Column, grams_b: Column, len_a: Column, len_b: Column, cfg: MinHashConfig = MinHashConfig()) -> Column:
    """Enough trigrams in common, by number and by share."""
    common = F.size(F.array_intersect(grams_a, grams_b))
    union = F.size(grams_a) + F.size(grams_b) - common
    some = (F.size(grams_a) > 0) & (F.size(grams_b) > 0)
    return some & (common >= least_overlap(len_a, len_b, cfg)) & (common >= threshold(len_a, len_b, cfg) * union)


def jaccard(grams_a: Column, grams_b: Column) -> Column:
    common = F.size(F.array_intersect(grams_a, grams_b))
    return common / F.greatest(F.size(grams_a) + F.size(grams_b) - common, F.lit(1))


def words_overlap(first: Column, second: Column) -> Column:
    """Two words of the second row, repeats included, are words of the first."""
    words = long_words(first)
    return F.size(F.filter(long_words(second), lambda w: F.array_contains(words, w))) >= 2


# Arrays of unsigned 32-bit numbers, in which products wrap around.


def finalize(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FIRST)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(SECOND)
    return x ^ (x >> np.uint32(16))


def gram_hashes(text: str) -> np.ndarray:
    """Distinct hashes of the trigrams of a text, signed, in ascending order."""
    points = np.frombuffer(f" {text.replace('|', ' ')} ".encode("utf-32-le"), dtype=np.uint32)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int32)
    mixed = (points[:-2] * np.uint32(31) + points[1:-1]) * np.uint32(31) + points[2:]
    return np.unique(finalize(mixed).view(np.int32))


def seeds(cfg: MinHashConfig = MinHashConfig()) -> np.ndarray:
    random = JavaRandom(cfg.seed)
    return np.array([random.next_int() for _ in range(cfg.signature)], dtype=np.int32).view(np.uint32)


def signature(grams: np.ndarray, noisy: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The smallest signed hash of the grams under each seed; the largest number where no gram is left. noisy: sorted."""
    if len(noisy) and len(grams):
        grams = grams[~np.isin(grams & LOW_BITS, noisy, assume_unique=False)]
    if not len(grams):
        return np.full(len(seed), np.iinfo(np.int32).max, dtype=np.int32)
    return finalize(grams.view(np.uint32)[None] ^ seed[:, None]).view(np.int32).min(1)


def bucket_keys(signatures: np.ndarray, lsh: LshParams) -> np.ndarray:
    """A row of keys per signature: the first two numbers of each band."""
    at = np.arange(lsh.band_count) * lsh.band_size
    high, low = signatures[:, at].astype(np.int64) << 32, signatures[:, at + 1].astype(np.int64) & 0xFFFFFFFF
    return high ^ low


def prepared(value: Column, cfg: MinHashConfig = MinHashConfig()) -> Column:
    """The text that trigrams are taken from."""
    return F.substr(composed(F.coalesce(value, F.lit(""))), F.lit(1), F.lit(cfg.max_len))
