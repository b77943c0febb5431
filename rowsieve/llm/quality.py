"""Quality rules with risk-controlled thresholds.

Five numbers per text (words, characters in words, symbols, repeated lines, words in repeated windows) give fixed base
rules and scores on which more rules are learnt: symbols per word, repeated words per word, repeated lines per line with a word, and
mean word length (too short, too long). A cutoff rejects the documents whose score is above it. The labelled documents (all of
them: the holdout) decide the cutoffs, stratum by stratum:

* Candidate cutoffs are the fixed edges of a grid, the same for all data.
* A cutoff is safe if the exact (Clopper-Pearson) upper bound of its false rejections, the share of those good documents of
  the stratum that pass the base rules which it rejects, is at most ``max_false_rejection``. Each bound holds at confidence
  1 - alpha / (strata * rules * edges), so by Bonferroni all chosen cutoffs are safe at once with confidence 1 - alpha.
* The rules of a stratum share the allowance equally, so the union of their rejections stays within it.
* Of the safe cutoffs that reject mostly bad documents, the highest is taken that rejects nearly as many bad ones as any;
  without one the rule is off.

The histograms are sums over all labelled documents, at most rules * (edges + 1) rows a stratum, and every stratum is
calibrated on its own in a task. Texts are never shuffled.

Nulls and edge cases: null and empty texts have no words, fail the base rules and aren't kept; a null stratum is a
stratum of its own; documents of a stratum without safe cutoffs face the base rules only; labels that are null or
without a document don't count; a document with several labels counts once, as bad if any of them says so; equal rows of
one doc_id count once, different texts of one doc_id each have its label; without labels every rule is off; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm._common import lookup, map_texts, materialize, read_table
from rowsieve.shipping import ship

RULES = ("symbols", "repeats", "dup_lines", "long_words", "short_words")
#: What is measured of each text.
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Grid edges of each score. A score is in the bin of the number of edges that it exceeds.
EDGES = {
    "symbols": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0],
    "repeats": [0.02, 0.05, 0.1, 0.15],
    "dup_lines": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "long_words": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
    "short_words": [-5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0],
}


@dataclass(frozen=True)
class QualityConfig:
    #: Confidence of all guarantees together is 1 - alpha.
    alpha: float = 0.05
    #: Most good documents of a stratum, as a share, that all learnt rules together may reject.
    max_false_rejection: float = 0.05
    #: A cutoff is only worth having if this share of the labelled documents that it rejects is bad.
    min_precision: float = 0.8
    #: Of the safe cutoffs the highest is taken that rejects this share of what the best of them does.
    near_best: float = 0.98
    min_words: int = 10
    max_repeat_percent: int = 20


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(b"".join(words).decode()), symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of so many words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(numbers) == len(words):
        return 0
    key, size = ids[:n], len(numbers)
    for k in range(1, window):
        if size * len(numbers) >= 1 << 62:  # number the distinct keys anew, so that keys stay exact
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * len(numbers) + ids[k : k + n], size * len(numbers)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


#: Terms of a binomial sum that are added, from the largest down; those beyond are below the rounding of doubles.
TERMS = 1_000_000


def upper_bound(bad: int, n: int, alpha: float) -> float:
    """Clopper-Pearson: the largest p for which at most so many of n are seen with probability above alpha."""
    if bad >= n:
        return 1.0
    # log C(n, k) for k = bad, bad - 1, ...
    k = np.arange(bad, max(0, bad - TERMS) - 1, -1, dtype=np.float64)
    steps = np.log(k[:-1]) - np.log(n - k[:-1] + 1)
    logs = math.lgamma(n + 1) - math.lgamma(bad + 1) - math.lgamma(n - bad + 1) + np.concatenate([[0.0], np.cumsum(steps)])
    low, high, target = bad / n, 1.0 - 1e-12, math.log(alpha)
    for _ in range(60):
        p = (low + high) / 2
        terms = logs + k * math.log(p) + (n - k) * math.log1p(-p)
        top = terms.max()
        low, high = (p, high) if top + math.log(np.exp(terms - top).sum()) > target else (low, p)
    return high


def scores() -> dict[str, F.Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / words
    return {
        "symbols": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "long_words": mean,
        "short_words": -mean,
    }


def _bin(rule: str, score: F.Column) -> F.Column:
    return sum((score > e).cast("int") for e in EDGES[rule])


def labelled(measured: DataFrame, labels: DataFrame, stratum: str, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The holdout: stratum, numbers and quality of the labelled documents. Each counts once, as the binomial bound takes it."""
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Documents that fail the base rules are gone anyway and say nothing about the learnt ones.
    kept = measured.where(~base_failed(cfg)).select("doc_id", stratum, *NUMBERS)
    return kept.join(labels, "doc_id").dropDuplicates()


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per stratum: stratum and a cutoff per rule (null: off). measured has doc_id, the numbers and stratum;
    labels has doc_id and quality (1: good, 0: bad)."""
    ship(measured.sparkSession)
    bins = F.array(*[F.struct(F.lit(r).alias("rule"), _bin(r, s).alias("bin")) for r, s in scores().items()])
    rows = labelled(measured, labels, stratum, cfg)
    counts = rows.select(F.col(stratum).alias("stratum"), "quality", F.explode(bins).alias("x")).groupBy("stratum", "x.rule", "x.bin")
    counts = counts.agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") != 1).cast("long")).alias("bad"))
    counts = materialize(counts, "quality-counts")
    strata = counts.select("stratum").distinct().count()
    tests = max(1, strata) * sum(map(len, EDGES.values()))
    allowed, level, least = cfg.max_false_rejection / len(RULES), cfg.alpha / tests, cfg.min_precision

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        row: dict = {"stratum": rows["stratum"].iloc[0]}
        for rule in RULES:
            edges = EDGES[rule]
            good, bad = np.zeros(len(edges) + 1), np.zeros(len(edges) + 1)
            mine = rows[rows["rule"] == rule]
            good[mine["bin"]], bad[mine["bin"]] = mine["good"], mine["bad"]
            safe: list[tuple[float, int]] = []
            for i, edge in enumerate(edges):
                above, wrong = int(bad[i + 1 :].sum()), int(good[i + 1 :].sum())
                # The bound is above the share seen, so most cutoffs need no bound.
                if above and above >= least * (above + wrong) and wrong <= allowed * good.sum() and upper_bound(wrong, int(good.sum()), level) <= allowed:
                    safe.append((edge, above))
            # Of those that reject nearly as much as any, the one that leaves clean documents the most room.
            most = max((above for _, above in safe), default=0)
            row[rule] = max((edge for edge, above in safe if above >= cfg.near_best * most), default=None)
        return pd.DataFrame([row], columns=["stratum", *RULES])

    schema = "stratum string, " + ", ".join(f"{r} double" for r in RULES)
    return counts.withColumn("stratum", F.col("stratum").cast("string")).groupBy("stratum").applyInPandas(choose, schema)


def base_failed(cfg: QualityConfig = QualityConfig()) -> F.Column:
    return (F.col("n_words") < cfg.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * cfg.max_repeat_percent)


def measure(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns in keep and the numbers of each text, written to the shared folder."""
    made = ", ".join(f"{c} bigint" for c in NUMBERS)
    return materialize(map_texts(docs, text, keep, made, lambda texts: list(zip(*map(measure_text, texts))) or [[]] * 6), "quality")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Add base_failed, kept and failed_rules to measured."""
    table = cutoffs.withColumnsRenamed({"stratum": "__stratum", **{r: f"__{r}" for r in RULES}})
    rows = measured.withColumn("__stratum", F.col(stratum).cast("string"))
    rows = lookup(rows, table, ["__stratum"], F.col("doc_id"), "left").withColumn("base_failed", base_failed(cfg))
    failed = F.array_compact(F.array(*[F.when(s > F.col(f"__{r}"), F.lit(r)) for r, s in scores().items()]))
    rows = rows.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return rows.drop("__stratum", *[f"__{r}" for r in RULES])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = measure(read_table(spark, sf_dir, "documents"), ("doc_id", "lang"))
    cutoffs = materialize(calibrate(measured, read_table(spark, sf_dir, "labels"), "lang"), "quality-cutoffs")
    rows = judge(measured, cutoffs, "lang")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
