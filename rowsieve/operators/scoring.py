"""Scores of candidate pairs, the routes that they take, and the pluggable scorer of undecided ones."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.config import ScoreConfig
from rowsieve.functions import similarity
from rowsieve.functions.latin import register
from rowsieve.shipping import ship

#: Scores pairs of texts; runs in the Python workers, so it must pickle.
PairScorer = Callable[[list[tuple[str, str]]], list[float]]

#: Further similarities by name: a function of two columns. Given weights, they join the weighted score.
Scorer = Callable[[Column, Column], Column]

log = logging.getLogger(__name__)


def no_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """What an unreachable scorer amounts to."""
    return [0.0] * len(pairs)


def scored(pairs: DataFrame, cfg: ScoreConfig = ScoreConfig(), extra: Mapping[str, tuple[float, Scorer]] | None = None) -> DataFrame:
    """pairs (..., left, right) with token, lev, jw, weighted and max_len. All of it runs in the JVM."""
    register(pairs.sparkSession)
    left, right = F.col("left"), F.col("right")
    rows = pairs.withColumn("token", similarity.token_set(left, right))
    rows = rows.withColumn("lev", similarity.levenshtein(left, right))
    rows = rows.withColumn("jw", similarity.jaro_winkler(left, right))
    weighted = F.lit(cfg.token_weight) * F.col("token") + F.lit(cfg.lev_weight) * F.col("lev") + F.lit(cfg.jw_weight) * F.col("jw")
    for name, (weight, scorer) in (extra or {}).items():
        rows = rows.withColumn(name, scorer(left, right))
        weighted = weighted + F.lit(weight) * F.col(name)
    return rows.withColumn("weighted", weighted).withColumn("max_len", F.greatest(F.length(left), F.length(right)))


def route(weighted: Column, max_len: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    """hard_reject, confirm, neural or drop."""
    reject = F.when(max_len < cfg.hard_reject_len, F.lit(cfg.hard_reject_short)).otherwise(F.lit(cfg.hard_reject_long))
    confirm = F.when(max_len < cfg.short_len_limit, F.lit(cfg.fast_confirm_short)).otherwise(F.lit(cfg.fast_confirm_long))
    return F.when(weighted <= reject, "hard_reject").when(weighted >= confirm, "confirm").when(weighted > F.lit(cfg.fast_reject), "neural").otherwise("drop")


def routed(rows: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    return rows.withColumn("route", route(F.col("weighted"), F.col("max_len"), cfg))


def score_texts(scorer: PairScorer, pairs: list[tuple[str | None, str | None]], batch: int) -> list[float | None]:
    """Scores of pairs of texts, batch at a time. A pair with an empty side scores 0 and isn't asked for; one whose batch
    failed, or whose score is missing or outside 0 to 1, has None."""
    stripped = [((a or "").strip(), (b or "").strip()) for a, b in pairs]
    full, out = [i for i, (a, b) in enumerate(stripped) if a and b], [0.0] * len(pairs)
    for at in range(0, len(full), batch):
        asked = full[at : at + batch]
        try:
            answers = list(scorer([stripped[i] for i in asked]))
            if len(answers) != len(asked):
                raise ValueError(f"{len(answers)} scores for {len(asked)} pairs")
        except Exception as e:
            log.warning("scorer failed: %s", e)
            answers = [None] * len(asked)
        for i, x in zip(asked, answers):
            out[i] = float(x) if x is not None and 0.0 <= x <= 1.0 else None
    return out


def score_pair(scorer: PairScorer, left: str | None, right: str | None) -> float:
    """The score of one pair; 0 where there is none."""
    return score_texts(scorer, [(left, right)], 1)[0] or 0.0


def neural_scores(pairs: DataFrame, scorer: PairScorer, cfg: ScoreConfig = ScoreConfig(), known: DataFrame | None = None) -> DataFrame:
    """left, right and neural (null where the scorer has failed) of the distinct texts in pairs.

    known has scores from earlier runs, in the same columns: those pairs aren't asked for. To remember, store the rows of
    the result that aren't null."""
    ship(pairs.sparkSession)
    size, asked = cfg.neural_batch, pairs.select("left", "right").distinct()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(zip(*[c.to_pylist() for c in batch.columns]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(scorer, texts, size), type=pa.float64())], names=["left", "right", "neural"])

    if known is None:
        return asked.mapInArrow(ask, "left string, right string, neural double")
    known = known.where("neural is not null").select("left", "right", "neural").dropDuplicates(["left", "right"])
    found = asked.join(known, ["left", "right"])
    return asked.join(known, ["left", "right"], "left_anti").mapInArrow(ask, "left string, right string, neural double").unionByName(found)


def neural_confirmed(neural: Column, max_len: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    return neural >= F.when(max_len < cfg.nn_len_limit, F.lit(cfg.nn_confirm_short)).otherwise(F.lit(cfg.nn_confirm_long))


def with_neural(rows: DataFrame, scorer: PairScorer, cfg: ScoreConfig = ScoreConfig(), known: DataFrame | None = None) -> DataFrame:
    """Undecided rows with neural and neural_confirm. A pair without a score has 0."""
    answers = neural_scores(rows, scorer, cfg, known)
    rows = rows.join(answers, ["left", "right"], "left").withColumn("neural", F.coalesce("neural", F.lit(0.0)))
    return rows.withColumn("neural_confirm", neural_confirmed(F.col("neural"), F.col("max_len"), cfg))
