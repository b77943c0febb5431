"""The whole cascade: normalize, exact groups, candidates, scores, undecided pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import SieveConfig
from rowsieve.operators import candidates, exact, normalize, scoring
from rowsieve.plans.storage import store


@dataclass(frozen=True)
class Duplicates:
    """Results for rows (row_id, cells)."""

    #: row_id, value, component, group_size
    groups: DataFrame
    #: first, second, left, right, jaccard, token, lev, jw, weighted, max_len, route, neural, neural_confirm
    scored: DataFrame

    @property
    def confirmed(self) -> DataFrame:
        return exact.exact_pairs(self.groups)

    @property
    def candidates(self) -> DataFrame:
        return self.scored.where("route = 'confirm' or neural_confirm").select("first", "second")

    @property
    def pairs(self) -> DataFrame:
        """first, second and status, confirmed or candidates. A pair has one status: rows of exact groups go no further."""
        return self.confirmed.withColumn("status", F.lit("confirmed")).unionByName(self.candidates.withColumn("status", F.lit("candidates")))

    @property
    def counters(self) -> DataFrame:
        """stage and n: pairs by route, undecided ones that the scorer confirmed, and rows in exact groups."""
        by_route = self.scored.groupBy(F.col("route").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
        by_neural = self.scored.where("neural_confirm").agg(F.count(F.lit(1)).alias("n")).select(F.lit("neural_confirm").alias("stage"), "n")
        exact_rows = self.groups.where("group_size > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("exact_rows").alias("stage"), "n")
        return by_route.unionByName(by_neural).unionByName(exact_rows)


def find_duplicates(rows: DataFrame, cfg: SieveConfig = SieveConfig(), scorer: scoring.PairScorer = scoring.no_scorer) -> Duplicates:
    """Duplicates among rows (row_id, cells array<string>). Every stage works only on what the cheaper one before left open."""
    return find_in_normalized(normalize.normalize_rows(rows, cfg.normalize), cfg, scorer)


def find_in_normalized(values: DataFrame, cfg: SieveConfig = SieveConfig(), scorer: scoring.PairScorer = scoring.no_scorer) -> Duplicates:
    groups = store(exact.exact_groups(values), "exact-groups")
    pairs = candidates.candidate_pairs(exact.remaining(groups), cfg.minhash)
    rows = store(scoring.routed(scoring.scored(pairs, cfg.score), cfg.score), "scored-pairs")
    open_ = scoring.with_neural(rows.where("route = 'neural'"), scorer, cfg.score)
    closed = rows.where("route <> 'neural'").withColumn("neural", F.lit(None).cast("double")).withColumn("neural_confirm", F.lit(False))
    return Duplicates(groups, store(open_.unionByName(closed), "decided-pairs"))
