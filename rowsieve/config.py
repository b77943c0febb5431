"""All tunables of the row-deduplication engine."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class NormalizeConfig:
    #: Region of phone numbers without a country code, as an ISO code.
    phone_region: str = "RU"
    min_cell: int = 2
    min_row: int = 3


@dataclass(frozen=True)
class LshParams:
    band_size: int = 4
    band_count: int = 32
    thr_short: float = 0.22
    thr_long: float = 0.23


@dataclass(frozen=True)
class MinHashConfig:
    signature: int = 128
    seed: int = 42
    max_len: int = 1000
    max_pairs_per_row: int = 30
    short_row_max_length: int = 20
    very_short_len: int = 18
    min_overlap_very_short: int = 5
    min_ngram_overlap: int = 8
    lsh: LshParams = field(default_factory=LshParams)
    #: Fit the band size to a sample of the rows before hashing.
    calibrate: bool = True
    #: From so many rows on, trigrams in at least max(noisy_least, rows / noisy_share) rows are left out of signatures.
    noisy_from: int = 200
    noisy_least: int = 20
    noisy_share: int = 50
    #: Most rows of a batch; None: any number.
    max_batch: int | None = None

    def with_lsh(self, lsh: LshParams) -> MinHashConfig:
        return replace(self, lsh=lsh)


@dataclass(frozen=True)
class ScoreConfig:
    token_weight: float = 0.60
    lev_weight: float = 0.25
    jw_weight: float = 0.10
    #: Weighted scores up to these are rejected for rows shorter than hard_reject_len, or longer.
    hard_reject_len: int = 15
    hard_reject_short: float = 0.15
    hard_reject_long: float = 0.25
    fast_reject: float = 0.35
    short_len_limit: int = 30
    fast_confirm_short: float = 0.65
    fast_confirm_long: float = 0.55
    nn_len_limit: int = 20
    nn_confirm_short: float = 0.65
    nn_confirm_long: float = 0.78
    #: Pairs that a scorer sees at once.
    neural_batch: int = 50


@dataclass(frozen=True)
class SieveConfig:
    normalize: NormalizeConfig = field(default_factory=NormalizeConfig)
    minhash: MinHashConfig = field(default_factory=MinHashConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
