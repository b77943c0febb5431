"""Candidate pairs from character trigrams by MinHash and banded buckets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.config import LshParams, MinHashConfig
from rowsieve.functions import grams
from rowsieve.functions.javarandom import JavaRandom
from rowsieve.functions.latin import register
from rowsieve.plans.storage import store
from rowsieve.shipping import ship
from rowsieve.sources.rows import limited

_LARGEST = np.iinfo(np.int32).max
#: Buckets of more rows than WHOLE are dealt into blocks of about BLOCK rows that meet each other.
WHOLE, BLOCK = 64, 1024


def document_frequency(rows: DataFrame) -> DataFrame:
    """gram (the low bits of its hash) and df, over the values as they are."""
    ship(rows.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Two trigrams of a row may share their low bits; each counts.
            found = [grams.gram_hashes(v or "") & grams.LOW_BITS for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *found]))], names=["gram"])

    return rows.select("value").mapInArrow(hashes, "gram int").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def noisy_grams(rows: DataFrame, n: int, cfg: MinHashConfig) -> np.ndarray:
    """The trigrams that very many rows have. A gram counts from a fixed share of the rows on, so they are a bounded number: at
    most noisy_share times the trigrams of an average row."""
    if n < cfg.noisy_from:
        return np.zeros(0, dtype=np.int32)
    limit = max(cfg.noisy_least, n // cfg.noisy_share)
    return np.sort(np.array([r["gram"] for r in document_frequency(rows).where(F.col("df") >= limit).select("gram").collect()], dtype=np.int32))


def features(rows: DataFrame, noisy: np.ndarray, cfg: MinHashConfig) -> DataFrame:
    """row_id, value, grams, len, eff_len, acronym, signature and keys of rows (row_id, value)."""
    spark = rows.sparkSession
    ship(spark)
    register(spark)
    seed, lsh = grams.seeds(cfg), cfg.lsh
    rows = rows.withColumn("text", grams.prepared(F.col("value"), cfg))
    rows = rows.select("row_id", "value", F.length("text").alias("len"), grams.effective_length(F.col("text")).alias("eff_len"), grams.acronym(F.col("text")).alias("acronym"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams.gram_hashes(t) for t in batch.column("text").to_pylist()]
            signed = np.stack([grams.signature(g, noisy, seed) for g in sets]) if sets else np.zeros((0, len(seed)), np.int32)
            keys = [np.unique(k) for k in grams.bucket_keys(signed, lsh)]
            made = [_lists(sets, pa.int32()), _lists(list(signed), pa.int32()), _lists(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=["row_id", "value", "len", "eff_len", "acronym", "grams", "signature", "keys"])

    schema = "row_id bigint, value string, len int, eff_len int, acronym string, grams array<int>, signature array<int>, keys array<bigint>"
    return rows.mapInArrow(hashed, schema)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _meeting(keys: DataFrame) -> DataFrame:
    x, y = keys.alias("x"), keys.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.row_id") < F.col("y.row_id")))
    return pairs.select(F.col("x.row_id").alias("a"), F.col("y.row_id").alias("b")).distinct()


def bucket_pairs(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of row_ids that share a bucket key. Only ids and keys are shuffled.

    With most, which candidate_pairs does not use, each row of a bucket meets that many rows behind it, in an order that puts rows of like signatures next
    to each other: a bucket of m rows makes most * m pairs instead of m * m / 2. Smaller buckets are whole."""
    keys = rows.select("row_id", F.slice("signature", 1, 4).alias("order"), F.explode("keys").alias("key"))
    if most is None:
        return _meeting(keys)
    bucket = Window.partitionBy("key")
    placed = keys.select("row_id", "key", F.row_number().over(bucket.orderBy("order", "row_id")).alias("place"), F.count(F.lit(1)).over(bucket).alias("n"))
    placed = store(placed.where("n > 1"), "buckets")
    ahead = placed.where("place < n").select("key", F.col("row_id").alias("x"), F.explode(F.sequence(F.col("place") + 1, F.least(F.col("n").cast("int"), F.col("place") + most))).alias("place"))
    pairs = ahead.join(placed.select("key", "place", F.col("row_id").alias("y")), ["key", "place"])
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_pairs(rows: DataFrame, pairs: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Those pairs whose rows are alike: first, second, left, right (the values), jaccard."""
    kept = ["value", "len", "eff_len", "acronym", "grams"]
    x = rows.select(F.col("row_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in kept])
    y = rows.select(F.col("row_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in kept])
    col = F.col
    alike = grams.same_acronym(col("acronym_a"), col("acronym_b")) | grams.lengths_compatible(col("eff_len_a"), col("eff_len_b"))
    close = grams.passes(col("grams_a"), col("grams_b"), col("len_a"), col("len_b"), cfg) | grams.words_overlap(col("value_a"), col("value_b"))
    found = pairs.join(x, "a").join(y, "b").where(alike & close)
    return found.select(col("a").alias("first"), col("b").alias("second"), col("value_a").alias("left"), col("value_b").alias("right"), grams.jaccard(col("grams_a"), col("grams_b")).alias("jaccard"))


def best_partners(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs that are among the most best of both of their rows, by Jaccard index, then the other row."""
    return _mutual(_ends(pairs), most)


def _ends(pairs: DataFrame) -> DataFrame:
    """row, other, jaccard: each pair from both of its rows."""
    both = F.array(F.struct(F.col("first").alias("row"), F.col("second").alias("other")), F.struct(F.col("second").alias("row"), F.col("first").alias("other")))
    return pairs.select(F.explode(both).alias("end"), "jaccard").select("end.row", "end.other", "jaccard")


def _mutual(ends: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("jaccard").desc(), "other"))
    kept = ends.withColumn("place", place).where(F.col("place") <= most).groupBy(F.least("row", "other").alias("first"), F.greatest("row", "other").alias("second"))
    return kept.agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("first", "second")


def _counts(lists: pa.ChunkedArray, ids: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the distinct members of each list, and how often they are in it. ids: numbers by member, added to."""
    out = []
    for members in lists.to_pylist():
        found = Counter(ids.setdefault(m, len(ids)) for m in members or [])
        out.append((np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float32, len(found))))
    return out


def _products(a: list, b: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of a and each of b: how many distinct members are common, how many members of b are in a and of a in b,
    repeats included. Dense products over 4096 members at a time; sums stay far below 2 ** 24, so they are exact."""
    out = [np.zeros((len(a), len(b)), dtype=np.float32) for _ in range(3)]
    for first in range(0, n, 4096):
        parts = []
        for lists in (a, b):
            once, often = np.zeros((len(lists), 4096), dtype=np.float32), np.zeros((len(lists), 4096), dtype=np.float32)
            for i, (ids, counts) in enumerate(lists):
                here = (ids >= first) & (ids < first + 4096)
                once[i, ids[here] - first], often[i, ids[here] - first] = 1, counts[here]
            parts.append((once, often))
        (x, xs), (y, ys) = parts
        out[0] += x @ y.T
        if any((c > 1).any() for _, c in [*a, *b]):
            out[1] += x @ ys.T
            out[2] += xs @ y.T
        else:
            out[1], out[2] = out[0], out[0]
    return out[0].astype(np.int64), out[1].astype(np.int64), out[2].astype(np.int64)


def block_scores(x: pa.Table, y: pa.Table, cfg: MinHashConfig) -> np.ndarray:
    """The Jaccard index of each row of x with each of y, -1 where they are not similar; the tests of similar_pairs."""
    col = lambda name: (x.column(name).to_numpy()[:, None].astype(np.int64), y.column(name).to_numpy()[None].astype(np.int64))
    names, words, found = {"": 0}, {}, {}
    a, b = (np.array([names.setdefault(v, len(names)) for v in t.column("acronym").to_pylist()]) for t in (x, y))
    effective, size, ids = col("eff_len"), col("len"), col("row_id")
    shorter, least = np.minimum(*size), np.minimum(*effective)
    alike = ((a[:, None] == b[None]) & (a[:, None] > 0)) | (least < 16) | (np.abs(effective[0] - effective[1]) * 2 <= np.maximum(*effective))
    lists = [_counts(t.column("grams"), found) for t in (x, y)]
    common = _products(*lists, len(found))[0]
    of = [np.array([len(g) for g, _ in part], dtype=np.int64) for part in lists]
    union = of[0][:, None] + of[1][None] - common
    p, top = cfg.lsh, cfg.short_row_max_length
    between = p.thr_short - (shorter - 5) / float(top - 5) * (p.thr_short - p.thr_long)
    share = np.where(shorter < 5, p.thr_short, np.where(shorter >= top, p.thr_long, between))
    usual = np.where(shorter <= 40, cfg.min_ngram_overlap, np.maximum(cfg.min_ngram_overlap, -(-shorter // 4)))
    enough = np.where(shorter < cfg.very_short_len, cfg.min_overlap_very_short, usual)
    close = (of[0][:, None] > 0) & (of[1][None] > 0) & (common >= enough) & (common >= share * union)
    spoken = [_counts(t.column("words"), words) for t in (x, y)]
    _, of_y, of_x = _products(*spoken, len(words))
    close |= np.where(ids[0] < ids[1], of_y, of_x) >= 2  # words of the row of larger key in the other
    return np.where(alike & close & (ids[0] != ids[1]), common / np.maximum(union, 1), -1.0)


def block_partners(rows: DataFrame, keys: DataFrame, most: int, cfg: MinHashConfig) -> DataFrame:
    """row, other, jaccard: for each pair of blocks of each bucket (row_id, key, n) the most best similar partners of a row.

    What a pair of blocks leaves out is behind most others for that row, so it can't be among the row's best of all."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = keys.select("row_id", "key", blocks.alias("blocks")).withColumn("mine", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    kept = rows.select("row_id", "len", "eff_len", "acronym", "grams", grams.long_words(F.col("value")).alias("words"))
    tasks = dealt.select("row_id", "key", F.least("mine", "with").alias("x"), F.greatest("mine", "with").alias("y"), "mine").join(kept, "row_id")

    def local(task: pa.Table) -> pa.Table:
        task = task.sort_by("row_id")  # ties go to the smaller row
        mine = task.column("mine").to_numpy()
        parts = [task.filter(pa.array(mine == m)) for m in np.unique(mine)]
        out: list[list[np.ndarray]] = [[], [], []]
        if task.column("x")[0].as_py() == task.column("y")[0].as_py():
            parts *= 2
        if len(parts) == 2:
            scores = block_scores(*parts, cfg)
            ids = [t.column("row_id").to_numpy() for t in parts]
            ways = [(scores, *ids)] if parts[0] is parts[1] else [(scores, *ids), (scores.T, *ids[::-1])]
            for found, one, other in ways:
                place = np.argsort(-found, axis=1, kind="stable")[:, :most]
                best = np.take_along_axis(found, place, axis=1)
                i, j = np.nonzero(best >= 0)
                for made, values in zip(out, (one[i], other[place[i, j]], best[i, j])):
                    made.append(values)
        flat = [np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, np.float64), out)]
        return pa.table([pa.array(c) for c in flat], names=["row", "other", "jaccard"])

    return tasks.groupBy("key", "x", "y").applyInArrow(local, "row bigint, other bigint, jaccard double")


def candidate_pairs(rows: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """first, second, left, right, jaccard of similar rows (row_id, value). Buckets are looked at whole; the cap on a row's
    partners is applied to the pairs that pass the tests."""
    rows = store(limited(rows.select("row_id", "value"), cfg.max_batch), "candidate-rows")
    n, most = rows.count(), cfg.max_pairs_per_row
    if cfg.calibrate and cfg.lsh == LshParams():
        cfg = cfg.with_lsh(calibrated(rows, n, cfg))
    made = store(features(rows, noisy_grams(rows, n, cfg), cfg), "candidate-features")
    keys = made.select("row_id", F.explode("keys").alias("key"))
    # Buckets of the same rows are one.
    seals = [F.bit_xor(F.xxhash64("row_id", F.lit(i))).alias(f"seal{i}") for i in (0, 1)]
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *seals).where("n > 1").groupBy("n", "seal0", "seal1").agg(F.min("key").alias("key"))
    keys = store(keys.join(buckets.select("key", "n"), "key"), "buckets")
    small = similar_pairs(made, _meeting(keys.where(F.col("n") <= WHOLE)), cfg)
    large = block_partners(made, keys.where(F.col("n") > WHOLE), most, cfg)
    ends = _ends(small).unionByName(large).groupBy("row", "other").agg(F.max("jaccard").alias("jaccard"))
    ends = store(ends, "candidate-ends")
    kept = ends.select(F.col("row").alias("first"), F.col("other").alias("second"), "jaccard").join(_mutual(ends, most), ["first", "second"], "left_semi")
    left, right = (made.select(F.col("row_id").alias(k), F.col("value").alias(v)) for k, v in (("first", "left"), ("second", "right")))
    return store(kept.join(left, "first").join(right, "second").select("first", "second", "left", "right", "jaccard"), "candidate-pairs")


def drawn_positions(n: int) -> list[int]:
    """Positions of the sample, with repeats."""
    random = JavaRandom(123)
    return [random.next_int(n) for _ in range(min(300, max(50, n // 10)))]


def at_positions(rows: DataFrame, positions: list[int]) -> dict[int, str]:
    """Values of the rows at these places in the order of row_id, without a sort of all rows in one task."""
    ranged = store(rows.select("row_id").repartitionByRange("row_id").withColumn("part", F.spark_partition_id()), "row-order")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part] = at
        at += sizes[part]
    wanted = [(part, p - starts[part]) for part in starts for p in set(positions) if starts[part] <= p < starts[part] + sizes[part]]
    place = F.row_number().over(Window.partitionBy("part").orderBy("row_id")) - 1
    spark = rows.sparkSession
    chosen = spark.createDataFrame(wanted, "part int, place int") if wanted else spark.createDataFrame([], "part int, place int")
    found = ranged.withColumn("place", place).join(F.broadcast(chosen), ["part", "place"]).join(rows, "row_id")
    return {starts[r["part"]] + r["place"]: r["value"] for r in found.select("part", "place", "value").collect()}


def calibrated(rows: DataFrame, n: int, cfg: MinHashConfig) -> LshParams:
    """The band size whose buckets hold closest to 0.4 pairs a row, over a sample of at most 300 rows."""
    if n < 50:
        return cfg.lsh
    positions = drawn_positions(n)
    values, seed = at_positions(rows, positions), grams.seeds(cfg)
    signed = np.stack([grams.signature(grams.gram_hashes(values[p] or ""), np.zeros(0, np.int32), seed) for p in positions])

    def off(size: int) -> float:
        sizes = Counter(grams.bucket_keys(signed, LshParams(size, cfg.signature // size)).ravel().tolist())
        return abs(sum(m * (m - 1) // 2 for m in sizes.values()) / len(positions) - 0.4)

    best = min((4, 5, 6, 8), key=off)
    more = 0.03 if best > cfg.lsh.band_size else 0.0
    return LshParams(best, cfg.signature // best, cfg.lsh.thr_short + more, cfg.lsh.thr_long + more)
