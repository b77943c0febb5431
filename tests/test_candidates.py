import numpy as np
import pytest

from rowsieve.config import LshParams, MinHashConfig
from rowsieve.errors import BatchTooLargeError
from rowsieve.functions import grams
from rowsieve.functions.javarandom import JavaRandom
from rowsieve.operators import candidates

#: Variants of one entry stand together; the others are alone.
SPELLINGS = [
    ["wren & daughters | 14 quay road | dunmore", "daughters wren | 14 quay road | dunmore", "wren and daughters | quay road 14"],
    ["northern lights bakery | fjord lane 3", "bakery northern lights | fjord lane 3b", "northern light bakery"],
    ["куница лесная | берег 7", "лесная куница | берег 7"],
    ["0147 555 800", "0147-555-800"],
]
ALONE = ["", "slate", "quince jelly at half price", "北极光面包店", "tax office, window nine"]


def pairs_of(spark, values, cfg=MinHashConfig()):
    df = spark.createDataFrame(list(enumerate(values)), "row_id bigint, value string")
    return {(r.first, r.second) for r in candidates.candidate_pairs(df, cfg).collect()}


def test_spellings_meet_and_others_do_not(spark):
    values, group = [], []
    for i, same in enumerate([*SPELLINGS, *[[v] for v in ALONE]]):
        values += same
        group += [i] * len(same)
    found = pairs_of(spark, values)
    wanted = {(i, j) for j, g in enumerate(group) for i in range(j) if group[i] == g}
    assert found <= wanted and len(found) >= len(wanted) - 1, wanted - found
    assert pairs_of(spark, ALONE) == set()


def test_generator():
    random = JavaRandom(42)
    assert [random.next_int() for _ in range(4)] == [-1170105035, 234785527, -1360544799, 205897768]
    assert candidates.drawn_positions(100)[:4] == [82, 50, 76, 89] and len(candidates.drawn_positions(100)) == 50
    assert len(candidates.drawn_positions(10_000)) == 300


def test_signatures_against_plain_arithmetic():
    def mix(x):
        x &= 0xFFFFFFFF
        x = (x ^ x >> 16) * 0x7FEB352D & 0xFFFFFFFF
        x = (x ^ x >> 15) * 0x846CA68B & 0xFFFFFFFF
        return x ^ x >> 16

    sign = lambda x: x - (1 << 32) if x >> 31 else x
    text = " ab 🙂é  x "
    hashes = {mix((ord(a) * 31 + ord(b)) * 31 + ord(c)) for a, b, c in zip(text, text[1:], text[2:])}
    got = grams.gram_hashes("ab 🙂é |x")
    assert sorted(map(sign, hashes)) == got.tolist()
    seeds = grams.seeds()
    want = [min(sign(mix(h ^ int(s))) for h in hashes) for s in seeds]
    assert grams.signature(got, np.zeros(0, np.int32), seeds).tolist() == want
    key = grams.bucket_keys(np.array([want], dtype=np.int32), LshParams())[0, 1]
    assert key == ((want[4] << 32) ^ (want[5] & 0xFFFFFFFF))
    assert set(grams.signature(np.zeros(0, np.int32), np.zeros(0, np.int32), seeds)) == {2**31 - 1}


def test_pairs_do_not_depend_on_partitions(spark):
    values = [f"{a} | {b} street {i % 9}" for i, (a, b) in enumerate(zip(E * 6, A * 4))]
    df = spark.createDataFrame(list(enumerate(values)), "row_id bigint, value string")
    run = lambda d: sorted((r.first, r.second) for r in candidates.candidate_pairs(d).collect())
    first = run(df.repartition(1))
    assert first == run(df.repartition(7)) and all(a < b for a, b in first)
    counts = np.bincount(np.array(first).ravel())
    assert counts.max() <= 30


def test_limits(spark):
    with pytest.raises(BatchTooLargeError):
        pairs_of(spark, C, MinHashConfig(max_batch=5))
    assert pairs_of(spark, []) == set()
    assert pairs_of(spark, [None, "", "x"]) == set()
    cfg = MinHashConfig()
    frequent = spark.createDataFrame([(i, f"common words {i * 7919}") for i in range(400)], "row_id bigint, value string")
    assert len(candidates.noisy_grams(frequent, 400, cfg)) > 5 and len(candidates.noisy_grams(frequent, 199, cfg)) == 0
    assert candidates.calibrated(frequent, 400, cfg).band_size in (4, 5, 6, 8)


def test_large_buckets_make_linear_pairs(spark):
    rows = spark.createDataFrame([(i, [0] * 8, [1, 2 + i % 2, 100 + i]) for i in range(200)], "row_id bigint, signature array<int>, keys array<bigint>")
    assert candidates.bucket_pairs(rows).count() == 200 * 199 // 2
    few = {(r.a, r.b) for r in candidates.bucket_pairs(rows, 5).collect()}
    # In order of row_id here: the five behind in the bucket of all, and in that of every other row.
    assert few == {(i, i + d) for i in range(200) for d in (1, 2, 3, 4, 5, 6, 8, 10) if i + d < 200}
    assert {(r.a, r.b) for r in candidates.bucket_pairs(rows, 300).collect()} == {(r.a, r.b) for r in candidates.bucket_pairs(rows).collect()}


@pytest.mark.parametrize("block", [1024, 50])
def test_whole_large_buckets_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(candidates, "BLOCK", block)
    # All trigrams of most rows are frequent, so that they share a bucket of far over 31 rows; some have words of their own.
    kinds, stuff, ends = ["red", "large", "small ring"], ["widget", "bolt of steel steel", "plate"], ["economy", "promo", "standard polished brass", ""]
    values = [f"{k} {s} | brand {n} | {e}" for k in kinds for s in stuff for n in range(8) for e in ends] + [f"{v} {i} {i * 7919 % 1000003}" for i, v in enumerate(E)]
    rows = spark.createDataFrame(list(enumerate(values)), "row_id bigint, value string")
    cfg = MinHashConfig(calibrate=False)
    made = candidates.features(rows, candidates.noisy_grams(rows, len(values), cfg), cfg)
    biggest = made.selectExpr("explode(keys) AS key").groupBy("key").count().agg({"count": "max"}).collect()[0][0]
    assert biggest > 100 and biggest > candidates.WHOLE
    alike = candidates.similar_pairs(made, candidates.bucket_pairs(made), cfg).collect()
    near = {}
    for r in alike:
        near.setdefault(r.first, []).append((-r.jaccard, r.second))
        near.setdefault(r.second, []).append((-r.jaccard, r.first))
    best = {i: {j for _, j in sorted(found)[:30]} for i, found in near.items()}
    want = {(r.first, r.second): (r.left, r.right, r.jaccard) for r in alike if r.second in best[r.first] and r.first in best[r.second]}
    assert len(alike) > len(want) > 1000
    assert {(r.first, r.second): (r.left, r.right, r.jaccard) for r in candidates.candidate_pairs(rows, cfg).collect()} == want
