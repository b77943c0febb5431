import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowsieve.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), len(lines)


def test_numbers_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", " ", " ", "\n", "é", "#", "\x0b", "\x85", "ab c d e f "]) for _ in range(rng.randint(0, 80)))
        assert quality.measure_text(text) == plainly(text), repr(text)
    assert quality.measure_text(None) == (0,) * 6
    words = [f"w{rng.randint(0, 20000)}".encode() for _ in range(30000)]
    words += words[100:300]  # many distinct words: keys are numbered anew
    assert quality.repeated_words(words) == plainly(b" ".join(words).decode())[4]


def test_upper_bound():
    for bad, n, alpha in [(0, 100, 0.05), (3, 50, 0.01), (10, 400, 1e-4)]:
        p = quality.upper_bound(bad, n, alpha)
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad + 1)) == pytest.approx(alpha, rel=1e-6)
    assert quality.upper_bound(5, 5, 0.1) == 1.0
    assert 0.01 < quality.upper_bound(10_000, 1_000_000, 1e-3) < 0.0104


def test_cutoffs_and_verdicts(spark):
    clean = "the quick brown fox jumps over a lazy dog and runs far away home {}"
    junk = "buy### now*** the$$$ best### deal&&& you%%% ever*** had### in$$$ your*** life{}"
    rows = [(i, clean.format(i), "en") for i in range(3000)] + [(i, junk.format(i), "en") for i in range(3000, 3300)]
    rows += [(4000, None, "en"), (4001, "", None), (4002, junk.format("x"), None), (4003, "word " * 40, "en"), (4003, "word " * 40, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("n_words", __import__("pyspark").sql.functions.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(2500)] + [(i, 0) for i in range(3000, 3200)] + [(5, None), (9999, 1)], "doc_id bigint, quality int")
    measured = quality.measure(docs, ("doc_id", "lang"))
    cutoffs = quality.calibrate(measured, labels, "lang")
    [cut] = cutoffs.collect()
    assert cut.stratum == "en" and cut.symbols is not None and cut.repeats is None
    got = {}
    for r in quality.judge(measured, cutoffs.cache(), "lang").collect():
        got.setdefault(r.doc_id, []).append((r.base_failed, r.kept))
    assert all(got[i] == [(False, True)] for i in range(3000)) and all(got[i] == [(False, False)] for i in range(3000, 3300))
    assert got[4000] == got[4001] == [(True, False)] and got[4002] == [(False, True)] and got[4003] == [(True, False)] * 2
    none = quality.calibrate(measured, labels.limit(0), "lang")
    assert quality.judge(measured, none, "lang").where("kept").count() == 3301
    empty = quality.measure(docs.limit(0), ("doc_id", "lang"))
    assert quality.judge(empty, quality.calibrate(empty, labels, "lang"), "lang").count() == 0


def test_repeated_rows_and_labels_count_once(spark):
    junk = "buy### now*** the$$$ best### deal&&& you%%% ever*** had### in$$$ your*** life{}"
    docs = spark.createDataFrame([(i, junk.format(i), "en") for i in range(40)] * 50, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] * 20 + [(0, 1), (None, 0)], "doc_id bigint, quality int")
    measured = quality.measure(docs, ("doc_id", "lang"))
    held = quality.labelled(measured, labels, "lang").groupBy("doc_id", "quality").count().collect()
    assert sorted((r.doc_id, r.quality, r["count"]) for r in held) == [(i, 0, 1) for i in range(40)]


def test_false_rejections_on_labels_left_out_of_the_fit(spark):
    """Cutoffs are learnt on one half of the labels; on the other half the rules reject few good documents."""
    rng = random.Random(5)
    symbols = ["", "", "", "", "", "", "", "#", "#*$", "&%|<>#*$&%"]

    def text(i, good):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(12, 40))]
        noise = symbols if rng.random() < (0.002 if good else 0.9) else [""]
        return " ".join(w + rng.choice(noise) for w in words) + f" {i}"

    rows = [(i, text(i, i % 3 > 0), rng.choice(["en", "de", None]), int(i % 3 > 0)) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    measured = quality.measure(docs, ("doc_id", "lang"))
    cutoffs = quality.calibrate(measured, docs.where("doc_id % 2 = 0"), "lang").cache()
    assert cutoffs.where("symbols is not null").count() == 3
    held = quality.judge(measured, cutoffs, "lang").join(docs.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id")
    wrong = F.avg((F.size("failed_rules") > 0).cast("int"))
    for r in held.where("not base_failed").groupBy("lang", "quality").agg(wrong.alias("rejected")).collect():
        assert r.rejected <= 0.05 if r.quality else r.rejected > 0.3, r
