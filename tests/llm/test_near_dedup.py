import random
from collections import Counter

import numpy as np
import pyarrow as pa

from rowsieve.llm import near_dedup
from rowsieve.llm.near_dedup import JaccardConfig
from rowsieve.llm.simhash import SimHashConfig, fingerprint
from tests.llm.test_simhash import closed, index


def test_similar_texts(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    odds = [1 / (i + 3) for i in range(3000)]  # as in prose, some words are frequent
    base = [" ".join(rng.choices(vocabulary, odds, k=400)) for _ in range(60)]
    rows, n = [(i, t) for i, t in enumerate(base)], 1000
    for i, t in enumerate(base[:40]):
        for _ in range(3):
            words = t.split()
            for at in rng.sample(range(400), 5):  # a Jaccard index of about 0.88
                words[at] = rng.choices(vocabulary, odds)[0]
            rows.append((n, " ".join(words)))
            n += 1
    half = base[50].split()[:200] + base[51].split()[200:]
    rows.append((n, " ".join(half)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    assert set(range(60)) | {n} <= kept
    assert len(kept) == 61


def test_similar_groups_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(600)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, texts = words(40), [None, "", " ", "one", "ONE", "one two three four five", "one two three four five six"]
    for i in range(50):
        base = words(rng.randint(20, 200)) + common * (i % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(4):
            n, kind = len(base), rng.randrange(4)
            cut = rng.randint(1, n // 6)
            if kind == 0:  # changed words
                edit = list(base)
                for at in rng.sample(range(n), max(1, n // 60)):
                    edit[at] = rng.choice(vocabulary)
            elif kind == 1:
                edit = base[cut:]
            elif kind == 2:
                edit = base[: n // 2] + words(cut) + base[n // 2 :]
            else:
                edit = base + words(cut)
            texts.append(" ".join(edit))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (None, texts[12])]
    near = [[j for j, (_, b) in enumerate(rows) if index(a, b) >= 0.8] for _, a in rows]
    want = closed(len(rows), near)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    best = {}
    for (i, _), g in zip(rows, want):
        if i is not None:
            best[g] = min(best.get(g, i), i)
    # With few stars and no trees to speak of, nearly all must be found by prefixes; small pieces and blocks lose nothing.
    apart = SimHashConfig(shingle=1, radius=0, wide=4, wide_radius=0)
    for cfg in (JaccardConfig(), JaccardConfig(trees=apart, hashes=1, sample=20, frequent_from=2, star=3, block=2)):
        got = near_dedup.similar_groups(docs, cfg).collect()
        assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(i), best[g]) for (i, _), g in zip(rows, want))
    assert 100 < sum(len(n) > 1 for n in near) < len(rows)


def test_word_print_is_the_fingerprint_of_words():
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice("a b c dd ee the The of".split()) for _ in range(rng.randint(0, 30)))
        assert near_dedup.word_print(text.lower().encode().split()) == fingerprint(text, 1)


def test_sketches_of_similar_sets_are_near():
    rng = np.random.default_rng(4)
    far = lambda a, b: int(np.bitwise_count(near_dedup.sketch(np.sort(a)) ^ near_dedup.sketch(np.sort(b))).sum())
    sets = rng.integers(0, 2**64, (40, 900), dtype=np.uint64)
    assert all(far(s[:800], s[100:]) <= 60 for s in sets)  # an index of 0.78
    assert all(far(a, b) > 80 for a, b in zip(sets[:-1], sets[1:]))
    assert near_dedup.sketch(np.zeros(0, dtype=np.uint64)).tolist() == [0] * 4


def test_bitmaps_bound_what_differs_however_long_the_sets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 900, 1025, 5000, 40_000):
        for share in (1.0, 0.9, 0.7, 0.0):  # of each set that the other has, too
            both, own = rng.integers(0, 2**64, int(n * share), dtype=np.uint64), rng.integers(0, 2**64, (2, n - int(n * share)), dtype=np.uint64)
            sets = [np.unique(np.concatenate([both, x])) for x in own]
            a, b = map(near_dedup.bitmap, sets)
            far, differ = int(np.bitwise_count(a ^ b).sum()), len(np.setxor1d(*sets))
            assert far <= differ
            if share < 0.8 and 900 <= n <= 5000:
                assert far * 180 > 2 * n * 20  # ruled out
            narrow = np.bitwise_xor.reduce(a.reshape(-1, 16), 0)
            assert len(narrow) == 16 and (len(a) > 16 or (narrow == a).all())


def test_ends_of_different_widths_meet():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 1100, dtype=np.uint64)
    sets = [base[:1000], base, base[:1050], rng.integers(0, 2**64, 1100, dtype=np.uint64), base[200:], base[300:]]
    maps = [near_dedup.bitmap(np.sort(x)).view(np.int64) for x in sets]
    assert {len(m) for m in maps} == {16, 32}
    n = np.arange(len(sets))
    whole = pa.table({"node": n, "component": n, "size": [len(x) for x in sets], "side": n * 0 - 1, "map": pa.array(maps, type=pa.list_(pa.int64()))})
    # Arrow's slices start within their buffers.
    for first in (0, 1):
        cols, words = near_dedup._columns(whole.slice(first))
        i, j, far = near_dedup._near(cols, cols, words, 80)
        found = {(a + first, b + first) for a, b in zip(i.tolist(), j.tolist())}
        alike = {(a, b) for a in n[first:] for b in n[first:] if a != b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
        assert len(alike) >= 6 and alike <= found and not any(3 in p for p in found)


def test_shingles_of_the_same_nodes_are_one_key(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(3)]
    texts = [" ".join(b[:k] + [f"n{rng.randrange(10**6)}" for _ in range(10)]) for b in base for k in (300, 290, 280)] + [" ".join(base[0])] * 2
    rows = near_dedup.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    met = near_dedup._met(rows, len(texts), JaccardConfig()).collect()
    frequent, counts = near_dedup.frequent_shingles(rows, len(texts), JaccardConfig())
    have = {}
    for t in set(texts):
        grams = near_dedup.shingle_set(t)
        for g in near_dedup.prefix(grams, frequent, counts, 80).tolist():
            have.setdefault(g, set()).add(int(np.int64(np.uint64(near_dedup._name(grams)))))
    want = Counter(frozenset(x) for x in have.values() if len(x) > 1)
    got = {}
    for r in met:
        got.setdefault((r.key, r.n), set()).add(r.node)
    assert {frozenset(x): n for (_, n), x in got.items()} == want and len(got) == len(want) < sum(want.values())


def test_clashing_columns_and_odd_rows(spark):
    rows = [(1, "a b c", "x", "y"), (2, "A b  c", "p", None), (None, "a b c", "q", "z"), (None, None, "n", "n"), (7, "", "e", "e"), (7, "", "e", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, `c1` string").select("row", "text", "c1", "doc_id")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [("e", "", "e", 7), ("x", "a b c", "y", 1)]


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for _ in range(700):
        words = list(base)
        for at in rng.sample(range(300), 5):
            words[at] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    near = [[j for j, b in enumerate(texts) if index(a, b) >= 0.8] for a in texts[:60]]
    assert min(map(len, near)) < 600  # not all are linked to one another
    docs = spark.createDataFrame(list(enumerate([" ".join(base), *texts, "nothing like it at all"])), "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == [0, 701]
