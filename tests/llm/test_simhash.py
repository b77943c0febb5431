import random

import numpy as np
import pytest
import xxhash

from rowsieve.llm import simhash
from rowsieve.llm.simhash import SimHashConfig


def plainly(text):
    words = [w.lower() for w in (text or "").encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(n, near):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for i in range(n):
            for j in near[i]:
                label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "É", " ", "\n", "\x85", "word "]) for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text) == plainly(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def clustered(rng, n):
    """Random fingerprints, chains and tight groups."""
    fps = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(n // 20):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fp ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(fp)
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << i ^ 1 << j for i in range(20) for j in range(i)}
    return np.array(sorted(fps), dtype=np.uint64)


@pytest.mark.parametrize("seed", range(3))
def test_trees_lose_no_link(seed):
    rng = random.Random(seed)
    fps = clustered(rng, 1500)
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 2).tolist() for f in fps]
    want = closed(len(fps), near)
    tree = simhash.TopTree(fps[:: 7], 4, SimHashConfig())
    at, shard = tree.route(fps)
    edges = [[] for _ in fps]
    for s in np.unique(shard):
        rows = at[shard == s]
        assert len(set(rows)) == len(rows)
        found = simhash.solve(fps[rows], fps[rows, None], SimHashConfig(leaf=8, seed=1))
        assert len(found) < len(rows)
        for a, b in found:
            assert int(fps[rows[a]] ^ fps[rows[b]]).bit_count() <= 2
            edges[rows[a]].append(rows[b])
    assert closed(len(fps), edges) == want
    assert len(at) < 8 * len(fps)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 230)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(3, 3)]
    near = [[] for _ in range(1400)]
    for a, b in pairs:
        near[a].append(b)
    want = closed(1400, near)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: want[i] for i in touched}
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 250))) for _ in range(150)]
    for t in list(texts[:80]):
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), t]
    texts += [None, "", "  ", "one", "ONE", "long " * 30000]
    rows = [(i * 3 + 1, t, f"x{i}") for i, t in enumerate(texts)] + [(1, texts[5], "again"), (None, "nothing like it", "null key")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(5)
    got = simhash.near_duplicates(docs, SimHashConfig(shard_size=16, leaf=8)).collect()
    fps = [plainly(t) for _, t, _ in rows]
    ids = [r[0] for r in rows]
    near = [[j for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 2] for i in range(len(rows))]
    label, best = closed(len(rows), near), {}
    for i, g in enumerate(label):
        if ids[i] is not None:
            best[g] = min(best.get(g, ids[i]), ids[i])
    want = sorted((str(ids[i]), fps[i], str(best.get(label[i]))) for i in range(len(rows)))
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [4, 64, 5000])
def test_wide_fingerprints_decide(leaf):
    rng, cfg = random.Random(leaf), SimHashConfig(radius=5, wide=2, wide_radius=20, leaf=leaf)
    rows = []
    for _ in range(40):
        fp, wide = rng.getrandbits(64), [rng.getrandbits(64) for _ in range(2)]
        for _ in range(rng.choice([1, 3, 60])):
            flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, n)))
            rows.append((flip(fp, 3), flip(wide[0], 8), flip(wide[1], 8)))
    all_ = np.array(rows, dtype=np.uint64)
    far = np.bitwise_count(all_[:, None] ^ all_[None]).astype(int)
    near = [np.flatnonzero((far[i, :, 0] <= 5) & (far[i, :, 1:].sum(1) <= 20)).tolist() for i in range(len(rows))]
    edges = [[] for _ in rows]
    for a, b in simhash.solve(all_[:, 0], all_[:, 1:], cfg):
        assert b in near[a]
        edges[a].append(b)
    assert closed(len(rows), edges) == closed(len(rows), near)


def test_large_groups_of_near_copies(spark):
    rng, centre = random.Random(3), 0x0123456789ABCDEF
    fps = {centre}
    while len(fps) < 1200:  # a walk of short steps around one place
        fps.add(rng.choice(tuple(fps)) ^ (1 << rng.randrange(64) | 1 << rng.randrange(64)) if rng.random() < 0.3 else centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    values = np.array(sorted(fps), dtype=np.uint64)
    nodes = spark.createDataFrame([(int(v), int(v)) for v in values.view(np.int64)], "fp bigint, node bigint")
    cfg = SimHashConfig(shard_size=32, leaf=16)
    routed = simhash.shards(nodes, cfg).groupBy("shard").count().collect()
    whole = simhash.shards(nodes, SimHashConfig(shard_size=32, leaf=16, rounds=1)).groupBy("shard").count().collect()
    assert max(r["count"] for r in routed) < max(r["count"] for r in whole)
    near = [np.flatnonzero(np.bitwise_count(values ^ f) <= 2).tolist() for f in values]
    want, at = closed(len(values), near), {int(v): i for i, v in enumerate(values.view(np.int64))}
    edges = [[] for _ in values]
    for r in simhash.links(nodes, cfg).collect():
        edges[at[r.a]].append(at[r.b])
    assert closed(len(values), edges) == want


def index(a, b):
    """The Jaccard index of five-word shingles."""
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    union = len(sets[0] | sets[1])
    return len(sets[0] & sets[1]) / union if union else 1.0
