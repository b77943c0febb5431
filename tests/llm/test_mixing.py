import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowsieve.llm import mixing
from rowsieve.llm.mixing import MixConfig


def targets(sizes):
    """By resharing the excess, step by step."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    got, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return got | share
        for s in over:
            got[s] = 3.0 * sizes[s]
            rest -= got[s]
            open_.remove(s)
    return got


def documents(rng, n):
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None, "tiny", "empty"])
        words = rng.randint(1, 40) if source not in ("tiny", "empty") else (rng.random() < 0.05 if source == "tiny" else 0)
        text = None if rng.random() < 0.02 else " ".join(["w"] * words) + rng.choice(["", "\n", "\xa0x"])
        rows.append((i, text if source != "empty" else rng.choice([None, " "]), source, "clash"))
    return rows


@pytest.mark.parametrize("blocks", [4096, 64, 3])
def test_targets_and_draws(spark, tmp_path, blocks):
    rows = documents(random.Random(blocks), 1500)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string").repartition(3)
    sized = mixing.measure(docs)
    plan = mixing.plan_mix(sized, MixConfig(blocks=blocks, depth=3))
    got = plan.decide(sized).collect()
    assert len(got) == len(rows)
    per, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        per[r[2]] += size[r[0]]
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 3 and len(r.shards) == r.copies
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    want = targets(per)
    for r in got:
        assert r.source_size == per[r.source] and r.target == pytest.approx(want[r.source])
    for s in per:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1, s
    again = plan.decide(sized).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    other = mixing.plan_mix(mixing.measure(docs.repartition(7)), MixConfig(blocks=blocks, depth=3)).decide(mixing.measure(docs)).collect()
    assert sorted(map(str, other)) == sorted(map(str, got))


def test_the_tree_splits_quotas_evenly(spark):
    units = spark.range(512).select(F.when(F.col("id") < 300, "a").otherwise("b").alias("source"), F.col("id").alias("block"), F.lit(1).alias("copy"), F.xxhash64("id").alias("draw_order"))
    got = mixing.split_quotas(units, MixConfig(depth=3)).collect()
    assert len({(r.source, r.block) for r in got}) == 512
    assert set(Counter(r.shard for r in got).values()) == {64}
    share = defaultdict(Counter)
    for r in got:
        share[r.shard][r.source] += 1
    assert all(20 < c["a"] < 55 for c in share.values())  # mean 37.5


def test_rows_of_the_mix(spark, tmp_path):
    rows = documents(random.Random(5), 300) + [(7, "again and again", "a", "x"), (None, "no key", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_shard string")
    plain = mixing.mix(docs, MixConfig(depth=2), places=False)
    assert plain.columns == docs.columns
    counted = Counter(map(str, plain.collect()))
    assert max(counted.values()) <= 3 and set(counted) <= set(map(str, docs.collect()))
    mixing.write_shards(mixing.mix(docs.drop("mix_shard"), MixConfig(depth=2)), f"{tmp_path}/mix")
    assert spark.read.parquet(f"{tmp_path}/mix").count() == sum(counted.values())
    assert mixing.mix(docs.limit(0), places=False).count() == 0


def test_large_lookups_agree(spark, monkeypatch):
    from rowsieve.llm import _common

    docs = spark.createDataFrame(documents(random.Random(6), 200), "doc_id bigint, text string, source string, x string")
    run = lambda: sorted(map(str, mixing.mix(docs).collect()))
    small = run()
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    assert run() == small
