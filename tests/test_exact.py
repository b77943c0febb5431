import random
import time

import pytest
from pyspark.sql import functions as F

from rowsieve.functions import keys
from rowsieve.operators import components, exact, lookup
from rowsieve.operators.components import connected_components

ROWS = [
    "grey heron", "heron grey", "grey   heron", "heron, grey.", "greyheron", "quay road 9 dunmore", "dunmore 9 quay road", "9, quay road - dunmore",
    "box@example.net", "box@example.net", "7788", "lot 7788", "2031-05-06", "2031 05 06", "20310506", "kx-778899", "kx 778899", "KX778899", "slate", "北极", "sand dune",
]


def groups_of(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "row_id bigint, value string")
    return exact.exact_groups(df)


def test_golden_groups(spark):
    groups = groups_of(spark, ROWS).cache()
    assert sorted(r.members for r in exact.members(groups).collect()) == [[0, 1, 2, 3], [5, 6, 7], [8, 9], [12, 13], [15, 16]]
    assert sorted(r.row_id for r in exact.remaining(groups).collect()) == [4, 10, 11, 14, 17, 18, 19, 20]
    pairs = {(r.first, r.second) for r in exact.exact_pairs(groups).collect()}
    assert len(pairs) == 6 + 3 + 1 + 1 + 1 and all(a < b for a, b in pairs)


def test_nulls_and_symbols(spark):
    groups = groups_of(spark, [None, "", "[null]", "content", "", "@#&", "..."]).cache()
    assert [r.members for r in exact.members(groups).collect()] == [[0, 1, 4, 5, 6]]
    assert groups_of(spark, []).count() == 0


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_groups_of_many_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    values = [f"duplicate_{i // 20}" if i % 5 == 0 else f"unique_{i}" for i in range(10_000)]
    began = time.time()
    groups = groups_of(spark, values).cache()
    assert exact.members(groups).count() == 500 and exact.remaining(groups).count() == 8000
    assert time.time() - began < 20


def test_key_details(spark):
    rows = [("#abc",), ("abc.",), ("--",), ("",), ("b | a | b",), ("a||",), ("1985",), ("d41d8cd98f00b204e9800998ecf8427e",), ("site.org/x",), ("+1 / 2 / 3 / 4 / 5 / 6 / 7 / 8 / 9 / 0",), ("abc",)]
    v = F.col("v")
    got = spark.createDataFrame(rows, "v string").select(keys.canonical_tokens(v), keys.alnum(v), keys.detect_type(v)).collect()
    assert [r[0] for r in got] == [["", "abc"], ["abc"], [], [""], ["a", "b", "b"], ["a"], ["1985"], [rows[7][0]], ["org", "site", "x"], ["", *"0123456789"], ["abc"]]
    assert [r[2] for r in got] == ["PLAIN", "PLAIN", "PLAIN", "PLAIN", "PLAIN", "PLAIN", "ISBN", "HASH", "URL", "PHONE", "PLAIN"]


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, i) for i in range(501, 560)]
    label = {x: x for p in pairs for x in p}
    for _ in pairs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {x: label[x] for x in touched} and len(got) == len(touched)


def test_large_tables_are_not_broadcast_by_estimate(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 100)
    run, plans = components.store, []

    def store(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return run(df, tag)

    monkeypatch.setattr(components, "store", store)
    edges = spark.range(5000).selectExpr("id AS a", "id + 1 AS b").where("a % 7 <> 0")
    got = connected_components(edges).collect()
    # 7 i + 1 to 7 i + 7 are chained; small tables, by their files, that have more rows than may be broadcast.
    assert {r.node: r.component for r in got} == {n: n - (n - 1) % 7 for n in range(1, 5001)} and len(got) == 5000
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not any("BroadcastHashJoin" in p for p in plans)


def test_long_runs_take_linear_time(spark):
    v, n = F.col("v"), 200_000
    rows = [("-" * n + "a" + "-" * n,), ("|" * n + "a" + " |" * n,), (" " * n + "a" + " " * n + "b",), ("a" + " | " * n + "b",)]
    began = time.time()
    got = spark.createDataFrame(rows, "v string").select(keys.canonical_tokens(keys.original(v)).alias("t")).collect()
    assert time.time() - began < 20
    assert [len(r.t) for r in got] == [2, n + 1, 2, n + 1]
