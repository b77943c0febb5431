import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsieve.llm import topk
from rowsieve.llm.topk import SearchConfig


def plainly(rows, every=50, k=5):
    able = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=np.float64)).all()]
    out, width = [], max((len(v) for _, v in able), default=0)
    able = [(i, np.pad(v, (0, width - len(v)))) for i, v in able]
    for q, v in able:
        if q % every == 0:
            scores = sorted((-int(v @ x), i) for i, x in able if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("clusters", [0, 6])
def test_against_brute_force(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(0, 1, (clusters or 1, 8)) * bool(clusters)
    x = (centres[rng.integers(0, clusters or 1, 700)] + rng.normal(0, 0.2, (700, 8))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[50][1]) for i in range(120)]  # a common vector, ties
    rows += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, rows[3][1]), (2200, [0.5, 0.25]), (2250, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, v string, block int")
    cfg = SearchConfig(pivots=12, least_block=40)
    got = topk.search(topk.vectors(table, F.col("embedding"), F.col("vec_id"), cfg), F.col("vec_id") % 50 == 0, cfg).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plainly(rows)


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id bigint, embedding array<double>")
    run = lambda t: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(topk.vectors(t, F.col("embedding"), F.col("vec_id")), F.col("vec_id") % 50 == 0).collect())
    assert run(table) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert run(table.limit(0)) == []
    big = spark.createDataFrame([(0, [2.0**20] * 3), (1, [2.0**20, 1.0, 0.0]), (2, [2.0**20, 0.99999, 0.0])], "vec_id bigint, embedding array<double>")
    assert run(big) == plainly([(r[0], list(r[1])) for r in big.collect()])
