"""Exact top-k search by a Voronoi kNN join.

Vectors are scored by inner product after scaling each component to an integer. Data and queries fall into the Voronoi cells of
pivots, which come from a bounded sample and only shape the work, never the result. A cell's summary is its count, its
radius (largest distance to the pivot) and its largest norm.

1. Each query is solved in the cell whose pivot scores highest with it; its k-th score there is a floor.
2. For a query q and a cell with pivot p, radius r and norm n no score is above q.p + |q| r (Cauchy-Schwarz), nor above
   (|q|^2 + n^2 - max(0, |q - p| - r)^2) / 2 (the triangle inequality). The query is replicated only to cells whose bound
   reaches its floor, and is solved there locally; scores below the floor are dropped at once.
3. The k best of what remains are merged.

Cells are dealt into blocks by a hash of the identifier, so a cell that holds a very common vector is many blocks and a
task holds one block. Queries, not data, are replicated: they are the smaller side.

Nulls and edge cases: vectors that are null or hold a null or non-finite component, and rows without an identifier,
take no part; a query never meets rows of its own identifier; vectors of different lengths meet as if padded with
zeros; ties go to the smaller identifier; repeated rows are candidates of their own; fewer than k candidates give fewer
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsieve.llm._common import materialize, read_table
from rowsieve.shipping import ship


@dataclass(frozen=True)
class SearchConfig:
    k: int = 5
    scale: int = 256
    pivots: int = 64
    #: Vectors that the pivots are fitted on.
    sample: int = 4096
    #: Rows of a block: n / 1024 within these limits.
    least_block: int = 512
    most_block: int = 65_536
    seed: int = 42


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max(initial=0)) if width is None else width
    values = column.flatten().to_numpy()
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1])[None] < lengths[:, None]] = values
    return out


def vectors(table: DataFrame, vector: Column, key: Column, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """vec_id and v (array<double> of whole numbers) of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(key.isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * cfg.scale).cast("double"))
    return rows.select(key.cast("long").alias("vec_id"), scaled.alias("v"))


def fit_pivots(sample: np.ndarray, cfg: SearchConfig) -> np.ndarray:
    """Some rounds of k-means over the sample."""
    rng = np.random.default_rng(cfg.seed)
    distinct = np.unique(sample, axis=0)
    pivots = distinct[rng.permutation(len(distinct))[: cfg.pivots]]
    for _ in range(5):
        nearest = _distances(distinct, pivots).argmin(1)
        pivots = np.stack([distinct[nearest == i].mean(0) if (nearest == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles while their sums stay below 2 ** 53, else in integers."""
    width = min(q.shape[1], x.shape[1])
    q, x = q[:, :width], x[:, :width]
    if width * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _solve(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best of each block for each query (query_id, floor, q, cell, block) sent to it."""

    def local(asked: pa.Table, data: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked.num_rows and data.num_rows:
            x, ids = _matrix(data.column("v")), data.column("vec_id").to_numpy()
            query_ids, floors = asked.column("query_id").to_numpy(), asked.column("floor").to_numpy()
            rows = _matrix(asked.column("q"))
            for at in range(0, len(rows), 512):
                scores = _scores(rows[at : at + 512], x)
                for i, row in enumerate(scores, at):
                    able = np.flatnonzero((row >= floors[i]) & (ids != query_ids[i]))
                    top = able[best(row[able], ids[able], k)]
                    out[0] += [query_ids[i]] * len(top)
                    out[1] += ids[top].tolist()
                    out[2] += row[top].tolist()
        return pa.table([pa.array(c, type=pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    pairs = queries.groupBy("cell", "block").cogroup(blocks.groupBy("cell", "block"))
    return pairs.applyInArrow(local, "query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(data: DataFrame, is_query: Column, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, rank, vec_id, score. data has vec_id and v; the rows for which is_query holds are the queries as well."""
    spark = data.sparkSession
    ship(spark)
    data = materialize(data, "topk-vectors")
    n, order = data.count(), F.xxhash64(F.lit(cfg.seed), "vec_id")
    share = min(1.0, cfg.sample / max(1, n)) * 2.0**64 - 2.0**63
    sample = [r["v"] for r in data.where(order <= F.lit(share)).limit(2 * cfg.sample).select("v").collect()]
    if not sample:  # as good as any pivot
        sample = [[0.0]]
    width = max(map(len, sample))
    pivots = fit_pivots(np.array([[*v, *[0.0] * (width - len(v))] for v in sample]), cfg)
    block_size = min(max(n // 1024, cfg.least_block), cfg.most_block)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            common = np.pad(pivots, ((0, 0), (0, x.shape[1] - width))) if x.shape[1] > width else pivots
            far = _distances(x, common)
            cell = far.argmin(1)
            added = [cell.astype(np.int32), far[np.arange(len(x)), cell], np.sqrt((x * x).sum(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=["vec_id", "v", "cell", "far", "norm"])

    celled = materialize(data.mapInArrow(assign, "vec_id bigint, v array<double>, cell int, far double, norm double"), "topk-cells")
    # One row a pivot.
    summary = {r["cell"]: r for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    cells = np.array(sorted(summary), dtype=np.int64)
    counts, radius, norms = (np.array([summary[c][k] for c in cells], dtype=np.float64) for k in ("n", "far", "norm"))
    parts = np.maximum(1, np.ceil(counts / block_size)).astype(np.int64)
    n_blocks = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(cells, parts) for x in pair]), F.col("cell")) if len(cells) else F.lit(1)
    blocks = celled.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), n_blocks).cast("int").alias("block"))

    def send(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, floors = _matrix(batch.column("q"), width), batch.column("floor").to_numpy()
                common = np.pad(pivots, ((0, 0), (0, q.shape[1] - width))) if q.shape[1] > width else pivots
                common = common[cells]
                with_pivot = q @ common.T
                if home:
                    wanted = np.zeros(with_pivot.shape, dtype=bool)
                    wanted[np.arange(len(q)), with_pivot.argmax(1)] = True
                else:
                    size = np.sqrt((q * q).sum(1))[:, None]
                    gap = np.maximum(_distances(q, common) - radius[None], 0)
                    bound = np.minimum(with_pivot + size * radius[None], (size**2 + norms[None] ** 2 - gap**2) / 2)
                    bound += 1e-9 * (np.abs(bound) + size**2 + norms[None] ** 2) + 1e-6  # rounding
                    wanted = bound >= floors[:, None]
                    wanted[np.arange(len(q)), with_pivot.argmax(1)] = False  # solved already
                rows, where = np.nonzero(wanted)
                at = np.repeat(rows, parts[where])
                cell = np.repeat(cells[where], parts[where])
                block = np.concatenate([[0], *[np.arange(p) for p in parts[where]]])[1:]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), *[c.take(pa.array(at)) for c in batch.columns]], names=["cell", "block", "query_id", "floor", "q"])

        return run

    schema = "cell int, block int, query_id bigint, floor bigint, q array<double>"
    asked = data.where(is_query).select(F.col("vec_id").alias("query_id"), F.lit(-(2**63)).cast("long").alias("floor"), F.col("v").alias("q"))
    asked = materialize(asked.dropDuplicates(["query_id"]), "topk-queries")
    if not len(cells):
        return asked.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    first = materialize(_ranked(_solve(asked.mapInArrow(send(True), schema), blocks, cfg.k), cfg.k), "topk-first")
    floors = first.where(F.col("rank") == cfg.k).select(F.col("query_id").alias("id"), F.col("score"))
    known = asked.join(floors, asked["query_id"] == floors["id"], "left").select("query_id", F.coalesce("score", "floor").alias("floor"), "q")
    rest = _solve(known.mapInArrow(send(False), schema), blocks, cfg.k)
    return _ranked(first.drop("rank").unionByName(rest), cfg.k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return search(vectors(table, F.col("embedding"), F.col("vec_id")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
    FROM whole q JOIN whole x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
