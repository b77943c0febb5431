"""SimHash near-duplicates through vantage-point trees over Hamming distance.

A text's fingerprint has a bit set where over half of its word shingles' hashes have it. Documents with one
fingerprint are a node, named by their smallest key; nodes are linked where their fingerprints differ in at most
``radius`` bits. The links are found exactly:

* A top tree of vantage points, built from a bounded sample of fingerprints, sends every fingerprint to its leaf shard:
  at each tree node, inside if its distance to the vantage point is at most the split, else outside.
* By the triangle inequality a pair that the split separates has its inner member within radius of the split. So
  a fingerprint with a distance in (split - radius, split] goes outside as well, as a guest: every linked pair meets in a
  shard, and nearly all others never do.
* The tree ends where guests would make more than ``spread`` copies of a row. Shards that are then too large, all of them, are
  parted by blocks of bits, of which linked fingerprints share one: radius + 1 copies of a row at any size.
* A shard is solved by the same recursion down to small leaves, which are compared all against all; a group of near
  copies that no vantage point parts is solved by leaders. It leaves behind a spanning forest: at most one link a row,
  however many pairs a group has.

Components come from the forest by label propagation over written tables. The sample only shapes the tree; with any tree
the links are the same. The top tree has at most 2 ** ``max_depth`` leaves, whatever the input.

Nulls and edge cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a
shingle form one shingle; rows of one key and different texts join all that they resemble; null keys form nodes of
their own only with other null keys' fingerprints, and name a component only if no key else is in it; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm._common import lookup, map_texts, materialize, read_table
from rowsieve.shipping import ship


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 3
    #: Most bits in which linked fingerprints differ.
    radius: int = 2
    #: Longer fingerprints, of wide * 64 bits of other shingles, that must be near as well; 0: none.
    wide: int = 0
    wide_shingle: int = 5
    wide_radius: int = 42
    #: Distinct fingerprints a shard should hold.
    shard_size: int = 2048
    max_depth: int = 14
    #: Fingerprints that shape the top tree.
    sample: int = 40_000
    #: Copies of a row, guests included, that the top tree may make of the sample's rows.
    spread: float = 2.0
    #: Rounds of routing: the first is by the top tree, the second parts what came out too large.
    rounds: int = 2
    #: Shards are split down to leaves of this size.
    leaf: int = 256
    seed: int = 42


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Odd multipliers that make more hashes of one.
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of so many words, blank-joined; of all words if they are fewer."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    columns = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        total = np.unpackbits(columns, axis=1).sum(0, dtype=np.int64)
    else:  # how often each byte stands in each place tells how often each bit is set
        total = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space only


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint, unsigned."""
    return majority(shingle_hashes(words_of(text), shingle))


def fingerprints_of(text: str | None, cfg: SimHashConfig) -> list[int]:
    words = words_of(text)
    found = [majority(shingle_hashes(words, cfg.shingle))]
    if cfg.wide:
        hashes = shingle_hashes(words, cfg.wide_shingle)
        for odd in _ODD[: cfg.wide]:
            mixed = hashes * np.uint64(odd)
            found.append(majority((mixed ^ mixed >> np.uint64(29)) * np.uint64(_ODD[1])))
    return found


def fingerprints(docs: DataFrame, cfg: SimHashConfig = SimHashConfig(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long), w0, w1, ... (the wide one) and node, written to the shared
    folder. node names what a text's links depend on: fp, or a hash of all."""
    names = ["fp", *(f"w{i}" for i in range(cfg.wide))]

    def work(texts: list[str | None]) -> list[np.ndarray]:
        made = np.array([fingerprints_of(x, cfg) for x in texts], dtype=np.uint64).reshape(len(texts), len(names))
        return [made[:, i].view(np.int64) for i in range(len(names))]

    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    rows = map_texts(rows, "text", ("doc_id", "text_hash"), ", ".join(f"{c} bigint" for c in names), work)
    return materialize(rows.withColumn("node", F.xxhash64(*names) if cfg.wide else F.col("fp")), "simhash")


class TopTree:
    """Vantage points and splits in heap order; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int, cfg: SimHashConfig):
        self.depth, self.radius = depth, cfg.radius
        self.points, self.splits = np.zeros(1 << depth, dtype=np.uint64), np.full(1 << depth, 64, dtype=np.int64)
        rng = np.random.default_rng(cfg.seed)

        def build(node: int, rows: np.ndarray, level: int) -> None:
            if level == depth:
                return
            if len(rows):
                self.points[node] = rng.choice(rows)
                self.splits[node] = choose_split(np.bitwise_count(rows ^ self.points[node]).astype(np.int64), cfg.radius)
            inside = np.bitwise_count(rows ^ self.points[node]) <= self.splits[node]
            build(2 * node, rows[inside], level + 1)
            build(2 * node + 1, rows[~inside], level + 1)

        build(1, sample, 0)

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in rows and the shards that they go to."""
        at, node = np.arange(len(rows)), np.ones(len(rows), dtype=np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count(rows[at] ^ self.points[node]).astype(np.int64) - self.splits[node]
            guest = (far <= 0) & (far > -self.radius)
            at, node = np.concatenate([at, at[guest]]), np.concatenate([2 * node + (far > 0), 2 * node[guest] + 1])
        return at, node - (1 << self.depth)


def choose_split(distances: np.ndarray, radius: int) -> int:
    """A split near the median with few distances in (split - radius, split], so that few rows are guests."""
    counts = np.bincount(distances, minlength=66)
    below = np.cumsum(counts)
    n = below[-1]
    fair = np.flatnonzero((below >= 0.25 * n) & (below <= 0.75 * n))
    if not len(fair):
        return int(np.searchsorted(below, n / 2))
    guests = below[fair] - np.where(fair >= radius, below[np.maximum(fair - radius, 0)], 0)
    return int(fair[np.argmin(guests + np.abs(below[fair] - n / 2) * 0.2)])


def solve(fps: np.ndarray, wide: np.ndarray, cfg: SimHashConfig) -> list[tuple[int, int]]:
    """Links (positions) that span the components of fps and wide (a row each) under links within the radii."""
    parent, found = np.arange(len(fps)), []

    def roots(rows: np.ndarray) -> np.ndarray:
        top = parent[rows]
        while (up := parent[top]).tobytes() != top.tobytes():
            top = up
        parent[rows] = top
        return top

    def near(block: np.ndarray, rows: np.ndarray) -> np.ndarray:
        close = np.bitwise_count(fps[block][:, None] ^ fps[rows][None]) <= cfg.radius
        if cfg.wide:
            a, b = np.nonzero(close)
            far = np.zeros(len(a), dtype=np.int64)
            for w in range(cfg.wide):
                far += np.bitwise_count(wide[block[a], w] ^ wide[rows[b], w])
            close[a, b] = far <= cfg.wide_radius
        return close

    def unite(one: int, others: np.ndarray) -> None:
        tops = roots(others)
        for top in np.unique(tops):
            mine = roots(np.array([one]))[0]
            if top != mine:
                parent[max(top, mine)] = min(top, mine)
                found.append((int(one), int(others[np.argmax(tops == top)])))

    def small(rows: np.ndarray) -> None:
        for at in range(0, len(rows), 256):
            close = near(rows[at : at + 256], rows[at:])
            for i in np.flatnonzero(close.sum(1) > 1):  # more than itself
                unite(rows[at + i], rows[at:][close[i]])

    def tight(rows: np.ndarray) -> None:
        """Rows that no vantage point parts: near copies, nearly all linked to a few of them. Leaders take what is linked to
        them; what is left to compare are followers with later rows not yet in their component."""
        groups, rest = [], rows
        while len(rest):
            close = near(rest[:1], rest)[0]
            unite(rest[0], rest[close])
            groups.append(rest[close])
            rest = rest[~close]
        ordered, end = np.concatenate(groups), 0
        for group in groups:
            end += len(group)
            for at in range(1, len(group), 256):
                block, later = group[at : at + 256], ordered[end:]
                later = later[roots(later) != roots(group[:1])[0]]
                close = near(block, later)
                for i in np.flatnonzero(close.any(1)):
                    unite(block[i], later[close[i]])

    rng, stack = np.random.default_rng(cfg.seed), [np.arange(len(fps))]
    while stack:
        rows = stack.pop()
        if len(rows) <= cfg.leaf:
            small(rows)
            continue
        far = np.bitwise_count(fps[rows] ^ fps[rng.choice(rows)]).astype(np.int64)
        split = choose_split(far, cfg.radius)
        inner, outer = rows[far <= split], rows[far > split - cfg.radius]
        if max(len(inner), len(outer)) < 0.8 * len(rows):
            stack += [inner, outer]
        else:
            tight(rows)
    return found


def _sample(rows: DataFrame, share: Column, most: int, cfg: SimHashConfig) -> list[tuple[int, int]]:
    """(shard, fp) of about share of rows, chosen by a hash, in order."""
    chosen = rows.where(F.xxhash64(F.lit(cfg.seed), "fp") / F.lit(2.0**64) + 0.5 <= share).select("shard", "fp").limit(2 * most)
    found = chosen.toArrow()
    return sorted(zip(found.column("shard").to_pylist(), found.column("fp").to_pylist()))


def _routed(rows: DataFrame, trees: dict[int, tuple[int, TopTree]]) -> DataFrame:
    """Send rows (shard, fp, node, ...) down the tree of their shard; its leaves are shards numbered from a first one on."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for shard in np.unique(old).tolist():
                first, tree = trees[shard]
                mine = np.flatnonzero(old == shard)
                at, leaf = tree.route(fps[mine])
                at = pa.array(mine[at])
                yield pa.RecordBatch.from_arrays([pa.array(first + leaf), *[c.take(at) for c in batch.columns[1:]]], names=batch.schema.names)

    return rows.mapInArrow(route, rows.schema)


def _by_blocks(rows: DataFrame, names: list[str], cfg: SimHashConfig) -> DataFrame:
    """Part the shards of rows that are too large. Of radius + 1 blocks of bits, two fingerprints within the radius have one in
    common, so a row goes to one part for each of its blocks' values: radius + 1 copies of a row, whatever the shard."""
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * cfg.shard_size)
    sizes = materialize(sizes.select("shard", F.ceil(F.col("n") / cfg.shard_size).alias("parts")), "simhash-large")
    ends = [64 * i // (cfg.radius + 1) for i in range(cfg.radius + 2)]
    parts = []
    for i, (lo, hi) in enumerate(zip(ends, ends[1:])):
        value = F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo)
        parts.append(F.xxhash64("shard", F.lit(i), F.pmod(F.xxhash64(value), F.col("parts"))))
    goes = F.when(F.col("parts").isNull(), F.array("shard")).otherwise(F.array_distinct(F.array(*parts)))
    return lookup(rows, sizes, ["shard"], F.col("node"), "left").select(F.explode(goes).alias("shard"), *names)


def shards(nodes: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """shard and the columns of nodes (fp, node, w0, ...), guests included.

    Guests multiply at each level of the tree, so it is only as deep as the sample is spread to ``spread`` copies a row at
    most. All shards that are still too large are parted by blocks of bits."""
    names = ["fp", "node", *(f"w{i}" for i in range(cfg.wide))]
    rows, n = nodes.select(F.lit(0).cast("long").alias("shard"), *names), nodes.count()
    if n <= cfg.shard_size:
        return rows
    sample = np.array([fp for _, fp in _sample(rows, F.lit(min(1.0, cfg.sample / n)), cfg.sample, cfg)], dtype=np.int64).view(np.uint64)
    depth = min(cfg.max_depth, int(np.ceil(np.log2(n / cfg.shard_size))))
    while len((tree := TopTree(sample, depth, cfg)).route(sample)[0]) > cfg.spread * len(sample):
        depth -= 1
    rows = materialize(_routed(rows, {0: (0, tree)}), "simhash-shards")
    return materialize(_by_blocks(rows, names, cfg), "simhash-parts") if cfg.rounds > 1 else rows


def links(nodes: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Links (a, b) between nodes (fp, node, distinct, and w0, ...) that span the components of near fingerprints."""
    ship(nodes.sparkSession)

    def local(shard: pa.Table) -> pa.Table:
        fps = shard.column("fp").to_numpy().view(np.uint64)
        wide = np.stack([shard.column(f"w{i}").to_numpy().view(np.uint64) for i in range(cfg.wide)], axis=1) if cfg.wide else fps[:, None]
        found = np.array(solve(fps, wide, cfg), dtype=np.int64).reshape(-1, 2)
        node = shard.column("node").combine_chunks()
        return pa.table({"a": node.take(pa.array(found[:, 0])), "b": node.take(pa.array(found[:, 1]))})

    return shards(nodes, cfg).groupBy("shard").applyInArrow(local, "a bigint, b bigint")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """node and component (its smallest node) of every node in edges (a, b).

    Alternating large-star and small-star steps over written tables: each keeps the components and shortens paths,
    until every edge is (smallest node, node). A node's smallest neighbour is an aggregate that meets the node's edges by
    a size-checked lookup, so a hub's edges stay spread."""
    both = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(both.distinct(), tag)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        # Large star: each node's larger neighbours are tied to the smallest of it and its neighbours.
        around = edges.union(edges.select(F.col("b"), F.col("a")))
        least = materialize(around.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")), tag)
        large = lookup(edges, least, ["a"], F.col("b")).select(F.col("m").alias("a"), "b")
        large = materialize(large.where("a != b").distinct(), tag)
        # Small star: each node and its smaller neighbours are tied to the smallest of those.
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")), tag)
        tied = lookup(large, least, ["b"], F.col("a"))
        ends = F.explode(F.array("a", "b")).alias("b")
        small = materialize(tied.select(F.col("m").alias("a"), ends).where("a != b").distinct(), tag)
        # Done once every node is tied to one other at most, and that one to none.
        twice = small.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
        chained = small.select("b").distinct().join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if twice.union(chained).isEmpty():
            hubs = small.select("a").distinct()
            return small.select(F.col("b").alias("node"), F.col("a").alias("component")).union(hubs.select("a", "a"))
        edges = small


def named(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """node, component_id and component of nodes (node, first_id) in the components found (node, component), or alone."""
    found = materialize(found.withColumnRenamed("node", "__node"), "simhash-components")
    linked = materialize(nodes.join(found, nodes["node"] == found["__node"]).select("node", "first_id", "component"), "simhash-linked")
    smallest = materialize(linked.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    linked = lookup(linked, smallest, ["component"], F.col("node")).select(F.col("node").alias("__node"), "component", "component_id")
    classes = nodes.join(linked, nodes["node"] == linked["__node"], "left")
    classes = classes.select("node", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("component", "node").alias("component"))
    return materialize(classes, "simhash-classes")


def near_duplicates(docs: DataFrame, cfg: SimHashConfig = SimHashConfig(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, fp (signed long), component_id (the smallest key reachable over links, its own included) and
    component (a node that names the component, also where its keys are null)."""
    prints = fingerprints(docs, cfg, text, key)
    # Keys may repeat over texts, so nodes are named by their fingerprints and take the smallest key at the end.
    names = ["node", "fp", *(f"w{i}" for i in range(cfg.wide))]
    nodes = materialize(prints.groupBy(*names).agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    classes = named(nodes, components(links(nodes, cfg), "simhash-stars"))
    return prints.join(classes, "node").select("doc_id", "text_hash", "fp", "component_id", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
