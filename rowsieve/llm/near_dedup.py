"""One document of each group of near-duplicates: SimHash trees first, an exact check of every link, and an exact rest.

Two texts are linked where their sets of five-word shingles have a Jaccard index of 0.8 or more. Equal sets are one node.
Vantage-point trees over SimHash fingerprints (simhash.links) and stars around the node of smallest name for each of a few
MinHash values bring together most of what is alike at linear cost. Fingerprints alone can't do it: at an index of 0.8 those of
64 bits differ in ten bits or so, a radius at which no vantage point parts anything. So what the trees leave apart meets by prefix
filtering: with all shingles in one order, two sets of index t have one in common among the first n - ceil(t n) + 1 of each.
In two rounds each node is first checked against two others at most that it meets so, which brings large groups together.
Of the pairs of different components that meet so, and whose sizes and bitmaps of shingles allow t, first the one with most
shingles in common is checked for each node and component that it meets, then all whose components still differ. The order puts
shingles last that a sample shows to be frequent; with any order the links are the same, so none is lost.

Every link is checked on the two whole sets. No set is ever stored: texts are hashed again for prefixes, and those that a check
asks for travel to it as texts. Shingles count by their 64-bit hashes. Large stars and large buckets are dealt out in pieces.

Nulls and edge cases: null and empty texts have the empty set and are alike; fewer words than a shingle form one shingle; rows
of one key and different texts join all that they resemble; null keys name a group only if no key else is in it; of equal
rows one stays; an empty table gives an empty result; other columns, whatever their names, go along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm import simhash
from rowsieve.llm._common import by_place, fits_broadcast, fresh_path, lookup, map_texts, materialize, settled
from rowsieve.llm.simhash import shingle_hashes, words_of
from rowsieve.shipping import ship


@dataclass(frozen=True)
class JaccardConfig:
    shingle: int = 5
    #: Least Jaccard index of linked texts, in percent.
    least: int = 80
    #: Single words' fingerprints of such texts differ least; sketches differ in 26 bits on average, with a deviation of 5.
    trees: simhash.SimHashConfig = simhash.SimHashConfig(shingle=1, radius=3, wide=4, wide_radius=44, leaf=8192)
    #: MinHash values whose stars are checked along with the links of the trees.
    hashes: int = 8
    #: Texts whose shingles are counted; those in frequent_from of them, the most frequent ones at most, come last in prefixes.
    sample: int = 20_000
    frequent_from: int = 4
    frequent: int = 50_000
    #: Members and shingles of a piece of a star that is checked at once, and rows of a block of a bucket.
    star: int = 256
    star_shingles: int = 1_000_000
    block: int = 2048
    #: Rounds in which each node meets a few others of its buckets, before all that are still apart meet.
    rounds: int = 2
    seed: int = 42


#: Least and most longs of a set's bitmap, which has a bit for each shingle at least in between.
_WORDS, _MOST_WORDS = 16, 256
#: Columns of the fingerprint and the sketch that the trees go by.
_PRINTS = ("fp", "w0", "w1", "w2", "w3")
_EDGES = np.arange(256, dtype=np.uint64) << np.uint64(56)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(words_of(text), size))


def _name(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), 42)


def sketch(grams: np.ndarray) -> np.ndarray:
    """A bit of the smallest hash in each of 256 ranges. Sets of index t differ in about 128 (1 - t) of them, unrelated ones in 128."""
    at = np.searchsorted(grams, _EDGES)
    found = np.append(grams, np.uint64(0))[at]
    inside = (found >> np.uint64(56)) == (_EDGES >> np.uint64(56))
    return np.packbits(((found >> np.uint64(7)) & inside.astype(np.uint64)).astype(np.uint8)).view(np.uint64)


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles at each place: what both of two sets have cancels out, so places differ by shingles of one
    set only, and in no more than there are of these. A wide bitmap folds to a narrow one by exclusive or of its parts."""
    words = min(max(_WORDS, 1 << (-(-len(grams) // 64) - 1).bit_length() if len(grams) else 0), _MOST_WORDS)
    at = ((grams >> np.uint64(7)) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * words) & 1).astype(np.uint8)).view(np.uint64)


def word_print(words: list[bytes]) -> int:
    """The SimHash fingerprint of single words, repeats included."""
    counts = Counter(words)
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in counts], dtype=">u8").view(np.uint8).reshape(-1, 8)
    total = np.fromiter(counts.values(), np.int64, len(counts)) @ np.unpackbits(hashes, axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(words)).tobytes(), "big")


def _described(text: str | None, cfg: JaccardConfig, odd: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, list[int]]:
    """A name of the text's set, its size, its MinHash values and bitmap, its fingerprint and sketch."""
    words = words_of(text)
    grams = np.unique(shingle_hashes(words, cfg.shingle))
    mixed = grams[None] * odd[:, None]
    mixed = (mixed ^ mixed >> np.uint64(29)) * odd[:, None]
    mins = mixed.min(1) ^ odd if len(grams) else np.zeros(0, dtype=np.uint64)
    return _name(grams), len(grams), mins, bitmap(grams), [word_print(words), *sketch(grams)]


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rep and text. Nulls within the struct are equal in joins."""
    row, names = by_place(docs)
    row = row.select(F.col(names[key]).cast("long").alias("doc_id"), F.col(names[text]).alias("text"))
    return row.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("rep"), "text")


def described(rows: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """rep, node (named by the set), size, mins, bitmap and fingerprints of rows (rep, text), written to the shared folder."""
    odd = np.random.default_rng(cfg.seed).integers(0, 2**64, cfg.hashes, dtype=np.uint64) | np.uint64(1)

    def work(texts: list[str | None]) -> list:
        made = [_described(x, cfg, odd) for x in texts]
        fps = np.array([m[4] for m in made], dtype=np.uint64).reshape(len(made), len(_PRINTS)).view(np.int64)
        mins, maps = (pa.array([m[i].view(np.int64) for m in made], type=pa.list_(pa.int64())) for i in (2, 3))
        return [np.array([m[0] for m in made], dtype=np.uint64).view(np.int64), [m[1] for m in made], mins, maps, *fps.T]

    flat = rows.select("rep.doc_id", "rep.text_hash", "text")
    made = "node bigint, size int, mins array<bigint>, map array<bigint>, " + ", ".join(f"{c} bigint" for c in _PRINTS)
    found = map_texts(flat, "text", ("doc_id", "text_hash"), made, work)
    return materialize(found.select(F.struct("doc_id", "text_hash").alias("rep"), *found.columns[2:]), "near-described")


def _runs(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on tables of whole runs of equal keys, of batches in the order of key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if held and (cut or held[-1].column("key")[0].as_py() != keys[0]):
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from work(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", *more)


def checked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the least index.

    Sizes and bitmaps come first: sets of n and m shingles reach t only if at most (1 - t) / (1 + t) (n + m) shingles are in
    one of them, and bitmaps differ in no more places than that. The others are checked on the texts: a's text goes to each piece
    of a's star, b's to the one that it is in."""
    end = lambda name: nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "map")])
    met = pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b")
    far = F.aggregate(F.zip_with("map_a", "map_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    able = F.greatest("size_a", "size_b") * cfg.least <= F.least("size_a", "size_b") * 100
    able = able & ((F.size("map_a") != F.size("map_b")) | (far * (100 + cfg.least) <= (F.col("size_a") + F.col("size_b")) * (100 - cfg.least)))
    met = materialize(met.where(able).select("a", "b", F.col("size_b").alias("size")), "near-able")
    asked = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = materialize(asked.join(nodes, "node").select("node", "rep.doc_id", "rep.text_hash"), "near-asked")
    wanted = asked.select("node", F.struct("doc_id", "text_hash").alias("rep"))
    texts = rows.join(F.broadcast(wanted) if fits_broadcast(asked) else wanted, "rep").select("node", "text")
    texts = materialize(texts.dropDuplicates(["node"]), "near-texts")
    pieces = met.groupBy("a").agg(F.ceil(F.greatest(F.count(F.lit(1)) / cfg.star, F.sum("size") / cfg.star_shingles)).cast("int").alias("pieces"))
    met = lookup(met.select("a", "b"), materialize(pieces, "near-pieces"), ["a"], F.col("b"))
    met = met.withColumn("key", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.greatest("pieces", F.lit(1)))))
    members = met.join(texts.withColumnRenamed("node", "b"), "b").select("key", "a", "b", "text")
    centres = met.select("key", "a").distinct().join(texts.withColumnRenamed("node", "a"), "a")
    tasks = centres.select("key", "a", F.lit(None).cast("long").alias("b"), "text").unionByName(members)
    size, least = cfg.shingle, cfg.least

    def check(stars: pa.Table) -> Iterator[pa.RecordBatch]:
        centre: dict[int, np.ndarray] = {}
        found: list[tuple[int, int]] = []
        for a, b, text in zip(stars.column("a").to_pylist(), stars.column("b").to_pylist(), stars.column("text")):
            grams = shingle_set(text.as_py(), size)
            if b is None:
                centre[a] = grams
                continue
            common = len(np.intersect1d(centre[a], grams, assume_unique=True))
            if common * 100 >= (len(grams) + len(centre[a]) - common) * least:
                found.append((a, b))
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["a", "b"])

    # Of a star's rows, its centre comes first.
    return materialize(_in_order(tasks, "b").mapInArrow(_runs(check), "a bigint, b bigint"), "near-links")


def frequent_shingles(rows: DataFrame, n: int, cfg: JaccardConfig) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample of the n rows, in order, and how often they are there."""
    share, size = min(1.0, cfg.sample / max(1, n)), cfg.shingle
    chosen = rows.where(F.xxhash64(F.lit(cfg.seed), "rep") / F.lit(2.0**64) + 0.5 <= share).select("text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), size).view(np.int64))], names=["g"])

    counts = chosen.mapInArrow(grams, "g bigint").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.frequent_from)
    top = counts.orderBy(F.col("n").desc(), "g").limit(cfg.frequent).toArrow()
    found, often = top.column("g").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], often[order]


def prefix(grams: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """The shingles of a set of which any set that reaches the least index has one in its own prefix."""
    n = len(grams) - -(-len(grams) * least // 100) + 1 if len(grams) else 0
    often = np.zeros(len(grams), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        often = np.where(frequent[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, often))[:n]]


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _met(rows: DataFrame, n: int, cfg: JaccardConfig) -> DataFrame:
    """key, node and n: the shingles that the prefixes of several nodes have, those of the same nodes as one key of n shingles. A
    partition's equal sets are sent once."""
    frequent, counts = frequent_shingles(rows, n, cfg)
    size, least = cfg.shingle, cfg.least

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found, nodes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
            for text in batch.column(0):
                grams = shingle_set(text.as_py(), size)
                node = _name(grams)
                if node not in seen:
                    seen.add(node)
                    found.append(prefix(grams, frequent, counts, least))
                    nodes.append(np.full(len(found[-1]), node, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (found, nodes)], names=["key", "node"])

    def shared(run: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node = run.column("key").to_numpy(), run.column("node").to_numpy()
        new = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[np.concatenate([[True], new])], node[np.concatenate([[True], new])]
        starts = _starts(key)
        ends = np.append(starts[1:], len(key))
        several = ends - starts > 1
        names = [xxhash.xxh64_intdigest(node[i:j].tobytes(), 42) for i, j in zip(starts[several].tolist(), ends[several].tolist())]
        held = np.repeat(several, ends - starts)
        key = np.repeat(np.array(names, dtype=np.uint64), (ends - starts)[several])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[held])], names=["key", "node"])

    schema = "key bigint, node bigint"
    met = _in_order(rows.select("text").mapInArrow(keys, schema), "node").mapInArrow(_runs(shared), schema)
    return materialize(met.groupBy("key", "node").agg(F.count(F.lit(1)).alias("n")), "near-met")


def _dealt(met: DataFrame, nodes: DataFrame, joined: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """The buckets of met (key, node, n) that several components of joined (node, component) meet in. A bucket is dealt into blocks
    that meet each other."""
    rows = met.join(joined, "node", "left").select("key", "node", F.col("n").alias("shingles"), F.coalesce("component", "node").alias("component"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    buckets = buckets.where("low < high").select("key", F.ceil(F.col("n") / cfg.block).cast("int").alias("blocks"))
    # Sizes and bitmaps travel with what is left only.
    rows = rows.join(buckets, "key").join(nodes.select("node", F.col("size").cast("long").alias("size"), "map"), "node")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    # In the task of a block with itself all rows meet; elsewhere those of one block don't.
    rows = rows.withColumn("side", F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine"))).drop("blocks", "mine", "other")
    return rows


def _near(one: tuple, other: tuple, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in one and other (arrays of node, component, size, side, narrow bitmaps and where in words the whole ones are) of rows
    that are in different components and whose sizes and bitmaps allow the least index, and how many places of the bitmaps differ."""
    (node, part, size, side, maps, at, wide), (node_, part_, size_, side_, maps_, at_, wide_) = one, other
    able = (part[:, None] != part_[None]) & ((side[:, None] < 0) | (side[:, None] != side_[None])) & (node[:, None] != node_[None])
    able &= np.maximum(size[:, None], size_[None]) * least <= np.minimum(size[:, None], size_[None]) * 100
    i, j = np.nonzero(able)
    # A quarter of the narrow bitmaps rules most pairs out, the whole ones most of the others.
    far, quarter = np.zeros(len(i), dtype=np.int64), _WORDS // 4
    allowed = lambda i, j: (size[i] + size_[j]) * (100 - least)
    for piece in (slice(quarter), slice(quarter, None)):
        far = far + np.bitwise_count(maps[i, piece] ^ maps_[j, piece]).sum(1, dtype=np.int64)
        near = far * (100 + least) <= allowed(i, j)
        i, j, far = i[near], j[near], far[near]
    for w, w_ in {(x, y) for x in np.unique(wide[i]).tolist() for y in np.unique(wide_[j]).tolist() if min(x, y) > _WORDS}:
        these, both = np.flatnonzero((wide[i] == w) & (wide_[j] == w_)), min(w, w_)
        for k in range(0, len(these), 2048):
            some = these[k : k + 2048]
            ends = [words[a[x[some]][:, None] + np.arange(n)].reshape(len(some), -1, both) for a, x, n in ((at, i, w), (at_, j, w_))]
            far[some] = np.bitwise_count(np.bitwise_xor.reduce(ends[0], 1) ^ np.bitwise_xor.reduce(ends[1], 1)).sum(1, dtype=np.int64)
    near = far * (100 + least) <= allowed(i, j)
    return i[near], j[near], far[near]


def _columns(run: pa.Table) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """node, component, size, side, narrow bitmaps, start and length in words of each row's bitmap, and words."""
    found = run.column("map").combine_chunks()
    words, ends = found.flatten().to_numpy().view(np.uint64), found.offsets.to_numpy().astype(np.int64)
    at, wide = ends[:-1] - ends[0], np.diff(ends)
    maps = np.empty((len(at), _WORDS), dtype=np.uint64)
    for w in np.unique(wide).tolist():
        for rows in np.array_split(np.flatnonzero(wide == w), 1 + len(at) // 4096):
            maps[rows] = np.bitwise_xor.reduce(words[at[rows][:, None] + np.arange(w)].reshape(len(rows), -1, _WORDS), 1)
    return (*(run.column(c).to_numpy() for c in ("node", "component", "size", "side")), maps, at, wide), words


def _pairs_of(a: list[np.ndarray], b: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
    one, other = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(np.concatenate(n))], names=["a", "b", "n"])


def closest(met: DataFrame, nodes: DataFrame, joined: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Pairs (a, b) of nodes of different components, two for a node at most: of the rows that a node meets in a bucket, the one
    with the nearest bitmap and the one that most rows of the bucket may be linked to. Of these pairs each node has those that
    buckets of most shingles name."""
    least = cfg.least

    def pairs(run: pa.Table) -> Iterator[pa.RecordBatch]:
        key, often, (cols, words) = run.column("key").to_numpy(), run.column("shingles").to_numpy(), _columns(run)
        starts, a, b, kind, n = _starts(key), [], [], [], []
        for first, end in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist()):
            size = end - first
            best, who, degree = np.full(size, 1 << 40), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            chunks = [(x, y) for x in range(first, end, 256) for y in range(first, end, 4096)]
            found = lambda x, y: _near(*(tuple(c[p : min(p + q, end)] for c in cols) for p, q in ((x, 256), (y, 4096))), words, least)
            for x, y in chunks:
                i, j, far = found(x, y)
                i, j = i + x - first, j + y - first
                degree += np.bincount(i, minlength=size)
                order = np.lexsort((cols[0][first:end][j], far, i))
                i, j, far = i[order], j[order], far[order]
                head = _starts(i) if len(i) else np.zeros(0, dtype=np.int64)
                closer = far[head] < best[i[head]]
                best[i[head][closer]], who[i[head][closer]] = far[head][closer], j[head][closer]
            node = cols[0][first:end]
            mine = np.flatnonzero(degree)
            if not len(mine):
                continue
            hub = int(np.lexsort((node, -degree))[0])
            near_hub = np.concatenate([_near(tuple(c[first + hub : first + hub + 1] for c in cols), tuple(c[y : min(y + 4096, end)] for c in cols), words, least)[1] + y - first for y in range(first, end, 4096)])
            for k, (x, y) in enumerate(((mine, who[mine]), (near_hub, np.full(len(near_hub), hub)))):
                a.append(node[x])
                b.append(node[y])
                kind.append(np.full(len(x), k))
                n.append(np.full(len(x), often[first]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (a, b, kind, n)], names=["a", "b", "kind", "n"])

    found = _in_order(_dealt(met, nodes, joined, cfg)).mapInArrow(_runs(pairs), "a bigint, b bigint, kind bigint, n bigint")
    found = found.groupBy("a", "b", "kind").agg(F.sum("n").alias("n"))
    best = found.groupBy("a", "kind").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-closest")


def meetings(met: DataFrame, nodes: DataFrame, joined: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Pairs (a, b, n) of nodes that have n shingles of their prefixes in common, are in different components of joined
    (node, component) and may reach the least index by their sizes and bitmaps.

    A bucket is dealt into blocks that meet each other; buckets of one component are left out before."""
    rows = _dealt(met, nodes, joined, cfg)
    least = cfg.least

    def pairs(run: pa.Table) -> Iterator[pa.RecordBatch]:
        key, often, (cols, words) = run.column("key").to_numpy(), run.column("shingles").to_numpy(), _columns(run)
        starts, node = _starts(key), cols[0]
        a, b, n, held = [], [], [], 0
        for first, end in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist()):
            for at in range(first, end, 256):
                for to in range(at, end, 4096):
                    i, j, _ = _near(*(tuple(c[p : min(p + q, end)] for c in cols) for p, q in ((at, 256), (to, 4096))), words, least)
                    # Rows of the first block meet among themselves twice.
                    once = i + at < j + to
                    a.append(node[at + i[once]])
                    b.append(node[to + j[once]])
                    n.append(np.full(int(once.sum()), often[first]))
                    held += len(n[-1])
                    if held > 100_000:
                        yield _pairs_of(a, b, n)
                        a, b, n, held = [], [], [], 0
        if held:
            yield _pairs_of(a, b, n)

    found = _in_order(rows).mapInArrow(_runs(pairs), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # Behind the earlier end of both prefixes lie less than ceil(t n) shingles of one set, so more than these and the n before it
    # are not common; t / (1 + t) of all shingles of both must be.
    size = lambda name: nodes.select(F.col("node").alias(name), F.col("size").cast("long").alias(f"size_{name}"))
    found = found.join(size("a"), "a").join(size("b"), "b")
    most = F.col("n") + F.ceil(F.greatest("size_a", "size_b") * least / 100) - 1
    return materialize(found.where(most * (100 + least) >= (F.col("size_a") + F.col("size_b")) * least).select("a", "b", "n"), "near-meetings")


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """pairs of different components, with both as ca and cb."""
    end = lambda name: joined.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    rows = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return rows.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).where("ca <> cb")


def similar_links(rows: DataFrame, sets: DataFrame, nodes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Links (a, b) between nodes, all of them checked, that span the components of all links."""
    trees = simhash.links(nodes.select("node", *_PRINTS), cfg.trees)
    mins = materialize(sets.select("node", F.explode("mins").alias("h")).distinct(), "near-mins")
    least = mins.groupBy("h").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "m")
    stars = lookup(mins, materialize(least, "near-least"), ["h"], F.col("node")).where("node <> m").select(F.col("m").alias("a"), F.col("node").alias("b"))
    first = trees.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(stars).distinct()
    near = checked(first, rows, nodes, cfg)
    joined = materialize(simhash.components(near, "near-components"), "near-joined")
    met = _met(rows, sets.count(), cfg)
    # Groups that are still in pieces come together by few pairs a node before all pairs of different components are looked at.
    for _ in range(cfg.rounds):
        found = checked(closest(met, nodes, joined, cfg), rows, nodes, cfg)
        if found.isEmpty():
            break
        near = near.unionByName(found)
        joined = materialize(simhash.components(near, "near-components"), "near-joined")
    todo = meetings(met, nodes, joined, cfg)
    # What has most in common first: for each node, then for each node and component that it meets, then all.
    for by in (["x"], ["x", "c"], None):
        todo = materialize(_apart(todo, joined), "near-apart")
        if todo.isEmpty():
            break
        tried = todo.select("a", "b")
        if by:
            ends = todo.select(F.col("a").alias("x"), F.col("cb").alias("c"), "a", "b", "n").unionByName(todo.select(F.col("b").alias("x"), F.col("ca").alias("c"), "a", "b", "n"))
            tried = materialize(ends.groupBy(*by).agg(F.max(F.struct("n", "a", "b")).alias("m")).select("m.a", "m.b").distinct(), "near-tried")
        found = checked(tried, rows, nodes, cfg)
        near = near.unionByName(found)
        if by:
            todo = todo.join(tried, ["a", "b"], "left_anti").drop("ca", "cb")
            joined = materialize(simhash.components(near, "near-components"), "near-joined") if not found.isEmpty() else joined
    return near


def similar_groups(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, component_id (the smallest key of the group) and component (a node that names it, also where keys are null)."""
    ship(docs.sparkSession)
    rows = keyed(docs, text, key)

    def work() -> DataFrame:
        sets = described(rows, cfg)
        prints = [F.min(F.struct(*_PRINTS)).alias("prints"), F.min("rep").alias("rep"), F.min("rep.doc_id").alias("first_id")]
        nodes = sets.groupBy("node", "size").agg(F.first("map").alias("map"), *prints).select("*", "prints.*").drop("prints")
        nodes = materialize(nodes, "near-nodes")
        classes = simhash.named(nodes, simhash.components(similar_links(rows, sets, nodes, cfg), "near-components"))
        return sets.select("rep.doc_id", "rep.text_hash", "node").join(classes, "node").select("doc_id", "text_hash", "component_id", "component")

    return settled(docs.sparkSession, work, fresh_path(docs.sparkSession, "near-groups"))


def keep_one(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, one for each component: that with the smallest key, null last, of rows with one key that of the
    smallest text hash, and one of equal keys and texts."""
    groups = similar_groups(docs, cfg, text, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("r0"), F.coalesce("doc_id", F.lit(0)).alias("r1"), F.col("text_hash").alias("r2")))
    on = ["r0", "r1", "r2"]
    kept = materialize(groups.groupBy("component").agg(first.alias("x")).select("x.*").distinct(), "near-kept")
    rows, names = by_place(docs)
    k = F.col(names[key]).cast("long")
    rows = rows.withColumn("r0", k.isNull()).withColumn("r1", F.coalesce(k, F.lit(0))).withColumn("r2", F.xxhash64(names[text]))
    # The join and the removal of equal rows share one shuffle of the texts.
    rows = rows.join(kept, on, "left_semi").dropDuplicates(on)
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])
