"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about equal size. A source's target, in words, turns
into whole passes over its blocks plus a prefix of its permuted blocks, cut inside one block, plus one document of
about the size then left over. The block draws of
all sources are then divided among the output shards: at every node of a binary tree half of the node's draws,
chosen without replacement, go left, so the counts per source follow the multivariate hypergeometric law exactly.
A shard's quota of a source is met with the next blocks of that source's permutation, so draws are disjoint;
inside a shard the order is a hash permutation. Every choice is a hash of the data and the seed, so reruns agree.

Only DataFrame functions are used. The block table has at most ``blocks`` rows plus one per source, whatever
the input; documents meet it by a size-checked lookup and are never shuffled by source.

Nulls and edge cases: a null source is a source of its own, ordered last; null or empty texts have size 0 and are
taken as often as their block; a null doc_id is a valid, equal-to-itself key; repeated rows share one fate; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsieve.llm._common import lookup, materialize, read_table, words_count


@dataclass(frozen=True)
class MixConfig:
    #: Blocks of all sources together (each source has one at least).
    blocks: int = 4096
    #: The tree has 2 ** depth shards as leaves.
    depth: int = 4
    #: No source is taken more often than this.
    max_repeats: int = 3
    #: Weights of the sources in order, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    seed: int = 42


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """One row per source: source, source_size, target. sizes has source and size.

    Sharing by weight with the excess of capped sources reshared is water filling: target = min(cap, weight * level),
    the level being that of the first source, by cap / weight, which the level does not fill."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in cfg.weights]), (F.col("rank") % len(cfg.weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w)
    per = per.withColumn("cap", F.col("source_size").cast("double") * cfg.max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap"))
    return per.select("source", "source_size", "total", target.alias("target"))


def _hash(cfg: MixConfig, tag: str, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(cfg.seed), F.lit(tag), *[F.col(c) if isinstance(c, str) else c for c in cols])


def split_quotas(units: DataFrame, cfg: MixConfig) -> DataFrame:
    """Give every block draw of units (source, block, copy) its shard.

    The tree splits anonymous tokens, one per draw; tokens of a source, in shard order, then meet the source's draws
    in permuted order."""
    tokens = units.select("source", "block", "copy", F.lit(0).alias("shard"))
    for level in range(cfg.depth):
        node = Window.partitionBy("shard").orderBy(_hash(cfg, f"split{level}", "source", "block", "copy"), "block", "copy")
        whole = Window.partitionBy("shard")
        left = F.row_number().over(node) * 2 <= F.count(F.lit(1)).over(whole) + F.col("shard") % 2
        tokens = tokens.select("source", "block", "copy", (F.col("shard") * 2 + F.when(left, 0).otherwise(1)).alias("shard"))
    of_source = Window.partitionBy("source")
    slots = tokens.select(F.col("source").alias("s"), "shard", F.row_number().over(of_source.orderBy("shard")).alias("slot"))
    draws = units.withColumn("slot", F.row_number().over(of_source.orderBy("copy", "draw_order", "block")))
    return draws.join(slots, draws["source"].eqNullSafe(slots["s"]) & (draws["slot"] == slots["slot"])).select("source", "block", "copy", "shard")


@dataclass(frozen=True)
class MixPlan:
    """sources: source, source_size, target, n_blocks, extra_u. blocks: source, block, passes, cut, cut_u, shards."""

    sources: DataFrame
    blocks: DataFrame
    cfg: MixConfig

    def decide(self, rows: DataFrame) -> DataFrame:
        """Add source_size, target, copies and shards to rows, which have doc_id and source. No shuffle of rows."""
        dealt = _deal(rows, self.sources, self.cfg)
        out = lookup(dealt, self.blocks.withColumnRenamed("source", "__s"), ["__s", "block"], F.col("u"))
        drawn = F.col("passes") + F.when(F.col("cut") & (F.col("u") <= F.col("cut_u")), 1).otherwise(0)
        extra = F.when(F.col("u") == F.col("extra_u"), F.array(F.pmod(_hash(self.cfg, "extra", "u"), F.lit(2**self.cfg.depth)).cast("int")))
        none = F.array().cast("array<int>")
        shards = F.concat(F.slice(F.coalesce("shards", none), F.lit(1), drawn), F.coalesce(extra, none))
        out = out.withColumn("shards", shards).withColumn("copies", F.size("shards"))
        return out.drop("__s", "block", "u", "n_blocks", "passes", "cut", "cut_u", "extra_u")


def _deal(rows: DataFrame, sources: DataFrame, cfg: MixConfig) -> DataFrame:
    rows = rows.withColumn("u", _hash(cfg, "order", "doc_id")).withColumn("__s", F.col("source"))
    dealt = lookup(rows, sources.withColumnRenamed("source", "__s"), ["__s"], F.col("u"))
    return dealt.withColumn("block", F.pmod(_hash(cfg, "block", "doc_id"), F.col("n_blocks")))


def measure(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """doc_id, source, size of every document, written to the shared folder."""
    return materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words_count(F.col(text)).alias("size")), "mix-sizes")


def plan_mix(sized: DataFrame, cfg: MixConfig = MixConfig()) -> MixPlan:
    """Plan the mix of sized (doc_id, source, size)."""
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("total") * cfg.blocks)).cast("long")
    sources = source_targets(sized, cfg).withColumn("n_blocks", F.when(F.col("total") > 0, n).otherwise(F.lit(1)))
    sources = materialize(sources.drop("total"), "mix-sources")
    dealt = _deal(sized, sources, cfg)
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("block_size"), *[F.first(c).alias(c) for c in ("source_size", "target")])
    blocks = blocks.withColumn("draw_order", _hash(cfg, "draw", "source", "block"))
    # Whole passes, and the prefix of the permuted blocks that the rest of the target reaches.
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cfg.max_repeats))).otherwise(F.lit(0))
    upto = F.sum("block_size").over(Window.partitionBy("source").orderBy("draw_order", "block"))
    blocks = blocks.withColumn("whole", whole.cast("int"))
    blocks = blocks.withColumn("rest", F.when(F.col("whole") < cfg.max_repeats, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    blocks = blocks.withColumn("need", F.col("rest") - (upto - F.col("block_size")))
    inside = (F.col("rest") > 0) & (F.col("need") >= F.col("block_size"))
    blocks = blocks.withColumn("cut", (F.col("need") > 0) & (F.col("need") < F.col("block_size"))).withColumn("passes", F.col("whole") + inside.cast("int"))
    blocks = materialize(blocks, "mix-blocks")
    # The cut block of a source: its documents in hash order while they fit in the need.
    cuts = materialize(blocks.where("cut").select("source", "block", "need"), "mix-cuts")
    edge = lookup(dealt.select("doc_id", "source", "size", "u", "block"), cuts, ["source", "block"], F.col("u"))
    edge = edge.withColumn("so_far", F.sum("size").over(Window.partitionBy("source", "block").orderBy("u", "doc_id")))
    fits = F.when(F.col("so_far") <= F.col("need"), F.struct("u", "so_far"))
    last = edge.groupBy("source", "block").agg(F.max(fits).alias("last"), (F.first("need") - F.coalesce(F.max(fits["so_far"]), F.lit(0))).alias("gap"))
    last = materialize(last.select("source", "block", F.col("last.u").alias("cut_u"), "gap"), "mix-last")
    blocks = lookup(blocks, last, ["source", "block"], F.col("block"), "left").withColumn("draws", F.col("passes") + F.col("cut").cast("int"))
    # The gap that is left goes to the undrawn document whose size comes nearest to it.
    undrawn = lookup(dealt.select("source", "block", "size", "u"), materialize(blocks.select("source", "block", "whole", "passes", "cut", "cut_u"), "mix-drawn"), ["source", "block"], F.col("u"))
    undrawn = undrawn.where((F.col("whole") == F.col("passes")) & ~(F.col("cut") & F.coalesce(F.col("u") <= F.col("cut_u"), F.lit(False))))
    undrawn = lookup(undrawn.select("source", "size", "u"), last.select("source", "gap"), ["source"], F.col("u"))
    nearest = undrawn.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "u", "gap")).alias("x"))
    nearest = materialize(nearest.where("x.off < x.gap").select("source", F.col("x.u").alias("extra_u")), "mix-extra")
    sources = materialize(lookup(sources, nearest, ["source"], F.col("n_blocks"), "left"), "mix-sources")
    draws = blocks.where("draws > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("draws"))))
    shards = split_quotas(draws.select("source", "block", "copy", "draw_order"), cfg).groupBy("source", "block")
    shards = shards.agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    blocks = lookup(blocks, materialize(shards, "mix-shards"), ["source", "block"], F.col("block"), "left")
    return MixPlan(sources, materialize(blocks.select("source", "block", "passes", "cut", "cut_u", "shards"), "mix-plan"), cfg)


def mix(docs: DataFrame, cfg: MixConfig = MixConfig(), places: bool = True) -> DataFrame:
    """The mix itself: each row of docs (doc_id, text, source, ...) as often as it is drawn, with its columns and, with
    places, mix_shard (its output shard) and mix_order (its place in the shard's local shuffle) in place of columns of docs that
    have these names."""
    row = F.struct(*[c for c in docs.columns if not places or c not in ("mix_shard", "mix_order")]).alias("__row")
    rows = plan_mix(measure(docs), cfg).decide(docs.select(row, "doc_id", "source"))
    rows = rows.select("__row", F.posexplode("shards").alias("__copy", "__shard"))
    order = _hash(cfg, "local", F.col("__row.doc_id"), "__copy", "__shard")
    return rows.select("__row.*", *[F.col("__shard").alias("mix_shard"), order.alias("mix_order")] * places)


def write_shards(mixed: DataFrame, path: str) -> None:
    """Write a mix as Parquet, a folder for each shard, shuffled within. Each shard takes several tasks."""
    ranged = mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
    ranged.write.partitionBy("mix_shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = measure(read_table(spark, sf_dir, "documents"))
    rows = plan_mix(sized).decide(sized)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")
