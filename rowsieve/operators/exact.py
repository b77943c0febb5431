"""Rows that are equal up to token order and punctuation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.functions import keys
from rowsieve.operators.components import connected_components
from rowsieve.operators.lookup import lookup
from rowsieve.plans.storage import store


def keyed(rows: DataFrame) -> DataFrame:
    """rows (row_id, value) with their keys: original, canonical, alnum and type."""
    rows = rows.select("row_id", "value", keys.original(F.col("value")).alias("original"))
    return rows.select("*", keys.canonical(F.col("original")).alias("canonical"), keys.alnum(F.col("original")).alias("alnum"), keys.detect_type(F.col("original")).alias("type"))


def canonical_classes(rows: DataFrame) -> DataFrame:
    """One row per canonical key: canonical, class (its smallest row_id), n. Equal originals have equal canonical keys."""
    return rows.groupBy("canonical").agg(F.min("row_id").alias("class"), F.count(F.lit(1)).alias("n"))


def alnum_edges(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between canonical classes with rows of one alphanumeric key, one type, lengths that differ by two at most
    and half of their tokens in common.

    What an edge depends on is reduced to distinct forms first, so that only they pair up."""
    forms = rows.where("alnum <> ''").select("alnum", "type", "canonical", F.length("original").alias("len")).distinct()
    forms = forms.join(classes.select("canonical", "class"), "canonical")
    a, b = forms.alias("a"), forms.alias("b")
    on = (F.col("a.alnum") == F.col("b.alnum")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.class") < F.col("b.class")) & (F.abs(F.col("a.len") - F.col("b.len")) <= 2)
    tokens = [F.split(F.col(f"{side}.canonical"), "\u0001", -1) for side in "ab"]
    pairs = a.join(b, on).where(keys.jaccard_at_least_half(*tokens))
    return pairs.select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()


def _joined_classes(classes: DataFrame, found: DataFrame) -> DataFrame:
    """canonical, component and group_size of classes, some of which found (node, component) joins."""
    classes = lookup(classes, found.select(F.col("node").alias("class"), "component"), ["class"], F.col("canonical"), "left")
    classes = store(classes.select("canonical", "n", F.coalesce("component", "class").alias("component")), "exact-classes")
    sizes = store(classes.groupBy("component").agg(F.sum("n").alias("group_size")).where("group_size > 1"), "exact-sizes")
    classes = lookup(classes, sizes, ["component"], F.col("canonical"), "left")
    return classes.select("canonical", "component", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


def exact_groups(rows: DataFrame) -> DataFrame:
    """row_id, value, component (the smallest row_id of the group) and group_size of rows (row_id, value)."""
    rows = store(keyed(rows), "exact-keys")
    classes = store(canonical_classes(rows), "exact-classes")
    found = connected_components(alnum_edges(rows, classes))
    if found.isEmpty():  # every class is a group
        classes = classes.select("canonical", F.col("class").alias("component"), F.col("n").alias("group_size"))
    else:
        classes = store(_joined_classes(classes, store(found, "exact-components")), "exact-classes")
    # Both sides are shuffled for this join only, so the pieces of a very common key can be dealt anew at run time.
    return rows.select("row_id", "value", "canonical").join(classes, "canonical").select("row_id", "value", "component", "group_size")


def remaining(groups: DataFrame) -> DataFrame:
    """The rows in no group of two or more."""
    return groups.where("group_size = 1").select("row_id", "value")


def members(groups: DataFrame) -> DataFrame:
    """One row per group of two or more: component and the sorted row_ids."""
    return groups.where("group_size > 1").groupBy("component").agg(F.array_sort(F.collect_list("row_id")).alias("members"))


def exact_pairs(groups: DataFrame) -> DataFrame:
    """All pairs (first, second) within groups. The result has the square of a group's size; groups are the linear form."""
    rows = groups.where("group_size > 1").select("component", "row_id")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.row_id") < F.col("b.row_id")))
    return pairs.select(F.col("a.row_id").alias("first"), F.col("b.row_id").alias("second"))
