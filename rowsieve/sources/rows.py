"""Tables as rows of cells (row_id, cells), and results as files.

A row is identified by an explicit key, not by its place in a file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.errors import BatchTooLargeError, InvalidInputError


def from_table(df: DataFrame, key: str, cells: list[str]) -> DataFrame:
    """The columns in cells as text, row by row."""
    missing = {key, *cells} - set(df.columns)
    if missing:
        raise InvalidInputError(f"no such column: {', '.join(sorted(missing))}")
    return df.select(F.col(key).cast("long").alias("row_id"), F.array(*[F.col(c).cast("string") for c in cells]).alias("cells"))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents {"rows": [[...], ...]}: rows are numbered from 0 in each document. Null rows have no cells."""
    df = spark.read.schema("rows array<array<string>>, _corrupt_record string").option("multiLine", True).json(path)
    bad = df.where("_corrupt_record is not null or rows is null").limit(1).select("_corrupt_record").collect()
    if bad:
        raise InvalidInputError("not a JSON document with rows of cells")
    return df.select(F.posexplode("rows").alias("at", "cells")).select(F.col("at").cast("long").alias("row_id"), F.coalesce("cells", F.array().cast("array<string>")).alias("cells"))


def limited(rows: DataFrame, most: int | None) -> DataFrame:
    """rows, if there are no more than most of them."""
    if most is not None and rows.limit(most + 1).count() > most:
        raise BatchTooLargeError(f"more than {most} rows")
    return rows


def write_text(rows: DataFrame, path: str) -> None:
    """A line of joined cells per row. Line breaks within cells become blanks."""
    line = F.regexp_replace(F.concat_ws(" | ", F.transform("cells", lambda c: F.coalesce(c, F.lit("")))), r"[\r\n]+", " ")
    rows.select(line.alias("value")).write.text(path)


def to_json(pairs: DataFrame) -> DataFrame:
    """Pairs (first, second, status) as JSON texts {"status", "first", "second"}, one a line."""
    return pairs.select(F.to_json(F.struct("status", "first", "second")).alias("value"))


def response(pairs: DataFrame) -> DataFrame:
    """One row: {"confirmed": [...], "candidates": [...]} as JSON, for results that one row can hold."""
    lists = [F.array_sort(F.collect_set(F.when(F.col("status") == s, F.struct("first", "second")))).alias(s) for s in ("confirmed", "candidates")]
    return pairs.agg(*lists).select(F.to_json(F.struct("confirmed", "candidates")).alias("value"))


def write_pairs(pairs: DataFrame, path: str, form: str = "parquet") -> None:
    if not re.fullmatch("parquet|json|csv|orc", form):
        raise InvalidInputError(f"no such format: {form}")
    pairs.write.format(form).save(path)
